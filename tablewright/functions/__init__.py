"""Shared column and DataFrame helpers."""
