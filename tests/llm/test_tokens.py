"""Token shards and packing against the tokenizers library and exact round trips."""

from functools import lru_cache
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tablewright.llm import packing, tokens, wavelet
from tests.conftest import SF

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [
    None, "", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb c", " \n x", "don't we'll 'so", "Über Straße, Ça!", "x\t y",
    "a b c", "é ́x", "İstanbul ΣΑΣ ß", "中文 текст 123 4,5", "<|endoftext|> <|startoftext|>", "end. \nNew",
    "a.\nB c.\nD", "\x1c \x1d\x85 z", "word-word (x) [y] {z} ~`", "ÿÿ ﬁ ǅ", "_a_ a_b", "A" * 5000, "x " * 3000, "😀 ok",
    "a <|endoftext|> b", "<|endoftext|>", "x<|EndOfText|>y <|startoftext|>. z", "<|endoftext |> <|",
]


@lru_cache
def loaded(path):
    return Tokenizer.from_file(path)


def library(path, texts):
    tokenizer = loaded(path)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def ours(path, texts):
    ids, counts = tokens.encoder(path).encode(pa.array(texts, pa.string()))
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_odd_texts_equal_library(path):
    assert ours(path, ODD) == library(path, ODD)


def test_pieces_beyond_what_is_kept(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 5)
    monkeypatch.setattr(tokens, "KEPT_PARTS", 2)
    monkeypatch.setattr(tokens, "LONGEST_KEPT", 6)
    for path in (WORD, BYTE):
        model = tokens.Encoder(path)
        for low in range(0, len(ODD), 4):
            ids, counts = model.encode(pa.array(ODD[low : low + 4], pa.string()))
            assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == library(path, ODD[low : low + 4])
        assert 0 < len(model.kept) <= 5 and len(model.kept_ids) == model.kept_ends[-1]


ALPHABET = st.sampled_from(list("aB\n '’.,!\tßÉİ́ ​中1_|<") + [" ", " ", " "])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=30), min_size=1, max_size=4), st.sampled_from([WORD, BYTE]))
def test_any_text_equals_library(texts, path):
    assert ours(path, texts) == library(path, texts)


def test_documents_equal_library(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for path in (WORD, BYTE):
        assert ours(path, texts) == library(path, texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70000), max_size=1500), st.data())
def test_wavelet_matrix(values, data):
    matrix = wavelet.WaveletMatrix.build(np.array(values, np.uint32))
    matrix = wavelet.WaveletMatrix(matrix.n, *matrix.parts())
    assert matrix.decode().tolist() == values
    if values:
        at = data.draw(st.integers(0, len(values) - 1))
        assert matrix.access(at) == values[at]
        symbol = values[at]
        assert matrix.rank(symbol, at) == values[:at].count(symbol)
        assert matrix.select(symbol, values[:at].count(symbol)) == at
        assert matrix.count(symbol, 0, len(values)) == values.count(symbol)
        assert matrix.select(symbol, values.count(symbol)) == -1
    assert matrix.count(99999, 0, len(values)) == 0


def expected_documents(rows, path):
    """Brute force: ids, number and start of all documents in ascending order of id."""
    found, start = [], 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (key, _), ids in zip(order, library(path, [t for _, t in order])):
        ids = np.array([*ids, 1], "<u4")
        found.append((key, start, len(ids), crc32(ids)))
        start += len(ids)
    return found


def test_token_shards_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = entry.queries()["op3_token_shards"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == expected_documents(rows, WORD)


def test_token_shards_of_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 1000)
    rows = [(i if i % 7 else None, t) for i, t in enumerate(ODD)] + [(3, "same"), (3, "same")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, start string, shard int")
    wavelet.write_token_shards(df, "doc_id", "text", WORD, 1, str(tmp_path / "a"))
    got = [tuple(r)[:4] for r in wavelet.read_token_shards(spark, str(tmp_path / "a")).collect()]
    want = expected_documents(rows, WORD)
    assert sorted((r[2], r[3]) for r in got) == sorted((r[2], r[3]) for r in want)
    assert sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in want)
    ends = sorted((r[1], r[1] + r[2]) for r in got)
    assert [a for a, _ in ends] == [0, *[b for _, b in ends[:-1]]]  # the documents follow each other
    keys = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))


def test_token_shards_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    wavelet.write_token_shards(df, "doc_id", "text", WORD, 1, str(tmp_path / "a"))
    assert wavelet.read_token_shards(spark, str(tmp_path / "a")).count() == 0


def check_packed(pieces, rows, path, size=2048):
    """Every id in one piece, sequences without gaps and not too long; returns padded per used tokens."""
    ids = {k: np.array([*i, 1], "<u4") for (k, _), i in zip(rows, library(path, [t for _, t in rows]))}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert set(by_doc) == set(ids)
    for key, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids[key])
            assert p["ids_crc32"] == crc32(ids[key][at : at + p["length"]])
            at += p["length"]
        assert at == len(ids[key])
        assert len(own) == -(-len(ids[key]) // size)  # cut no more than needed
    padded = used = 0
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
        used += at
        padded += 0 if at & (at - 1) == 0 else size - at
    return padded / used


def test_pack_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    pieces = entry.queries()["op4_pack"](spark, SF).collect()
    assert check_packed(pieces, rows, BYTE) < 0.02


def test_pack_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "_ROWS", 3)
    rows = list(enumerate(ODD))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, offset int, part string")
    check_packed(packing.pack(df.repartition(5), "doc_id", "text", BYTE, 1).collect(), rows, BYTE)
    check_packed(packing.pack(df.repartition(2), "doc_id", "text", BYTE, 1, size=16).collect(), rows, BYTE, 16)
    same = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b")], "doc_id long, text string")
    pieces = packing.pack(same, "doc_id", "text", BYTE, 1).collect()
    assert sorted((str(p["doc_id"]), p["length"]) for p in pieces) == [("1", 3), ("None", 3), ("None", 3)]
    assert packing.pack(same.limit(0), "doc_id", "text", BYTE, 1).count() == 0


def test_open_windows_stay_few():
    windows = packing.Windows(100, 4, 0)
    for length in [60, 70, 80, 90, 55, 41, 42, 43]:
        windows.place(0, 0, length)
        assert len(windows.room) <= 4
    sequences = [p[3] for p in windows.done + windows.close()]
    assert len(sequences) == 8


@pytest.mark.parametrize("bits", [3, 16])
def test_lookups_on_stored_shards(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 700)
    monkeypatch.setattr(wavelet, "PORTION_BITS", bits)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [(i, t) for i, t in sorted(texts.items())[:40]] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "the the the")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "a")
    wavelet.write_token_shards(df, "doc_id", "text", WORD, 1, path)
    library = Tokenizer.from_file(WORD)
    per_doc = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    ids = [t for _, doc in per_doc for t in doc]
    wanted = [0, 1, len(ids) - 1, *range(0, len(ids), 97)]
    asked = spark.createDataFrame([(p,) for p in [*wanted, 0, -1, len(ids), None]], "p long")
    got = {tuple(r) for r in wavelet.tokens_at(asked, path, "p").collect()}
    assert got == {(p, ids[p]) for p in wanted}
    some = [1, ids[5], ids[len(ids) // 2], 49_000]
    for low, high in ((0, None), (300, len(ids) - 500), (5, 6), (9, 9)):
        part = ids[low:high]
        counted = {r["token"]: r["n"] for r in wavelet.count_tokens(spark, path, some, low, high).collect()}
        assert counted == {t: part.count(t) for t in some}
    for token in some:
        found = sorted(tuple(r) for r in wavelet.occurrences(spark, path, token).collect())
        flat = [(doc, at) for doc, own in per_doc for at in range(len(own))]
        assert found == [(p, *flat[p]) for p in range(len(ids)) if ids[p] == token]


def test_lookups_without_shards(spark, tmp_path):
    path = str(tmp_path / "none")
    wavelet.write_token_shards(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", WORD, 1, path)
    assert wavelet.tokens_at(spark.range(3), path, "id").count() == 0
    assert [tuple(r) for r in wavelet.count_tokens(spark, path, [4]).collect()] == [(4, 0)]
    assert wavelet.occurrences(spark, path, 4).count() == 0
