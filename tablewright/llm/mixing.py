"""Mix sources to target weights along a time-varying curriculum, with DataFrame functions only.

Targets share all words by weight, but no source is repeated more than ``cap``
times: what a capped source leaves is shared again by weight.  Within a source
the documents stand in a fixed pseudo-random order.  Each source has a weight
schedule over training time 0 to 1; its integral is the demand for words of that
source up to a time, and the inverse of that integral gives every document the
time at which its words are due.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions.lookup import lookup_join
from tablewright.functions.ranking import dense_codes
from tablewright.llm.common import add_starts, stored

ROWS_PER_BUCKET = 2_000


@dataclass(frozen=True)
class MixRules:
    """Weights and tilts go to the sources in code-point order, null last, repeating.

    The weight of a source at time x is its target times ``1 + tilt * (1 - 2 * x)``:
    a positive tilt (at most 1) asks for its words early, a negative one late.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    tilts: tuple[float, ...] = (0.5, 0.0, -0.5)
    cap: int = 3


def source_targets(rows: DataFrame, rules: MixRules) -> DataFrame:
    """One row per source: ``source_key, n_rows, source_size, target, goal, tilt``.

    ``rows`` has ``source`` and ``size``.  ``goal`` is the target in whole words.
    """
    sources = stored(
        rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size")), "sources"
    )
    codes = dense_codes(sources, "source", "rank")
    named = sources.where(F.col("source").isNotNull())
    last = named.count()  # a null source comes after all others
    ranked = codes.join(named, "source", "rank").unionByName(
        sources.where(F.col("source").isNull()).withColumn("rank", F.lit(last).cast("long"))
    )
    ranked = ranked.select(
        source_key(F.col("source")).alias("source_key"),
        "n_rows",
        "source_size",
        cycle(rules.weights, F.col("rank")).alias("weight"),
        cycle(rules.tilts, F.col("rank")).cast("double").alias("tilt"),
        (F.lit(rules.cap) * F.col("source_size")).alias("limit"),
    )
    level = share_level(ranked)
    target = F.least(F.col("limit").cast("double"), F.lit(level) * F.col("weight"))
    return ranked.withColumn("target", target).select(
        "source_key", "n_rows", "source_size", "target", F.floor(F.col("target") + 0.5).alias("goal"), "tilt"
    )


def share_level(ranked: DataFrame) -> float:
    """Words per unit of weight once every source above its limit is cut to it.

    Each round caps the sources that are above their limit and shares the rest anew;
    the level only rises, so the rounds end when no further source is capped.
    """
    total = ranked.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level, capped = 0.0, -1
    while total:
        above = F.col("limit").cast("double") < F.lit(level) * F.col("weight")
        now = ranked.agg(
            F.count(F.when(above, 1)).alias("n"),
            F.coalesce(F.sum(F.when(above, F.col("limit"))), F.lit(0)).alias("limit"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if now["n"] == capped or not now["weight"]:
            break
        level, capped = (total - now["limit"]) / now["weight"], now["n"]
    return level


def source_key(source: Column) -> Column:
    """A key that is never null: sources with a mark before them, nothing for null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def cycle(values: tuple, rank: Column) -> Column:
    picked = F.pmod(rank, F.lit(len(values))) + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), picked.cast("int"))


def due_time(share: Column, tilt: Column) -> Column:
    """The time at which the integral of ``1 + tilt * (1 - 2 * x)`` reaches ``share``."""
    root = F.sqrt(F.greatest((1 + tilt) * (1 + tilt) - 4 * tilt * share, F.lit(0.0)))
    return F.coalesce(F.try_divide(2 * share, 1 + tilt + root), F.lit(0.0))


#: Columns that ``place`` reads, and those that it adds.
GIVEN = ("source", "size", "order")
ADDED = ("source_size", "target", "start", "goal", "tilt", "taken", "position")


def place(rows: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """``rows`` (``source, size, order`` and anything else) with what the mix takes of each.

    Adds ``source_size, target, start, goal, tilt, taken, position``.  ``order`` is a
    hexadecimal digest that fixes the order within a source; rows of one digest are
    taken to be copies of each other.  ``start`` counts the words of the source before
    a row.  A pass over the source gives each row its words until the goal is met:
    ``taken`` sums over the passes, at most one row per source gives a part only.
    ``position`` is the due time of a row's first taken words, null if none are taken.

    A hot source is split by the leading digits of the digest: sums per bucket come
    first, then each bucket of about 2,000 rows is numbered on its own.  A null
    size counts as 0; an empty table gives an empty result.  Columns named like the added
    ones are replaced, all others stay whatever their names.
    """
    kept = [c for c in rows.columns if c.lower() not in (*GIVEN, *ADDED)]
    rest = F.struct(*([F.col(f"`{c}`") for c in kept] or [F.lit(1)]))
    rows = rows.select(*GIVEN, rest.alias("rest"))
    rows = rows.withColumn("size", F.coalesce(F.col("size"), F.lit(0)).cast("long"))
    targets = stored(source_targets(rows, rules), "targets")
    keyed = lookup_join(rows.withColumn("source_key", source_key(F.col("source"))), targets, ["source_key"])
    leading = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    buckets = F.floor(F.col("n_rows") / ROWS_PER_BUCKET) + 1
    keyed = keyed.withColumn("bucket", F.shiftright(leading * buckets, 32))
    sums = keyed.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"))
    starts = add_starts(sums, ["source_key"], "bucket", "words", "bucket_start").drop("words")
    before = (
        Window.partitionBy("source_key", "bucket")
        .orderBy("order", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    within = keyed.withColumn("within", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = within.join(starts, ["source_key", "bucket"])
    placed = placed.withColumn("start", F.col("bucket_start") + F.col("within"))
    taken = reduce(Column.__add__, [words_in_pass(p) for p in range(rules.cap)])
    first = F.least(F.col("size"), F.col("goal") - F.col("start"))
    share = (F.col("start") + first / 2) / F.col("goal")
    placed = placed.withColumn("taken", taken).withColumn("position", F.when(F.col("taken") > 0, due_time(share, F.col("tilt"))))
    return placed.select(*GIVEN, *[F.col(f"rest.`{c}`") for c in kept], *ADDED)


def words_in_pass(number: int) -> Column:
    """Words that pass ``number`` (from 0) over the source takes of a row."""
    left = F.col("goal") - F.lit(number) * F.col("source_size") - F.col("start")
    return F.least(F.greatest(left, F.lit(0)), F.col("size"))


def training_order(placed: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """One row per copy that the mix takes, sorted by due time.

    Every pass gives a row for each document of which it takes at least half of the
    words; the document is then whole.  Adds ``copy`` (from 0) and ``due``; columns of
    these names are replaced, all others stay.
    """
    copies = F.filter(
        F.array(
            *[
                F.when(
                    (words_in_pass(p) > 0) & (2 * words_in_pass(p) >= F.col("size")),
                    F.struct(
                        F.lit(p).alias("copy"),
                        ((p * F.col("source_size") + F.col("start") + words_in_pass(p) / 2) / F.col("goal")).alias("at"),
                    ),
                )
                for p in range(rules.cap)
            ]
        ),
        lambda c: c.isNotNull(),
    )
    kept = [c for c in placed.columns if c.lower() not in ("copy", "due")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    exploded = placed.select(row.alias("row"), F.explode(copies).alias("one"))
    due = due_time(F.col("one.at"), F.col("row.tilt"))
    named = exploded.select(*[F.col(f"row.`{c}`") for c in kept], F.col("one.copy").alias("copy"), due.alias("due"))
    return named.orderBy("due", "order", "copy")
