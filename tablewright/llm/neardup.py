"""Near duplicates by MinHash: one permutation, optimal densification, banded buckets, star-shaped edges.

A document's set holds its distinct five-word shingles.  One hash function deals the
shingles to bins; the smallest of each bin is its value, and an empty bin takes the
value of the bin that comes first in a fixed random order of its own.  Bands of six
bins make 32 buckets per set.  With a similarity of 0.85 two sets share no bucket
once in 4 million pairs.  For lower similarities there are 48 bands of five or more:
at 0.8 two sets share no bucket once in 190 million pairs.

Texts of one set form a class, and only classes are compared.  In each bucket all
members are compared with one centre, the member that meets most others over all
its buckets.  Buckets that the links leave in several components are compared
in blocks of bounded size, so that no pairs of a large group are ever written out
and none of its links is lost.  Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import stored, values_of

SHINGLE_WORDS = 5
BANDS, BAND_ROWS = 32, 6
#: Below 85 percent: the fewest bands, and the share of pairs at the limit that may share no bucket.
LOW_BANDS, LOW_BAND_ROWS = 48, 5
MISSED = 3e-7
#: Members per block of a comparison, and columns of its bit matrix at a time.
BLOCK_ROWS = 256
BLOCK_COLUMNS = 8192
_CHUNK = 1 << 20
_MOST_ROUNDS = 100

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base modulo 2^64, and their inverses."""
    base = int(_BASE) | 1
    inverse = pow(base, -1, 1 << 64)
    found = []
    for factor in (base, inverse):
        row = np.full(n, factor, np.uint64)
        row[0] = 1
        found.append(np.multiply.accumulate(row))
    return found[0], found[1]


_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[32, *range(9, 14)]] = True


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word, in order; long texts are hashed in chunks that end at a blank."""
    found, at = [], 0
    while at < len(text):
        end = min(at + _CHUNK, len(text))
        while end < len(text) and not _IS_BLANK[text[end]]:
            end += 1
        data = np.frombuffer(text, np.uint8, end - at, at)
        at = end
        inside = ~_IS_BLANK[data]
        edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        size = 1 << max(17, int(len(data) - 1).bit_length())
        up, down = powers(size)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
        found.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of shingle hashes; a text of fewer words has one shingle, a text without words none."""
    # bytes.lower changes A-Z only.
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    width = min(SHINGLE_WORDS, len(words))
    if not width:
        return words
    n = len(words) - width + 1
    found = np.full(n, width, np.uint64)
    for k in range(width):
        found = mix(found * _BASE + words[k : k + n])
    return np.unique(found)


def bands_for(percent: int) -> tuple[int, int]:
    """Bands and bins of each band that find pairs of ``percent`` and more."""
    if percent >= 85:
        return BANDS, BAND_ROWS
    shared = (max(percent, 1) / 100) ** LOW_BAND_ROWS
    return max(LOW_BANDS, int(np.ceil(np.log(MISSED) / np.log1p(-shared)))), LOW_BAND_ROWS


@lru_cache(maxsize=1)
def donors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` bins a random order of all bins, and the place of each bin in that order."""
    order = np.argsort(np.random.default_rng(7).random((n, n)), axis=1)
    return order, np.argsort(order, axis=1)


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """One bucket key (int64) per band of a non-empty set."""
    n = bands * rows
    bins = ((hashes >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    filled, values = bins[first], np.zeros(n, np.uint64)
    values[filled] = hashes[first]
    if len(filled) < n:
        empty = np.setdiff1d(np.arange(n), filled, assume_unique=True)
        order, places = donors(n)
        if len(filled) < 48:
            values[empty] = values[filled[np.argmin(places[np.ix_(empty, filled)], axis=1)]]
        else:
            has, attempt, open_bins = np.zeros(n, bool), 0, empty
            has[filled] = True
            while len(open_bins):
                donor = order[open_bins, attempt]
                ok = has[donor]
                values[open_bins[ok]] = values[donor[ok]]
                open_bins, attempt = open_bins[~ok], attempt + 1
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for row in values.reshape(bands, rows).T:
        keys = mix(keys * _BASE + row)
    return keys.view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, percent: int = 85) -> DataFrame:
    """``id, text_hash, n, s1, s2, bands`` per row; s1 and s2 name the set and are null for an empty one."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shape = bands_for(percent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, bands = [], [], [], []
            for value in values_of(batch.column("text")):
                found = shingles(value)
                n.append(len(found))
                if len(found):
                    names = np.frombuffer(blake2b(found, digest_size=16).digest(), np.int64)
                    s1.append(int(names[0]))
                    s2.append(int(names[1]))
                    bands.append(band_keys(found, *shape))
                else:
                    s1.append(None)
                    s2.append(None)
                    bands.append(None)
            arrays = [pa.array(c, pa.int64()) for c in (n, s1, s2)] + [pa.array(bands, pa.list_(pa.int64()))]
            names = ["id", "text_hash", "n", "s1", "s2", "bands"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), *arrays], names)

    return rows.mapInArrow(sign, f"id {kind}, text_hash long, n long, s1 long, s2 long, bands array<long>")


def full_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """``c, shingles`` for the classes in ``wanted`` (``c, rep_id, rep_hash``), from their texts."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    same = F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash"))
    # A row that stands in the table many times is hashed once.
    texts = rows.join(wanted, same).groupBy("c").agg(F.first("text").alias("text"))

    def hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(value).view(np.int64) for value in values_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(sets, pa.list_(pa.int64()))], ["c", "shingles"])

    return texts.mapInArrow(hash_sets, "c long, shingles array<long>")


def similar(shared: Column, one: Column, two: Column, percent: int) -> Column:
    return 100 * shared >= percent * (one + two - shared)


def components(links: DataFrame) -> DataFrame:
    """``c, comp`` for every node of the links ``a, b``: the smallest node it is linked with over any way.

    Each round takes the smallest label of the neighbours and then the label of that
    label, so chains shrink by half; rounds end when no label changes.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = stored(
        edges.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels"
    )
    for _ in range(_MOST_ROUNDS):
        near = edges.join(labels.select(F.col("c").alias("b"), "comp"), "b").groupBy(F.col("a").alias("c"))
        lower = near.agg(F.min("comp").alias("near"))
        next_labels = labels.join(lower, "c").select("c", "comp", F.least("comp", "near").alias("low"))
        above = labels.select(F.col("c").alias("low"), F.col("comp").alias("jump"))
        jumped = next_labels.join(above, "low").select(
            "c", F.least("low", "jump").alias("new"), (F.least("low", "jump") != F.col("comp")).alias("moved")
        )
        jumped = stored(jumped, "labels")
        labels = jumped.select("c", F.col("new").alias("comp"))
        if not jumped.where("moved").take(1):
            return labels
    raise RuntimeError("components did not settle")


def star_edges(members: DataFrame) -> DataFrame:
    """``c, hub``: every member of a bucket with its centre; ``members`` has ``c, band``, once each."""
    sizes = members.groupBy("band").agg(F.count("*").alias("size"))
    meets = members.join(sizes, "band").groupBy("c").agg(F.sum("size").alias("meets"))
    centres = (
        members.join(meets, "c").groupBy("band").agg(F.max(F.struct("meets", "c")).alias("top")).select("band", F.col("top.c").alias("hub"))
    )
    return members.join(centres, "band").where(F.col("c") != F.col("hub")).select("c", "hub").distinct()


def block_links(stars: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components that stars alone do not show, as ``a, b``.

    The members of all buckets with one centre form a group.  Groups that lie in one
    component are done.  The others are cut into blocks of about 256 members, and
    each pair of blocks is compared in a task of its own.
    """
    groups = stars.unionByName(stars.select(F.col("hub").alias("c"), "hub").distinct())
    placed = groups.join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    mixed = placed.groupBy("hub").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"))
    mixed = mixed.where(F.col("low") < F.col("high")).select("hub", F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks"))
    rows = placed.join(mixed, "hub").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select(
        "hub", "c", "comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )

    def compare(group: tuple, table: pd.DataFrame) -> pd.DataFrame:
        left = table[table["block"] == group[1]]
        right = table[table["block"] == group[2]]
        pairs = linked_pairs(left, right, percent)
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    return rows.join(sets, "c").groupBy("hub", "i", "j").applyInPandas(compare, "a long, b long")


def linked_pairs(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> np.ndarray:
    """Linked pairs of two blocks in different components; overlaps come from products of bit matrices."""
    other = left["comp"].to_numpy()[:, None] != right["comp"].to_numpy()[None, :]
    if not other.any():
        return np.zeros((0, 2), np.int64)
    sets = [list(block["shingles"]) for block in (left, right)]
    sizes = [np.array([len(s) for s in block]) for block in sets]
    flat = [np.concatenate(block) for block in sets]
    owner = [np.repeat(np.arange(len(n)), n) for n in sizes]
    shared = np.intersect1d(flat[0], flat[1])
    keep = [np.isin(f, shared) for f in flat]
    column = [np.searchsorted(shared, f[k]) for f, k in zip(flat, keep)]
    owner = [o[k] for o, k in zip(owner, keep)]
    overlap = np.zeros((len(left), len(right)), np.float64)
    for low in range(0, len(shared), BLOCK_COLUMNS):
        bits = []
        for side, n in enumerate((len(left), len(right))):
            here = (column[side] >= low) & (column[side] < low + BLOCK_COLUMNS)
            matrix = np.zeros((n, min(BLOCK_COLUMNS, len(shared) - low)), np.float32)
            matrix[owner[side][here], column[side][here] - low] = 1
            bits.append(matrix)
        overlap += bits[0] @ bits[1].T
    union = sizes[0][:, None] + sizes[1][None, :] - overlap
    a, b = np.nonzero(other & (100 * overlap >= percent * union))
    return np.stack([left["c"].to_numpy()[a], right["c"].to_numpy()[b]], axis=1)


def group_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """``id, text_hash, n_shingles, component_id, component`` per row of ``docs``.

    Rows are linked when 100 * shared shingles >= ``percent`` * shingles of both; the
    component id is the smallest key reachable, null keys aside (null if there is no
    other).  ``component`` numbers the components of more than one row and is null for
    other rows.  A null text or one without words is linked with nothing and keeps its
    key.  Repeated rows have one set and so one component.  Other columns are ignored;
    an empty table stays empty.
    """
    signed = stored(signatures(docs, key, text, percent), "signatures")
    known = signed.where(F.col("s1").isNotNull())
    classes = stored(
        known.groupBy("s1", "s2")
        .agg(
            F.min("id").alias("first_id"),
            F.min("text_hash").alias("rep_hash"),
            F.min_by("id", "text_hash").alias("rep_id"),
            F.min("n").alias("n"),
            F.count("*").alias("copies"),
        )
        .withColumn("c", F.monotonically_increasing_id()),
        "classes",
    )
    same = F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash"))
    reps = classes.select(F.col("s1").alias("r1"), F.col("s2").alias("r2"), "rep_id", "rep_hash", "c")
    named = known.join(reps, (F.col("s1") == F.col("r1")) & (F.col("s2") == F.col("r2")) & same).select("c", "bands")
    banded = stored(named, "bands").select("c", F.explode("bands").alias("band"))
    several = banded.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    several = several.where(F.col("low") < F.col("high")).select("band")
    members = stored(banded.join(several, "band").distinct(), "members")
    stars = stored(star_edges(members), "stars")
    wanted = stars.select("c").union(stars.select("hub")).distinct().join(classes.select("c", "rep_id", "rep_hash"), "c")
    sets = stored(full_sets(docs, key, text, wanted), "sets")
    hub_sets = sets.select(F.col("c").alias("hub"), F.col("shingles").alias("hub_shingles"))
    compared = stars.join(sets, "c").join(hub_sets, "hub")
    shared = F.size(F.array_intersect("shingles", "hub_shingles"))
    close = similar(shared, F.size("shingles"), F.size("hub_shingles"), percent)
    links = stored(compared.where(close).select(F.col("c").alias("a"), F.col("hub").alias("b")), "links")
    first = components(links)
    more = stored(block_links(stars, first, sets, percent), "links")
    final = components(links.unionByName(more)) if more.take(1) else first

    placed = final.join(classes, "c")
    smallest = placed.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    linked = placed.join(smallest, "comp").select("c", "comp", "component_id")
    groups = classes.join(linked, "c", "left").where((F.col("copies") > 1) | F.col("comp").isNotNull())
    groups = groups.select(
        F.col("s1").alias("r1"),
        F.col("s2").alias("r2"),
        F.when(F.col("comp").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("comp", "c").alias("component"),
    )
    found = signed.join(groups, (F.col("s1") == F.col("r1")) & (F.col("s2") == F.col("r2")), "left")
    return found.select(
        "id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
        "component",
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """``key, n_shingles, component_id, kept`` per row; kept rows carry the key of their component."""
    grouped = group_near_duplicates(docs, key, text, percent)
    kept = F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    return grouped.select(F.col("id").alias(key), "n_shingles", "component_id", kept)


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row of ``docs`` per component, with all its columns.

    The row with the smallest key stays (a null key comes last), of several such the
    one with the smallest hash of the text, of equal ones any.  Rows that are linked
    with nothing all stay, rows without words among them.
    """
    grouped = stored(group_near_duplicates(docs, key, text, percent), "groups")
    alone, together = (grouped.where(F.col("component").isNull()), grouped.where(F.col("component").isNotNull()))
    rank = F.struct(F.col("id").isNull().alias("late"), "id", "text_hash")
    best = together.groupBy("component").agg(F.min(rank).alias("best")).select("best.id", "best.text_hash")
    wanted = best.withColumn("single", F.lit(False)).union(
        alone.select("id", "text_hash").distinct().withColumn("single", F.lit(True))
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{key}`").alias("row_id"),
        F.xxhash64(F.col(f"`{text}`")).alias("row_hash"),
    )
    same = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("text_hash"))
    kept = rows.join(wanted, same).select("row", "row_id", "row_hash", "single")
    if together.groupBy("id", "text_hash").count().where("count > 1").take(1):
        # Equal rows, of which the join keeps all.
        one = kept.where(~F.col("single")).groupBy("row_id", "row_hash").agg(F.first("row").alias("row"))
        kept = one.select("row").unionByName(kept.where("single").select("row"))
    return kept.select("row.*")
