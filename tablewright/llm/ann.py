"""Approximate nearest neighbours by cosine over learned partitions.

A bounded sample gives a neighbour graph, which is cut into parts of equal size
with few edges between them.  A small network learns which part a vector's
neighbours lie in; it then routes every row to its most probable part and every
query to several.  The candidates of these parts are ranked by the exact cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import stored

#: Bounds of the fitted sample and of the number of parts.
SAMPLE_ROWS = 6000
MOST_PARTS = 256
ROWS_PER_PART = 400
GRAPH_NEIGHBOURS = 10
#: The fewest parts are searched that hold this share of the neighbours of held-out rows, less the error of the measurement.
WANTED_RECALL = 0.95
ERRORS = 2
#: One of so many rows of the sample is held out from the training of the router.
HELD_OUT = 4
#: Candidates and queries of a part are ranked in blocks of about this many rows each.
BLOCK_ROWS = 4096


@dataclass(frozen=True)
class Router:
    """A network with one hidden layer that gives the probability of each part."""

    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def scores(self, unit: np.ndarray) -> np.ndarray:
        layer = np.maximum(unit @ self.hidden + self.hidden_bias, 0)
        return layer @ self.out + self.out_bias


def neighbour_graph(unit: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest other rows of every row, by blocks of the product matrix."""
    found = np.empty((len(unit), k), np.int64)
    for low in range(0, len(unit), 1024):
        near = unit[low : low + 1024] @ unit.T
        near[np.arange(len(near)), np.arange(low, low + len(near))] = -np.inf
        found[low : low + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return found


def balanced_parts(unit: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """A part for every node: halves along main directions, then moves to where the neighbours are.

    ``parts`` is a power of two.  A node only moves into a part that has room.
    """
    part = np.zeros(len(unit), np.int64)
    while part.max() + 1 < parts:
        count = part.max() + 1
        for one in range(count):
            rows = np.flatnonzero(part == one)
            centred = unit[rows] - unit[rows].mean(axis=0)
            direction = np.linalg.svd(centred[:512], full_matrices=False)[2][0]
            along = np.argsort(centred @ direction, kind="stable")
            part[rows[along[len(rows) // 2 :]]] = one + count
    room = int(np.ceil(slack * len(unit) / parts))
    sizes = np.bincount(part, minlength=parts)
    links = [[] for _ in range(len(unit))]
    for node, near in enumerate(graph.tolist()):
        for other in near:
            links[node].append(other)
            links[other].append(node)
    rng = np.random.default_rng(11)
    for _ in range(rounds):
        moved = 0
        for node in rng.permutation(len(unit)).tolist():
            here = part[node]
            votes = np.bincount(part[links[node]], minlength=parts)
            votes[(sizes >= room) & (np.arange(parts) != here)] = -1
            best = int(np.argmax(votes))
            if votes[best] > votes[here]:
                part[node] = best
                sizes[here] -= 1
                sizes[best] += 1
                moved += 1
        if moved < len(unit) // 200:
            break
    return part


def train_router(unit: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, width: int = 128, epochs: int = 40) -> Router:
    """Fit the network to the parts of each node and its neighbours (softmax, Adam)."""
    rng = np.random.default_rng(5)
    target = np.zeros((len(unit), parts), np.float32)
    np.add.at(target, (np.arange(len(unit))[:, None], part[graph]), 1.0 / (graph.shape[1] + 2))
    np.add.at(target, (np.arange(len(unit)), part), 2.0 / (graph.shape[1] + 2))
    x = unit.astype(np.float32)
    weights = [
        rng.normal(0, np.sqrt(2), (x.shape[1], width)).astype(np.float32),
        np.zeros(width, np.float32),
        rng.normal(0, 1 / np.sqrt(width), (width, parts)).astype(np.float32),
        np.zeros(parts, np.float32),
    ]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for low in range(0, len(x), 256):
            rows = order[low : low + 256]
            layer = np.maximum(x[rows] @ weights[0] + weights[1], 0)
            logits = layer @ weights[2] + weights[3]
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            error = (chance - target[rows]) / len(rows)
            back = (error @ weights[2].T) * (layer > 0)
            step += 1
            rate = 3e-3 * (1 - epoch / epochs) + 1e-4
            for i, slope in enumerate((x[rows].T @ back, back.sum(axis=0), layer.T @ error, error.sum(axis=0))):
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope * slope
                weights[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*weights)


def fit(sample: np.ndarray, rows: int) -> tuple[Router, int, int]:
    """Router, number of parts, and parts to search, for ``rows`` vectors, from a sample of unit vectors.

    The number to search is measured on rows that the router was not trained on, as are
    most of the table: each held-out row and its nearest among the held-out ones, as many
    as a share of the table holds of its ``GRAPH_NEIGHBOURS`` nearest, and one at least.
    """
    wanted = max(1, min(MOST_PARTS, rows // ROWS_PER_PART, len(sample) // 64))
    parts = 1 << (wanted.bit_length() - 1)
    if parts == 1:
        width = sample.shape[1]
        zeros = [np.zeros(shape, np.float32) for shape in ((width, 1), (1,), (1, 1), (1,))]
        return Router(*zeros), 1, 1
    held = np.arange(len(sample)) % HELD_OUT == 0
    known, unseen = sample[~held], sample[held]
    graph = neighbour_graph(known, min(GRAPH_NEIGHBOURS, len(known) - 1))
    router = train_router(known, graph, balanced_parts(known, graph, parts), parts)
    return router, parts, parts_to_search(router, unseen, parts, rows)


def parts_to_search(router: Router, unseen: np.ndarray, parts: int, rows: int) -> int:
    """The fewest parts that hold enough of the neighbours of unseen rows, by a lower bound of the mean over rows."""
    near = neighbour_graph(unseen, min(max(1, -(-GRAPH_NEIGHBOURS * len(unseen) // rows)), len(unseen) - 1))
    scores = router.scores(unseen)
    home = np.argmax(scores, axis=1)
    place = np.argsort(np.argsort(-scores, axis=1), axis=1)  # of each part in a row's order
    needed = place[np.arange(len(unseen))[:, None], home[near]]
    for probes in range(1, parts):
        share = (needed < probes).mean(axis=1)
        if share.mean() - ERRORS * share.std() / np.sqrt(len(unseen)) >= WANTED_RECALL:
            return probes
    return parts


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id, v``: distinct rows with an id and a vector that has a direction, of the most common length."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (length["n"] if length else 0)).distinct()


def unit_rows(vectors: pd.Series) -> np.ndarray:
    rows = np.stack(vectors.to_numpy()).astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares of very large or small numbers stay finite
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def nearest(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row for which ``queries`` holds.

    ``queries`` is a condition on ``vec_id``.  Every row is a candidate but those with
    the query's own id.  Vectors that are null, zero or hold a null or non-finite
    number take no part, nor do rows without an id or of another length than most.
    Repeated rows count once.  Of equal vectors only the ``k + 1`` smallest ids can be
    among the nearest, and equal query vectors are searched once, so that a vector
    that fills a third of the table costs no more than others.  Scores are cosines in
    double precision; ties go to the smaller id.  An empty table has no rows.
    """
    rows = stored(usable(vectors, key, vector), "vectors")
    same = Window.partitionBy("v").orderBy("vec_id")
    kept = stored(rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n"), "candidates")
    asked = rows.where(queries)
    questions = stored(asked.select("v").distinct().withColumn("qid", F.monotonically_increasing_id()), "questions")
    total = kept.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = kept.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE_ROWS).toPandas()
    router, parts, probes = fit(unit_rows(drawn["v"]), total)

    def route(tables, most: int, name: str):
        for table in tables:
            if len(table):
                scores = router.scores(unit_rows(table["v"]))
                best = np.argsort(-scores, axis=1, kind="stable")[:, :most]
                yield pd.DataFrame(
                    {
                        name: np.repeat(table[name].to_numpy(), most),
                        "v": np.repeat(table["v"].to_numpy(), most),
                        "part": best.ravel(),
                    }
                )

    homes = stored(kept.mapInPandas(lambda t: route(t, 1, "vec_id"), "vec_id long, v array<double>, part long"), "homes")
    routed = questions.mapInPandas(lambda t: route(t, probes, "qid"), "qid long, v array<double>, part long")
    routed = stored(routed, "routed")

    def blocks(df: DataFrame) -> Column:
        counts = {r["part"]: -(-r["count"] // BLOCK_ROWS) for r in df.groupBy("part").count().collect()}
        numbers = F.array(*[F.lit(counts.get(part, 1)) for part in range(parts)])
        return F.get(numbers, F.col("part").cast("int")).cast("long")

    home_blocks, query_blocks = blocks(homes), blocks(routed)

    def dealt(df: DataFrame, own: Column, own_name: str, other: Column, other_name: str, by: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), other - 1))
        return df.withColumn(own_name, F.pmod(F.xxhash64(by), own)).withColumn(other_name, every)

    left = dealt(homes, home_blocks, "block", query_blocks, "chunk", "vec_id").groupBy("part", "block", "chunk")
    right = dealt(routed, query_blocks, "chunk", home_blocks, "block", "qid").groupBy("part", "block", "chunk")

    def rank(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return best_of_block(candidates, asked, k + 1)

    found = left.cogroup(right).applyInPandas(rank, "qid long, vec_id long, score double")
    order = [F.desc("score"), F.asc("vec_id")]
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    best = stored(best.where(F.col("n") <= k + 1).drop("n"), "best")
    answers = asked.join(questions, "v").select(F.col("vec_id").alias("query_id"), "qid").join(best, "qid")
    answers = answers.where(F.col("query_id") != F.col("vec_id"))
    place = F.row_number().over(Window.partitionBy("query_id", "qid").orderBy(*order))
    return answers.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of_block(candidates: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best candidates of each query in a block, with ties at the last place.

    A product matrix finds them up to rounding; their scores are then computed pair by
    pair on the original vectors, so that a pair scores the same in every block.
    """
    columns = ["qid", "vec_id", "score"]
    if not len(candidates) or not len(asked):
        return pd.DataFrame({c: pd.Series(dtype="float64" if c == "score" else "int64") for c in columns})
    ids, names = candidates["vec_id"].to_numpy(), asked["qid"].to_numpy()
    rows, wanted = unit_rows(candidates["v"]), unit_rows(asked["v"])
    raw, raw_wanted = (np.stack(t["v"].to_numpy()).astype(np.float64) for t in (candidates, asked))
    found = []
    for low in range(0, len(wanted), 512):
        near = wanted[low : low + 512] @ rows.T
        if len(ids) > k:
            limit = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k, None] - 1e-9
        else:
            limit = np.full((len(near), 1), -np.inf)
        query, candidate = np.nonzero(near >= limit)
        query += low
        found.append(pd.DataFrame({"qid": names[query], "vec_id": ids[candidate], "score": cosine(raw_wanted[query], raw[candidate])}))
    return pd.concat(found)[columns]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the rows of two matrices; rows whose squares leave the range of doubles are scaled first."""
    sums = [(x * y).sum(axis=1) for x, y in ((a, b), (a, a), (b, b))]
    score = sums[0] / (np.sqrt(sums[1]) * np.sqrt(sums[2]))
    extreme = ~((sums[1] > 1e-280) & (sums[1] < 1e280) & (sums[2] > 1e-280) & (sums[2] < 1e280))
    if extreme.any():
        u, w = (x[extreme] / np.abs(x[extreme]).max(axis=1, keepdims=True) for x in (a, b))
        score[extreme] = (u * w).sum(axis=1) / (np.sqrt((u * u).sum(axis=1)) * np.sqrt((w * w).sum(axis=1)))
    return score
