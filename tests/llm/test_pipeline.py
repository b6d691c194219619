"""The pipeline against brute force, stage by stage, and over odd rows."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tablewright.llm import language, mixing
from tablewright.llm.common import stored
from tests.conftest import SF
from tests.llm.test_neardup import brute_force
from tests.llm.test_tokens import BYTE, library
from tests.oracle import duck


@pytest.fixture(scope="module")
def stages(spark):
    """The input of every stage, and the result."""
    found = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        found.append(stored(stage(spark, found[-1], SF), "stage"))
    return found


def test_stages_keep_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "language ID", "near duplicates", "mixing", "packing",
    ]
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_quality(stages):
    verdicts = duck(SF).sql(entry.oracle_sql()["op2_quality_rules"]).df()
    assert sorted(r[0] for r in stages[1].select("doc_id").collect()) == sorted(verdicts[verdicts["kept"]]["doc_id"])


def test_language(stages):
    before, after = ({r["doc_id"] for r in df.collect()} for df in stages[1:3])
    assert after <= before and len(after) >= 0.99 * len(before)


def test_near_duplicates(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    groups = {component for _, _, component in brute_force(rows, corpus_pipeline.NEAR_PERCENT)}
    assert sorted(r["doc_id"] for r in stages[3].collect()) == sorted(groups)


def test_mixing(stages):
    sizes, longest = collections.Counter(), collections.Counter()
    for r in stages[3].collect():
        n = len(r["text"].split())
        sizes[r["source"]] += n
        longest[r["source"]] = max(longest[r["source"]], n)
    left, weights, targets = sum(sizes.values()), {}, {}
    for i, source in enumerate(sorted(sizes)):
        weights[source] = (5, 2, 1)[i % 3]
    while weights:  # plain rounds of capping
        level = left / sum(weights.values())
        above = [s for s, w in weights.items() if w * level > 3 * sizes[s]]
        for s in above or list(weights):
            targets[s] = 3 * sizes[s] if above else weights[s] * level
            left -= targets[s] if above else 0
            del weights[s]
    taken, seen = collections.Counter(), collections.Counter()
    for r in stages[4].collect():
        taken[r["source"]] += len(r["text"].split())
        seen[r["doc_id"]] += 1
    assert all(abs(taken[s] - targets[s]) <= longest[s] / 2 + 1 for s in targets)
    assert max(seen.values()) <= 3


def test_packing(stages):
    docs = collections.Counter((r["doc_id"], r["text"]) for r in stages[4].collect())
    tokens = sum(n * (len(ids) + 1) for n, ids in zip(docs.values(), library(BYTE, [t for _, t in docs])))
    pieces = stages[5].collect()
    assert sum(p["length"] for p in pieces) == tokens
    filled = collections.Counter()
    for p in pieces:
        filled[p["sequence_id"]] += p["length"]
    assert max(filled.values()) <= 2048


def test_run_equals_stages(spark, stages):
    rows = entry.queries()["pipeline"](spark, SF).select("doc_id", "start", "length", "ids_crc32").collect()
    want = stages[5].select("doc_id", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want))


LONG = "the dog and the cat of the house were in a tree while it rained on them for days " * 5
MIXED = " ".join(f"the {a}{b} of" for a in "abcdefgh" for b in "uvwxyz")


def test_odd_rows(spark):
    rows = [
        (1, None, "en", "a"), (2, "", None, None), (3, MIXED, "en", "a"), (3, MIXED, "en", "a"), (4, MIXED, None, None),
        (None, MIXED + " more words here", "en", None), (5, "# " * 200, None, "b"), (6, MIXED * 400, "en", "b"), (7, LONG, "en", "c"),
    ]
    columns = "doc_id long, text string, lang string, source string, row int, size int, score int, m int, verdict int, due int"
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], columns)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, df, SF)
        assert found.columns == df.columns
        found.collect()
        assert stage(spark, df.limit(0), SF).count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.keep_quality(spark, df, SF).collect()} == {3, 4, None}
    one = corpus_pipeline.keep_one_of_each(spark, df, SF).collect()
    assert sorted(str(r["doc_id"]) for r in one) == ["1", "2", "3", "5", "7"]
    corpus_pipeline.pack(spark, df, SF).collect()


def test_no_labels_teach_nothing(spark):
    df = spark.createDataFrame([(1, "the dog", None)], "doc_id long, text string, lang string")
    assert language.learn(df) == ()
    assert corpus_pipeline.keep_languages(spark, df, SF).count() == 0


def test_curriculum_order(spark):
    rows = [(f"{s}{i}", s, 10, f"{i * 7919 % 100000:08x}") for s in "ab" for i in range(50)]
    placed = mixing.place(
        spark.createDataFrame(rows, "id string, source string, size long, order string"),
        mixing.MixRules(weights=(1, 1), tilts=(1.0, -1.0)),
    )
    got = [r["id"][0] for r in mixing.training_order(placed).collect()]
    assert len(got) == 100 and got[:50].count("a") > 30 > got[50:].count("a") + 5
    due = [r["due"] for r in mixing.training_order(placed).collect()]
    assert due == sorted(due) and 0 <= due[0] and due[-1] <= 1
    assert placed.agg(F.sum("taken")).first()[0] == 1000


def test_near_duplicates_from_80_percent(spark):
    rows = []
    for group in range(30):
        words = [f"w{group}x{i}" for i in range(204)]
        # One changed word changes 5 of 200 shingles: 0.905 for two of them, 0.818 for four, 0.778 for five.
        for n in (0, 4, 5) if group % 2 else (0, 4):
            copy = list(words)
            for k in range(n):
                copy[20 + 40 * k if n == 4 else 10 + 35 * k] = f"other{group}n{n}k{k}"
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = sorted({component for _, _, component in brute_force(rows, 80)})
    assert wanted != sorted({component for _, _, component in brute_force(rows)})
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, df, SF).collect()) == wanted


def test_close_languages_stay(spark):
    english, german = "the dog and the cat of the house", "der Hund und die Katze aus dem Haus"
    rows = [(1, english, "en"), (2, german, "de"), (4, "12 -- !", "en"), (5, "\u4e2d\u6587 " * 60, None)]
    rng = random.Random(3)
    rows += [(10 + n, " ".join(rng.choices(english.split() + german.split(), k=150)), None) for n in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.identify(df, language.learn(df)).where("doc_id >= 10").collect()
    close = {r["doc_id"] for r in found if 0 < r["score"] < 0.02}
    kept = {r["doc_id"] for r in corpus_pipeline.keep_languages(spark, df, SF).collect()}
    assert close and kept >= close and kept >= {1, 2} and not kept & {4, 5}
