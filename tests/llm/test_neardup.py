"""Near duplicates against brute force over all pairs."""

import random
import re

import pytest

import __spark_entry__ as entry
from tablewright.llm import neardup
from tests.conftest import SF


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute_force(rows, percent=85):
    """id, size of the set and component of each row, from all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    owners = {}
    for i, own in enumerate(sets):
        for shingle in own:
            owners.setdefault(shingle, []).append(i)
    seen = set()
    for i, own in enumerate(sets):
        for j in {j for shingle in own for j in owners[shingle] if j < i}:
            shared = len(own & sets[j])
            if 100 * shared >= percent * (len(own) + len(sets[j]) - shared):
                seen.add((i, j))
    for i, j in seen:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    smallest = {r: min((k for k in keys if k is not None), default=None) for r, keys in groups.items()}
    result = []
    for i, (key, _) in enumerate(rows):
        component = smallest[find(i)]
        result.append((key, len(sets[i]), key if component is None else component))
    return result


def ordered(found):
    return sorted(found, key=str)


def ours(df):
    return ordered(tuple(r)[:3] for r in neardup.near_duplicates(df).collect())


def families(seed, n=60):
    """Copies of a few texts with random edits, so that many similarities lie near the threshold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(6):
        base = rng.choices(words, k=rng.choice([6, 30, 120]))
        for _ in range(n // 6):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                copy = copy[rng.randrange(3) :]
            rows.append((rng.choice(" \n\t").join(copy)).title() if rng.random() < 0.2 else " ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = entry.queries()["op7_near_duplicates"](spark, SF).collect()
    assert ordered((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == ordered(brute_force(rows))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_families_with_small_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 4)
    monkeypatch.setattr(neardup, "BLOCK_COLUMNS", 16)
    rows = families(seed)
    assert ours(spark.createDataFrame(rows, "doc_id long, text string")) == ordered(brute_force(rows))


ODD = [
    (1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "É one two three four five"),
    (8, "é one two three four five"), (9, "x " * 70_000 + "end"), (10, "X " * 70_000 + "end"), (None, "a b c d e f"),
    (None, "a b c d e f"), (12, "A B C D E F"), (None, "only null key"), (13, "same row"), (13, "same row"),
    (13, "other text of this key"), (14, "a\x00 b"), (15, "a b"), (16, "ab\xa0c d"), (17, "ab c d"),
]


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in ODD], "doc_id long, text string, n int, bands string")
    assert ours(df) == ordered(brute_force(ODD))
    assert ours(df.limit(0)) == []


def test_one_row_of_each_group_stays(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in ODD], "doc_id long, text string, row int, component string")
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = ordered((r["doc_id"], r["text"]) for r in kept.collect())
    gone = [(5, "ONE"), (10, "X " * 70_000 + "end"), (None, "a b c d e f"), (None, "a b c d e f"), (13, "same row")]
    want = [r for r in ODD]
    for row in gone:
        want.remove(row)
    assert got == ordered(want)


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 50), (101, 50), (102, 101)]
    found = dict(neardup.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert found == {i: 0 for i in range(41)} | {50: 50, 100: 50, 101: 50, 102: 50}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_sets_share_buckets():
    rng = random.Random(3)
    missed = 0
    for _ in range(300):
        size = rng.choice([20, 40, 200])
        base = [str(rng.random()) for _ in range(size)]
        other = list(base)
        while True:
            trial = list(other)
            trial[rng.randrange(size)] = str(rng.random())
            a, b = shingle_set(" ".join(base)), shingle_set(" ".join(trial))
            if 100 * len(a & b) < 85 * len(a | b):
                break
            other = trial
        keys = [set(neardup.band_keys(neardup.shingles(" ".join(t))).tolist()) for t in (base, other)]
        missed += not keys[0] & keys[1]
    assert missed == 0
