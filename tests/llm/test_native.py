"""Chat formatting, quality rules, mixing and sharding against brute force and on odd rows."""

import random
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tablewright.llm import chat, mixing, quality, sharding
from tests.conftest import SF

NODES = "tree long, node long, parent long, role string, text string, score double"


def all_branches(rows):
    """Root-to-leaf paths of every tree by plain recursion, with their scores."""
    children, known = defaultdict(list), {(r[0], r[1]) for r in rows}
    for r in rows:
        children[r[0], r[2] if (r[0], r[2]) in known else None].append(r)
    found, stack = [], [(r,) for (tree, parent), own in children.items() if parent is None for r in own]
    while stack:
        path = stack.pop()
        below = children.get((path[-1][0], path[-1][1]), [])
        stack += [(*path, r) for r in below]
        if not below:
            found.append(path)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_branches_of_random_trees(spark, seed):
    rng = random.Random(seed)
    rows = []
    for tree in (0, 1, None):
        for node in range(40):
            parent = rng.choice([None, 99, *range(max(0, node - 3), node)]) if node else None
            rows.append((tree, node, parent, rng.choice("ua"), f"t{node}", rng.choice([None, 1.0, 2.0])))
    rows += [(5, 1, 2, "u", "", 1.0), (5, 2, 1, "u", "", 1.0), (5, 3, 2, "u", "", 1.0)]  # a cycle
    rows += [(6, n, n - 1, "u", "", 0.0) for n in range(1, 70)]  # a long chain
    df = spark.createDataFrame(rows, NODES)
    paths = defaultdict(list)
    for r in sorted(chat.branches(df, None).collect(), key=lambda r: r["depth"]):
        paths[r["tree"], r["leaf"]].append(r["node"])
    want = {(p[-1][0], p[-1][1]): [r[1] for r in p] for p in all_branches(rows)}
    assert dict(paths) == want
    best = {(r["tree"], r["leaf"]) for r in chat.branches(df, 1).where("depth = 1").collect()}
    scores = defaultdict(list)
    for p in all_branches(rows):
        scores[p[0][0]].append((-sum(r[5] or 0 for r in p), p[-1][1]))
    assert best == {(tree, min(own)[1]) for tree, own in scores.items()}


TEXTS = ["", "a", "</s>", "<\\/s>", "[INST]x[/INST]", "\\[INST]", "[\\\\INST]", "<s", "<", "[", "\n</s>\n", "<<s>>", "é😀</s>"]


def test_format_is_reversible(spark):
    rng = random.Random(1)
    rows = [(i, t, rng.choice(["user", "assistant", "</s>", "", None]), rng.choice([None, *TEXTS])) for i in range(60) for t in range(4)]
    rows += [(99, None, "user", "x"), (99, 1, "user", "b"), (99, 1, "assistant", "a"), (99, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "c long, turn long, role string, text string, node int, tree int")
    formatted = chat.format_branches(chat.chains(df, "c", "turn", "role", "text"))
    read = formatted.select(
        "tree", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted"
    )
    want = defaultdict(list)
    for c, turn, role, text in rows:
        want[c].append((turn is not None, turn or 0, role or "", text or ""))
    for r in read.collect():
        turns = [t[2:] for t in sorted(want.pop(r["tree"]))]
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["loss"] == [text for role, text in turns if role == "assistant"]
        assert r["formatted"].count("</s>") == len(turns)
    assert not want
    assert chat.format_branches(chat.chains(df.limit(0), "c", "turn", "role", "text")).count() == 0


def test_quality_of_odd_rows(spark):
    words = " ".join(f"w{i} the" for i in range(40))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, words), (4, words), (None, words), (5, "a b c a b c"), (6, "é É x\n\nq\nq"), (7, words * 2000)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n_words int, verdict string, __words int")
    found = {(r["doc_id"], (r["text"] or "")[:9]): r for r in quality.judge(df).collect()}
    assert len(found) == 8
    assert found[5, "a b c a b"]["m"]["n_repeat_words"] == 6 and found[1, ""]["m"]["n_words"] == 0
    odd = found[6, "é É x\n\nq\nq"[:9]]["m"]
    assert (odd["n_words"], odd["word_chars"], odd["n_dup_lines"], odd["n_capitals"]) == (4, 6, 1, 1)
    assert found[4, words[:9]]["verdict"]["kept"] and found[None, words[:9]]["verdict"]["kept"]
    assert found[7, words[:9]]["verdict"]["base_failed"] and found[2, ""]["verdict"]["base_failed"]
    assert quality.judge(df).where("verdict.kept").count() == 3  # a filter above does not change the plan below
    assert quality.judge(df.limit(0)).count() == 0


def check_shards(rows, got, n):
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], n)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    want = Counter((k, len((t or "").encode()) + 1, crc32((t or "").encode())) for k, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    homes = defaultdict(set)
    for r in got:
        homes[r["doc_id"]].add((r["shard"], r["grown_shard"]))
    assert all(len(h) == 1 for h in homes.values())


def test_shards_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_shards(rows, entry.queries()["op8_shards"](spark, SF).collect(), 8)


def test_shards_of_odd_rows(spark, tmp_path):
    rows = [(i, f"t{i}") for i in range(300)] + [(None, None), (None, "x"), (1, "t1"), (1, "other")] + [(7, "hot")] * 150
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, shard int, part int").repartition(6)
    check_shards(rows, sharding.shard_by_key(df, "doc_id", "text", [1.0] * 5).collect(), 5)
    assert sharding.shard_by_key(df.limit(0), "doc_id", "text", [1.0]).count() == 0
    weights = spark.range(20000).select(sharding.rendezvous([F.col("id")], [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    assert abs({r["s"]: r["count"] for r in weights}[1] - 15000) < 400
    with pytest.raises(ValueError):
        sharding.rendezvous([F.col("id")], [1.0, 0.0])
    plain = df.drop("shard", "part")
    sharding.write_shards(plain, "doc_id", [1.0] * 3, str(tmp_path / "s"), 2)
    assert spark.read.parquet(str(tmp_path / "s")).drop("shard").exceptAll(plain).count() == 0


def test_mix_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 10)
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([0, 5, 100]), f"{rng.getrandbits(128):032x}") for i in range(300)]
    rows += [(1000, "c", 4000, "f" * 32), (1001, "d", None, "0" * 32), (1, "a", 5, "e" * 32), (1, "a", 5, "e" * 32)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, source string, size long, order string, weight int")
    got = mixing.place(df).collect()
    assert len(got) == len(rows)
    taken, target, starts = Counter(), {}, defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["position"] is None) == (r["taken"] == 0)
        assert r["position"] is None or 0 <= r["position"] <= 1
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        starts[r["source"]].append((r["start"], r["size"]))
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    for own in starts.values():
        at = 0
        for start, size in sorted(own):
            assert start == at
            at += size
    assert sorted(map(str, got)) == sorted(map(str, mixing.place(df.repartition(7)).collect()))
    assert mixing.place(df.limit(0)).count() == 0


def test_mixing_with_columns_of_its_own_names(spark):
    own = [*mixing.ADDED, "n_rows", "source_key", "bucket", "bucket_start", "within", "rest", "row", "one", "copy", "due", "rank"]
    rows = [(f"s{i % 3}" if i % 7 else None, i % 50, f"{i * 2654435761 % 2**32:08x}", *[f"{c}{i}" for c in own]) for i in range(200)]
    schema = "source string, size long, `order` string, " + ", ".join(f"`{c}` string" for c in own)
    df = spark.createDataFrame(rows, schema)
    plain = mixing.place(df.select("source", "size", "order"))
    found = mixing.place(df)
    stays = [c for c in own if c not in mixing.ADDED]
    assert sorted(found.columns) == sorted([*mixing.GIVEN, *stays, *mixing.ADDED])
    assert sorted(found.select(plain.columns).collect(), key=str) == sorted(plain.collect(), key=str)
    by_order = {r[2]: dict(zip(own, r[3:])) for r in rows}
    assert all(r[c] == by_order[r["order"]][c] for r in found.collect() for c in stays)
    order = mixing.training_order(found)
    assert [tuple(r) for r in order.select("order", "copy", "due").collect()] == [
        tuple(r) for r in mixing.training_order(plain).select("order", "copy", "due").collect()
    ]
    assert order.first()["one"].startswith("one") and mixing.place(df.limit(0)).count() == 0
