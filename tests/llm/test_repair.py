"""Repair of conversations: plain recursion over whole conversations, exhaustive search on short ones."""

import collections
import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import __spark_entry__ as entry
import pytest
from tablewright.llm import queries, repair
from tests.conftest import SF
from tests.oracle import difference, duck

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, result = set(), []
    for role, text in rows:
        last = text.rstrip(BLANKS)[-1:]
        if not last:
            result.append("blank")
        elif (role, text) in seen:
            result.append("duplicate")
        elif last not in ".!?":
            result.append("truncated")
        else:
            result.append("")
        seen.add((role, text))
    return result


def cheapest(rows):
    """Cost, audit and repaired rows from a recursion over suffixes that compares texts."""
    bad = faults(rows)

    @lru_cache(maxsize=None)
    def best(i, last, inserted):
        offers = []
        if inserted < 2:
            c, a, _ = best(i, NEXT[last], inserted + 1)
            offers.append((c + 2, "I" + a, (i, NEXT[last], inserted + 1, (FULL[NEXT[last]], ""))))
        if i == len(rows):
            if last in ("", "a"):
                offers.append((0, "", None))
            return min(offers, default=(10**9, "Z", None))
        (role, text), fault = rows[i], bad[i]
        c, a, _ = best(i + 1, last, 0)
        offers.append((c + 3, "D" + a, (i + 1, last, 0, None)))
        if fault not in ("blank", "duplicate"):
            late = 1 if fault == "truncated" else 0
            if role[:1] == NEXT[last] or (role[:1] == "s" and last == ""):
                c, a, _ = best(i + 1, role[:1], 0)
                offers.append((c + late, "K" + a, (i + 1, role[:1], 0, (role, text))))
            c, a, _ = best(i + 1, NEXT[last], 0)
            offers.append((c + late + 2, "R" + a, (i + 1, NEXT[last], 0, (FULL[NEXT[last]], text))))
        return min(offers, key=lambda o: o[:2])

    for i in range(len(rows), -1, -50):  # keeps the recursion shallow
        for last in NEXT:
            best(max(i, 0), last, 0)
    cost, audit, step = best(0, "", 0)
    out = []
    while step is not None:
        i, last, inserted, row = step
        out += [row] if row else []
        step = best(i, last, inserted)[2]
    return cost, audit, out


def brute_force(rows_by_conv, every):
    result = {}
    for conv in every:
        rows = sorted(rows_by_conv.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        plain = [(role, text) for _, role, text in rows]
        turns = [t for t, _, _ in rows if t is not None]
        kinds = collections.Counter(faults(plain))
        cost, audit, out = cheapest(plain)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        result[conv] = (gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, digest)
    return result


def damaged(rows):
    result = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        damage = zlib.crc32(key.encode()) % 20
        if damage == 1:
            text = ""
        elif damage == 2:
            text = re.sub("[.!?]", "", text)
        elif damage == 4:
            role = "user"
        if damage:
            result[conv] += [(turn, role, text)] * (2 if damage == 3 else 1)
    return result


def query_rows(spark, path):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = entry.queries()["op12_repair"](spark, path).collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in found}


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert query_rows(spark, SF) == brute_force(damaged(rows), {r[0] for r in rows})


def odd_rows():
    rng = random.Random(5)
    texts = ["Yes.", "No", "What?", "", " \n", None, "Yes. \t", "ok!", " ", "x."]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = [(rng.randrange(150), rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts)) for _ in range(900)]
    rows += [(None, t, r, "Hi.") for t, r in enumerate(["system", "user", "assistant", "user"])]
    rows += [(777, 0, "user", "x" * 100_000 + "."), (777, 1, "assistant", "y" * 100_000), (888, None, "user", None)]
    rows += [(999, 5, "user", "same.")] * 700  # one row repeated
    return rows + [(1000, t, ("user", "assistant")[rng.randrange(2)], f"Line {t % 900}.") for t in range(2500)]


@pytest.mark.parametrize("segment_rows", [3, 256])
def test_odd_rows_and_long_conversations(spark, tmp_path, monkeypatch, segment_rows):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", segment_rows)
    rows = odd_rows()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.selectExpr("*", "1 AS conv", "2 AS copies", "'x' AS audit").repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    assert query_rows(spark, str(tmp_path)) == brute_force(damaged(rows), {r[0] for r in rows})


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_given_conversations_against_sql(spark, sf):
    assert difference(entry.queries()["op12_repair"](spark, sf), duck(sf), entry.oracle_sql()["op12_repair"]) is None


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert query_rows(spark, str(tmp_path)) == {}


def test_recursion_against_every_sequence_of_edits():
    """All audits up to seven letters over all conversations of up to three rows."""
    kinds = [("user", "a."), ("assistant", "b"), ("system", "c."), ("user", "")]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            cost, audit, _ = cheapest(list(rows))
            bad, options = faults(rows), []
            for length in range(n, n + 5):
                for letters in itertools.product("DIKR", repeat=length):
                    if sum(x != "I" for x in letters) != n:
                        continue
                    last, spent, i = "", 0, 0
                    for x in letters:
                        if x == "I":
                            last, spent = NEXT[last], spent + 2
                            continue
                        role, fault = rows[i][0][0], bad[i]
                        i += 1
                        if x == "D":
                            spent += 3
                        elif fault in ("blank", "duplicate"):
                            break
                        else:
                            spent += (fault == "truncated") + (2 if x == "R" else 0)
                            if x == "K" and not (role == NEXT[last] or (role == "s" and last == "")):
                                break
                            last = role if x == "K" else NEXT[last]
                    else:
                        if last in ("", "a"):
                            options.append((spent, "".join(letters)))
            assert min(options) == (cost, audit)


def test_damage_is_by_key(spark):
    rows = [(c, t, "user", "Fine. So?") for c in range(30) for t in range(3)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = collections.defaultdict(list)
    for r in queries.damaged(frame).collect():
        found[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    assert {c: sorted(v) for c, v in found.items()} == {c: sorted(v) for c, v in damaged(rows).items()}
