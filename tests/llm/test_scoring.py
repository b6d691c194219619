"""Recurrent language model: gradients, plain recurrence, whole scores and held-out likelihood."""

import collections
import math
import zlib

import __spark_entry__ as entry
import numpy as np
from pyspark.sql import functions as F
from tablewright.llm import gru, scoring
from tests.conftest import SF

BLANKS = " \t\n\x0b\x0c\r"


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in BLANKS[1:]:
        lowered = lowered.replace(blank, " ")
    return [w for w in lowered.split(" ") if w] + [""]


def base(rows, train):
    """n_tokens, n_known, N and base score of each text by plain counting."""
    counts = collections.Counter(w for text, learned in zip(rows, train) if learned for w in words_of(text))
    total, distinct = sum(counts.values()), len(counts)
    for text in rows:
        words = words_of(text)
        score = math.fsum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        yield len(words), sum(counts[w] > 0 for w in words), total, score


def same(found, wanted):
    assert found[:3] == wanted[:3] and abs(found[3] - wanted[3]) <= 1e-9 * max(1, abs(wanted[3]))


def test_given_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held_out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    wanted = dict(zip(texts, base(texts.values(), [not held_out[i] for i in texts])))
    rows = entry.queries()["op11_score"](spark, SF).collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == held_out and len(rows) == len(texts)
    for r in rows:
        same((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]), wanted[r["doc_id"]])
    test = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)


def step(p, layout, state, before, token):
    """One token after the other, as the formulas stand."""
    h = gru.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    given, pulled = p["inputs"][before] + p["gates"][0], state @ p["recurrent"]
    update, reset = sigmoid(given[:h] + pulled[:h]), sigmoid(given[h : 2 * h] + pulled[h : 2 * h])
    state = (1 - update) * state + update * np.tanh(given[2 * h :] + reset * pulled[2 * h :])
    soft = lambda x: np.exp(x) / np.exp(x).sum()
    own = int(layout.class_of(np.array([token]))[0])
    chance = soft(p["to_class"] @ state + p["class_bias"][:, 0])[own]
    if token < layout.frequent:
        low = own * gru.CLASS_TOKENS
        high = min(low + gru.CLASS_TOKENS, layout.frequent)
        chance *= soft(p["to_token"][low:high] @ state + p["token_bias"][low:high, 0])[token - low]
    return state, math.log(chance)


def small_model(frequent=70, rare=3):
    rng = np.random.default_rng(0)
    layout = gru.Layout(frequent, rare)
    p = gru.initial(layout, rng.integers(1, 90, layout.inputs))
    for name in ("to_class", "to_token", "gates"):
        p[name] = rng.normal(size=p[name].shape).astype(np.float32)
    return layout, p, rng


def test_state_is_carried_over_windows_lanes_and_texts(monkeypatch):
    layout, p, rng = small_model()
    lengths = np.array([1, 100, 7, 333, 1, 40])
    end = 5
    tokens = rng.integers(0, layout.inputs, lengths.sum()).astype(np.int32)
    tokens[np.cumsum(lengths) - 1] = end
    wanted, low = [], 0
    for n in lengths:
        state, before, total = np.zeros(gru.HIDDEN), end, 0.0
        for token in tokens[low : low + n].tolist():
            state, log = step(p, layout, state, before, token)
            before, total = token, total + log
        wanted.append(total)
        low += n
    for lanes in (1, 2, 512):
        monkeypatch.setattr(gru.Lanes.__init__, "__defaults__", (lanes,))
        assert np.allclose(gru.Model(layout, p).score(tokens, lengths), wanted, rtol=1e-4)


def test_probabilities_sum_to_one():
    layout, p, rng = small_model()
    hidden = rng.normal(size=(1, gru.HIDDEN)).astype(np.float32)
    every = np.arange(layout.inputs)
    logs = gru.Model(layout, p).log_probabilities(np.repeat(hidden, len(every), axis=0), every)
    assert abs(np.exp(logs).sum() - 1) < 1e-5


def test_gradients_against_differences(monkeypatch):
    layout, p, rng = small_model(70, 2)
    monkeypatch.setattr(gru, "CLIP", 1e9)
    lengths = np.array([9, 16])
    tokens = rng.integers(0, layout.inputs, lengths.sum()).astype(np.int32)
    tokens[np.cumsum(lengths) - 1] = 3
    got = {}

    class Watched(gru.Trainer):
        def _move(self, name, rows, gradient):
            got.setdefault(name, np.zeros(self.p[name].shape))[rows] += gradient

    Watched(layout, p).train(tokens, lengths)
    loss = lambda q: -gru.Model(layout, q).score(tokens, lengths).sum() / (gru.WINDOW * len(lengths))
    p = {k: v.astype(np.float64) for k, v in p.items()}
    for name in p:
        worth = np.argwhere(np.abs(got[name]) > 2e-3)
        for place in rng.permutation(worth)[:6]:
            place, size = tuple(place), 1e-2
            values = []
            for sign in (1, -1):
                q = {k: v.copy() for k, v in p.items()}
                q[name][place] += sign * size
                values.append(loss(q))
            slope = (values[0] - values[1]) / (2 * size)
            assert abs(slope - got[name][place]) < 0.05 * abs(slope) + 2e-4, (name, place)


def test_training_learns_an_order():
    layout = gru.Layout(20, 1)
    tokens = np.tile(np.arange(10, dtype=np.int32), 400)
    lengths = np.full(40, 100)
    p = gru.initial(layout, np.bincount(tokens, minlength=21))
    trainer = gru.Trainer(layout, p)
    before = gru.Model(layout, p).score(tokens, lengths).mean()
    for _ in range(20):
        trainer.train(tokens, lengths)
    assert trainer.score(tokens, lengths).mean() > 0.2 * before


def test_words_outside_the_dictionary(spark, monkeypatch):
    monkeypatch.setattr(scoring, "DICTIONARY_WORDS", 12)
    monkeypatch.setattr(scoring, "FREQUENT_WORDS", 5)
    long_word = "w" * 300
    texts = ["the cat sat on the mat", "The CAT \x0b ate\x0cthe É é hat", None, "", " \n", "a b c d e f g the cat sat", long_word, "new words only here"]
    texts += [f"the cat number{i} {long_word}" for i in range(30)] + ["same text the"] * 40 + ["the " * 20_000]
    rows = [(i if i % 5 else None, t, i % 9 != 1, 7, "x", 0.5) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, learn boolean, n_tokens int, `row` string, score double"
    df = spark.createDataFrame(rows, schema).repartition(3)
    found = scoring.score(df, "text", F.col("learn")).collect()
    by_text = collections.defaultdict(list)
    for r, wanted in zip(rows, base([r[1] for r in rows], [r[2] for r in rows])):
        by_text[(r[0], r[2])].append(wanted)
    got = collections.defaultdict(list)
    for r in found:
        assert (r["row"]["n_tokens"], r["row"]["row"], r["row"]["score"]) == (7, "x", 0.5) and r["score"] < 0
        got[(r["row"]["doc_id"], r["row"]["learn"])].append((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]))
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in by_text.items()}
    for key, values in got.items():
        for a, b in zip(sorted(values), sorted(by_text[key])):
            same(a, b)


def test_all_words_together_have_probability_one(spark, monkeypatch):
    """One-word texts: over every word, an unknown one and the end, first-token chances add up to one."""
    monkeypatch.setattr(scoring, "DICTIONARY_WORDS", 8)
    monkeypatch.setattr(scoring, "FREQUENT_WORDS", 4)
    words = [f"w{i}" for i in range(20)]
    train = [(True, " ".join(words[: 1 + i % 20])) for i in range(60)]
    probes = [(False, w) for w in words] + [(False, "never"), (False, "")]
    schema = "learn boolean, text string"
    df = spark.createDataFrame(train + probes, schema).coalesce(1)
    found = scoring.score(df.withColumn("copy", F.col("text")), "text", F.col("learn")).where("not row.learn").collect()
    texts = {r["row"]["copy"]: r["score"] for r in found}
    two = spark.createDataFrame(train + [(False, f"{w} {v}") for w in ["w0"] for v in [*words, "never"]] + [(False, "w0")], schema).coalesce(1)
    second = scoring.score(two.withColumn("copy", F.col("text")), "text", F.col("learn")).where("not row.learn").collect()
    assert len(texts) == 22 and len(second) == 22 and all(s < 0 for s in texts.values())
    # A text's chance is at most that of its first words; all texts of one word and its end stay below one.
    assert sum(10**s for s in texts.values()) < 1
    assert sum(10 ** r["score"] for r in second if r["row"]["copy"] != "w0") < 1


def test_counts_are_handed_over_in_portions(monkeypatch):
    monkeypatch.setattr(scoring, "COUNTED_WORDS", 3)
    texts = [b"a b c d", b"A a", b"", b"b\x0bc e"]
    batch = scoring.pa.RecordBatch.from_arrays([scoring.pa.array(texts, scoring.pa.binary())], ["text"])
    parts = [part.to_pylist() for part in scoring._count(iter([batch, batch]))]
    total = collections.Counter()
    for part in parts:
        total.update({r["word"]: r["n"] for r in part})
    assert len(parts) > 2 and total == {b"a": 6, b"b": 4, b"c": 4, b"d": 2, b"e": 2, b"": 8}


def test_nothing_to_learn_from_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    found = {r["row"]["doc_id"]: r for r in scoring.score(df, "text", F.lit(False)).collect()}
    plain = {i: (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for i, r in found.items()}
    assert plain == {1: (3, 0, 0, 0.0), 2: (1, 0, 0, 0.0)}
    assert all(abs(r["score"]) < 1e-6 for r in found.values())
    assert scoring.score(df.where("doc_id > 5"), "text", F.lit(True)).collect() == []


def test_every_text_learned_from_gives_gradients(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(scoring, "_train_round", lambda texts, sent, parameters: seen.extend(r["text"] for r in texts.collect()))
    df = spark.createDataFrame([(i, f"text {i} of some") for i in range(80)], "i int, text string")
    scoring.score(df, "text", F.col("i") < 60)
    assert sorted(bytes(t).decode() for t in seen) == sorted(f"text {i} of some" for i in range(60))


def test_tokens_of_many_texts_at_once():
    """Arrow cuts whole columns; words, ends, ranks and words outside are those of each text by itself."""
    texts = ["", " ", " a  B\x0bc\x0c\x1cd \x85 É\r\n", "İ x y   z", "a\0b \0 a a", "w0 w1 W0 new new"]
    data = [*[t.encode() for t in texts], b"\xff\xfe Q \xc3"]
    wanted = [[*t.lower().split(), b""] for t in data]
    assert [[w.decode() for w in words] for words in wanted[: len(texts)]] == [words_of(t) for t in texts]
    dictionary = [b"", b"a", b"w0", "É".encode()]
    for known in (dictionary, []):
        task = scoring._Task(b" ".join(known), np.arange(len(known), 0, -1), 20, 9, 4)
        for kind in (scoring.pa.binary(), scoring.pa.large_binary()):
            tokens = scoring.Tokens.of(scoring.pa.array([b"not mine", *data], kind).slice(1))
            ranks = task.ranks_of(tokens)
            places = [known.index(w) if w in known else len(known) for words in wanted for w in words]
            assert tokens.lengths.tolist() == [len(words) for words in wanted] and ranks.tolist() == places
            beyond = scoring._beyond(tokens, ranks == len(known)).to_pylist()
            counts = [collections.Counter(w for w in words if w not in known) for words in wanted]
            assert [{r["word"]: r["n"] for r in row} for row in beyond] == counts


def test_far_scores_are_cut_and_near_ones_left(monkeypatch):
    """The cut at ``FARTHEST`` is left out only where no score can reach it; results do not depend on that."""
    layout, p, rng = small_model()
    every = np.arange(layout.inputs)
    for size in (1, 30):
        q = p | {name: p[name] * np.float32(size) for name in ("to_class", "to_token")}
        hidden = np.repeat(np.tanh(rng.normal(size=(1, gru.HIDDEN))).astype(np.float32), len(every), axis=0)
        model = gru.Model(layout, q)
        found = model.log_probabilities(hidden, every)
        assert model._far(np.float32(np.linalg.norm(hidden[0])), "token") == (size == 30)
        with monkeypatch.context() as m:
            m.setattr(gru.Model, "_far", lambda *_: True)
            assert np.array_equal(found, model.log_probabilities(hidden, every))
        assert abs(np.exp(found).sum() - 1) < 1e-4
