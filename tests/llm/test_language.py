"""Language identification: held-out accuracy, and the parse against a plain search."""

import random

import pytest

import __spark_entry__ as entry
from tablewright.llm import language
from tests.conftest import SF


def test_held_out_accuracy(spark):
    got = entry.queries()["op5_language"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 30
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in got.collect())


def phrases(sample, text):
    """Longest matches by plain search, restarting at every segment."""
    count = 0
    for low in range(0, len(text), language.SEGMENT):
        part, at = text[low : low + language.SEGMENT], 0
        while at < len(part):
            end = at + 1
            while end < len(part) and part[at : end + 1] in sample and part[at] in sample:
                end += 1
            at, count = end, count + 1
    return count


@pytest.mark.parametrize("full", [1 << 25, 0])
def test_parse_equals_plain_search(monkeypatch, full):
    monkeypatch.setattr(language, "SEGMENT", 16)
    monkeypatch.setattr(language, "FULL_ENTRIES", full)
    rng = random.Random(5)
    sample = "".join(rng.choices("abc", k=60)) + "d"
    model = language.Parser((("x", sample), ("y", "abab")))
    texts = ["".join(rng.choices("abcd", k=rng.randrange(1, 70))) for _ in range(40)] + ["dq", "qq", ""]
    count, lengths, letters = model.phrases(texts)
    for text, row in zip(texts, count):
        assert row.tolist() == [phrases(sample, text), phrases("abab", text)]
    assert lengths.tolist() == [len(t) for t in texts]
    assert letters.tolist() == [bool(t) for t in texts]


def test_odd_rows(spark):
    rows = [
        (1, None, "en"), (2, "", "en"), (3, "12 -- !", None), (4, "the cat and the dog", "en"),
        (5, "der Hund und die Katze", "de"), (5, "der Hund und die Katze", "de"), (None, "the dog", "en"),
        (6, "中文", None), (7, "the the cat and dog " * 50_000, None), (8, "ὈΔΥΣΣΕΎΣ İ", None),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, score int, Lang_pred string")
    samples = language.learn(df)
    assert [name for name, _ in samples] == ["de", "en"]
    found = language.identify(df, samples)
    assert found.columns == ["doc_id", "lang", "lang_pred", "score"]
    by_id = [(r["doc_id"], r["lang_pred"]) for r in found.collect()]
    assert sorted(by_id, key=str)[:5] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de")]
    assert (7, "en") in by_id and (None, "en") in by_id and by_id.count((5, "de")) == 2
    assert dict(by_id)[6] in ("de", "en")
    nothing = language.learn(df.limit(0))
    assert nothing == ()
    assert {tuple(r) for r in language.identify(df, nothing).select("lang_pred", "score").collect()} == {("und", 0.0)}
    assert language.identify(df.limit(0), samples).count() == 0


def test_one_language(spark):
    df = spark.createDataFrame([(1, "the cat sat", "en")], "doc_id long, text string, lang string")
    row = language.identify(df, language.learn(df)).first()
    assert row["lang_pred"] == "en" and row["score"] > 0.5


@pytest.mark.parametrize("full", [1 << 25, 0])
def test_two_languages_of_one_script_with_thousands_of_letters(monkeypatch, full):
    monkeypatch.setattr(language, "FULL_ENTRIES", full)
    rng = random.Random(9)
    script = [chr(0x4E00 + i) for i in range(2000)]
    words = [["".join(rng.sample(script, 2)) for _ in range(1500)] for _ in range(2)]
    samples = tuple((name, " ".join(rng.choices(own, k=5000))) for name, own in zip("ab", words))
    texts = ["".join(rng.choices(words[i % 2], k=20)) for i in range(400)]
    names, scores = [], []
    language.answer(language.Parser(samples), texts, names, scores)
    assert names == ["a", "b"] * 200 and min(scores) > 0


def test_hundreds_of_languages(spark):
    rng = random.Random(4)
    own = {f"l{i:03d}": ["".join(rng.choices("abcdefghij", k=5)) for _ in range(12)] for i in range(300)}
    rows = [(i, " ".join(words * 2), name) for i, (name, words) in enumerate(own.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language.learn(df)
    assert len(samples) == 300
    got = language.identify(df, samples).collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)
