"""Quality rules: a threshold table compiled into one projection, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import words_of

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it on as with was by at from be this or are "
    "der die das und in zu den ist mit von auf für ein eine als dem des nicht "
    "le la les de des et en un une du que est dans pour par sur au qui "
    "el la los las de y en que un una por con para del se es al"
).split()


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule when ``ratio`` is below ``least`` or above ``most``.

    ``ratio`` names measures: one, or ``a / b``, which is 0 where ``b`` is 0.
    """

    name: str
    ratio: str
    least: float | None = None
    most: float | None = None


BASE_RULES = (
    Rule("too_short", "n_words", least=50),
    Rule("repetitive", "n_repeat_words / n_words", most=0.5),
)

RULES = (
    Rule("symbols", "n_symbols / n_words", most=0.1),
    Rule("shouting", "n_capitals / word_chars", most=0.5),
    Rule("marks", "n_marks / n_words", most=0.5),
    Rule("word_length", "word_chars / n_words", least=1.5, most=30),
    Rule("stop_words", "n_stop_words", least=1),
    Rule("same_lines", "n_dup_lines / n_lines", most=0.5),
)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the column ``m``, a struct of all measures of the whole text.

    A null text has no words and measures 0 everywhere.  Repeated words are those in
    a three-word window that occurs twice or more in the text: the windows are sorted
    by a hash and then by their words, equal neighbours are repeats, and the positions
    they cover are counted once.  Cost grows with n log n in the words of a text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    with_word = F.filter(F.split(whole, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    split = docs.withColumn("__words", words_of(F.col(text))).withColumn("__lines", with_word)
    words = F.col("__words")

    def window(first: Column, place: Column) -> Column:
        second, third = F.get(words, place + 1), F.get(words, place + 2)
        return F.struct(
            F.xxhash64(first, second, third).alias("hash"),
            first.alias("a"),
            second.alias("b"),
            third.alias("c"),
            place.alias("at"),
        )

    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    split = split.withColumn("__windows", F.sort_array(F.transform(starts, window)))
    windows = F.col("__windows")
    pairs = F.greatest(F.size(windows) - 1, F.lit(0))

    def repeated(one: Column, two: Column) -> Column:
        same = (one["hash"] == two["hash"]) & (one["a"] == two["a"]) & (one["b"] == two["b"]) & (one["c"] == two["c"])
        return F.when(same, F.array(one["at"], two["at"]))

    twice = F.zip_with(F.slice(windows, F.lit(1), pairs), F.slice(windows, F.lit(2), pairs), repeated)
    split = split.withColumn("__twice", F.flatten(F.array_compact(twice)))
    covered = F.flatten(F.transform("__twice", lambda at: F.array(at, at + 1, at + 2)))
    stop_words = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])

    def count(pattern: str) -> Column:
        return F.regexp_count(whole, F.lit(pattern)).cast("long")

    found = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(covered)).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        count(r"\p{Lu}").alias("n_capitals"),
        count(r"[!?]").alias("n_marks"),
        F.size(F.array_intersect(words, stop_words)).cast("long").alias("n_stop_words"),
    )
    # Exploding one struct keeps a later filter on a measure above it; pushed below, it
    # would repeat the whole computation inside its own lambdas.
    return split.withColumn("m", F.explode(F.array(found))).drop("__words", "__lines", "__windows", "__twice")


def breaks(rule: Rule) -> Column:
    names = [part.strip() for part in rule.ratio.split("/")]
    value = F.col(f"m.{names[0]}")
    if len(names) == 2:
        value = F.coalesce(F.try_divide(value.cast("double"), F.col(f"m.{names[1]}").cast("double")), F.lit(0.0))
    tests = [value < F.lit(rule.least)] if rule.least is not None else []
    tests += [value > F.lit(rule.most)] if rule.most is not None else []
    return reduce(Column.__or__, tests, F.lit(False))


def judge(
    docs: DataFrame, text: str = "text", base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """``docs`` with ``m`` (measures) and ``verdict``: ``base_failed, kept, broken``.

    ``broken`` lists the names of the broken rules.  Columns named ``m``, ``verdict``
    or like a work column (``__words``...) are replaced; every other column stays.
    Equal rows are judged alike, an empty table stays empty.
    """
    measured = measures(docs, text)
    failed = reduce(Column.__or__, [breaks(r) for r in base], F.lit(False))
    broken = F.array_compact(F.array(*[F.when(breaks(r), F.lit(r.name)) for r in (*base, *rules)]))
    verdict = F.struct(failed.alias("base_failed"), (F.size(broken) == 0).alias("kept"), broken.alias("broken"))
    return measured.withColumn("verdict", verdict)
