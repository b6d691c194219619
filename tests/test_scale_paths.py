"""The ways taken beyond the size bounds, on small data with tiny bounds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions import lookup, quantiles
from tablewright.functions.lookup import lookup_join
from tablewright.functions.quantiles import column_quantiles, quantile_table
from tablewright.functions.ranking import dense_codes
from tablewright.functions.values import most_frequent, text_counts
from tablewright.operators import charts, features
from tests.conftest import SF, rows

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """One group and one value hold a third of the rows each."""
    rng = np.random.default_rng(5)
    n = 6000
    pdf = pd.DataFrame(
        {
            "g": np.where(np.arange(n) % 3 == 0, "hot", [f"g{i % 17}" for i in range(n)]),
            "heavy": rng.lognormal(0, 3, n),
            "repeated": np.where(np.arange(n) % 3 == 1, 7.0, rng.normal(0, 1, n).round(2)),
            "whole": rng.integers(-5, 6, n),
        }
    )
    pdf.loc[::11, "heavy"] = np.nan
    return pdf, spark.createDataFrame(pdf).repartition(6)


def test_column_quantiles_by_buckets(skewed):
    pdf, df = skewed
    got = column_quantiles(df, ["heavy", "repeated", "whole"], PROBABILITIES, in_task_rows=0)
    for name, values in got.items():
        np.testing.assert_allclose(values, pdf[name].quantile(PROBABILITIES), rtol=1e-12)
    small = column_quantiles(df, ["heavy", "repeated", "whole"], PROBABILITIES)
    for name in got:
        np.testing.assert_allclose(got[name], small[name], rtol=1e-12)


@pytest.mark.parametrize("lookup_limit", [lookup.SMALL_ROWS, 0])
def test_grouped_quantiles_by_buckets(skewed, monkeypatch, lookup_limit):
    pdf, df = skewed
    monkeypatch.setattr(lookup, "SMALL_ROWS", lookup_limit)
    got = {
        (r["g"], r["column"]): (r["n"], r["quantiles"])
        for r in quantile_table(df, ["heavy", "repeated"], PROBABILITIES, ["g"], in_task_rows=0).collect()
    }
    expected = pdf.groupby("g")[["heavy", "repeated"]]
    assert len(got) == 2 * pdf["g"].nunique()
    for (group, name), (n, values) in got.items():
        one = expected.get_group(group)[name]
        assert n == one.count()
        np.testing.assert_allclose(values, one.quantile(PROBABILITIES), rtol=1e-12)


def test_no_task_sorts_more_than_the_limit(spark, monkeypatch, limit=40):
    """Values over 600 orders of magnitude, so that one cut is not enough; half of the rows in one group."""
    monkeypatch.setattr(quantiles, "FIRST_CELLS", 2)
    monkeypatch.setattr(quantiles, "GRID", 8)
    rng = np.random.default_rng(9)
    n = 4000
    x = np.sign(rng.normal(size=n)) * 10.0 ** rng.uniform(-300, 300, n)
    x[:40], x[40:60], x[60:1300] = np.inf, -np.inf, 12.5
    pdf = pd.DataFrame({"n": np.where(np.arange(n) % 2 == 0, "hot", [f"g{i % 5}" for i in range(n)]), "value": x})
    pdf = pdf.sample(frac=1, random_state=1)
    df = spark.createDataFrame(pdf.rename(columns={"value": "x"})).repartition(4)
    largest, levels = [], []
    plain_sort, plain_cut = quantiles._sorted_cells, quantiles._cut_again

    def sorted_cells(rows, cells, keys):
        joined = rows.join(cells.select(*keys, *quantiles._CELL), [*keys, *quantiles._CELL])
        largest.extend(r["count"] for r in joined.groupBy(*keys, *quantiles._CELL).count().collect())
        return plain_sort(rows, cells, keys)

    monkeypatch.setattr(quantiles, "_sorted_cells", sorted_cells)
    monkeypatch.setattr(quantiles, "_cut_again", lambda *a: levels.append(1) or plain_cut(*a))
    shares = [0.0, 0.2, 0.5, 0.9, 1.0]
    table = quantile_table(df.withColumnRenamed("n", "g"), ["x"], shares, ["g"], in_task_rows=limit)
    got = {r["g"]: (r["n"], r["quantiles"]) for r in table.collect()}
    assert max(largest, default=0) <= limit and len(levels) >= 2
    for group, values in pdf.groupby("n")["value"]:
        ordered = np.sort(values.to_numpy())
        assert got[group][0] == len(ordered)
        for p, value in zip(shares, got[group][1]):
            place = p * (len(ordered) - 1)
            low, high = ordered[int(np.floor(place))], ordered[int(np.ceil(place))]
            part = place - np.floor(place)
            wanted = low if part == 0 else (1 - part) * low + part * high
            assert value == wanted or abs(value - wanted) <= 1e-12 * abs(wanted)


def test_quantiles_of_awkward_columns(spark):
    inf = float("inf")
    df = spark.createDataFrame(
        [(1.0, None, -inf, 3.0), (2.0, None, 0.0, 3.0), (float("nan"), None, inf, 3.0)],
        "a double, empty double, b double, same double",
    )
    got = column_quantiles(df, df.columns, [0.0, 0.5, 1.0], in_task_rows=0)
    assert got["a"] == [1.0, 1.5, 2.0] and got["empty"] is None
    assert got["b"] == [-inf, 0.0, inf] and got["same"] == [3.0, 3.0, 3.0]


def test_box_and_violin_do_not_depend_on_the_way(spark, monkeypatch):
    events = spark.read.parquet(f"{SF}/events.parquet")
    box, violin = charts.box_stats(events, "value", "event_type"), charts.violin_stats(events, "event_type", "value")
    expected = rows(box), rows(violin), rows(charts.box_outliers(events, "value", "event_type"))
    monkeypatch.setattr(quantiles, "IN_TASK_ROWS", 0)
    monkeypatch.setattr(lookup, "SMALL_ROWS", 0)
    got = (
        rows(charts.box_stats(events, "value", "event_type")),
        rows(charts.violin_stats(events, "event_type", "value")),
        rows(charts.box_outliers(events, "value", "event_type")),
    )
    for left, right in zip(got, expected):
        assert len(left) == len(right)
        for a, b in zip(left, right):
            assert a[0] == b[0]
            np.testing.assert_allclose(a[1:], b[1:], rtol=1e-9)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_lookup_join_ways_agree(spark, how):
    big = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 100 == 1, None).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("v"),
    )
    derived = spark.range(0, 2000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    wanted = rows(big.join(derived, ["k"], how))
    assert rows(lookup_join(big, derived, ["k"], how)) == wanted
    assert rows(lookup_join(big, derived, ["k"], how, limit=0)) == wanted


def test_tables_of_long_texts_are_not_small(spark):
    short = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    long = short.union(spark.createDataFrame([("x" * 1000, 3)], "k string, v int"))
    assert [tuple(r) for r in lookup.small_rows(short)] == [("a", 1), (None, 2)]
    assert lookup.small_rows(short, 1) is None and lookup.small_rows(long) is None
    big = spark.createDataFrame([("a",), ("x" * 1000,), ("b",)], "k string")
    assert rows(lookup_join(big, long, ["k"])) == [("a", 1), ("x" * 1000, 3)]


def test_dense_codes_ways_agree(spark):
    values = spark.range(5000).select(F.concat(F.lit("v"), F.col("id") % 700).alias("s")).repartition(5)
    values = values.union(spark.createDataFrame([("Ä",), ("",), (None,)], "s string"))
    small, large = dense_codes(values, "s", "code"), dense_codes(values, "s", "code", limit=10)
    assert small.few and not large.few
    assert rows(small.table) == rows(large.table)
    got = large.table.orderBy("code").collect()
    assert [r["s"] for r in got] == sorted(r["s"] for r in got) and [r["code"] for r in got] == list(range(702))
    assert {r["s"] for r in large.hot} == {f"v{i}" for i in range(700)}  # 7 or 8 of 5002 rows each


def test_only_frequent_values_are_hot(spark):
    values = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("s"))
    codes = dense_codes(values, "s", "code", limit=10)
    assert [r["s"] for r in codes.hot] == ["hot"]
    joined = codes.join(values.union(spark.createDataFrame([(None,)], "s string")), "s", "c")
    assert joined.where("c IS NULL").count() == 1 and joined.count() == 9001
    assert joined.where("s = 'hot'").select("c").distinct().first()[0] == 6000


def test_label_encoding_ways_agree(spark):
    df = spark.range(900).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, None).otherwise(F.col("id").cast("string")).alias("k")
    )
    small, _ = features.label_encode(df, ["k"])
    large, classes = features.label_encode(df, ["k"], limit=5)
    assert rows(small) == rows(large)
    back = features.label_decode(large, classes, limit=5)
    assert rows(back) == rows(df.fillna("None", ["k"]))


def test_value_counts_over_several_blocks(spark):
    wide = spark.range(40).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(40)])
    counts = text_counts(wide, wide.columns)
    for i in (0, 5, 31, 32, 39):
        assert counts.where(F.col("column") == f"c{i}").count() == i + 1
    assert most_frequent(wide, wide.columns)["c39"] == ("0", 1)
    assert most_frequent(wide, wide.columns)["c0"] == ("0", 40)


def test_long_and_short_value_lists_behave_alike(spark):
    from tablewright.operators.filters import OneOf

    df = spark.createDataFrame([("x", 1), ("y", 2)], "a string, k bigint")
    for values in ([1, 5], [1, *range(10, 3000)], ["1", "5"], ["1", *map(str, range(10, 3000))]):
        kept = OneOf("k", values).apply(df)
        assert kept.columns == ["a", "k"] and rows(kept) == [("x", 1)]


def test_groups_without_values_stay_in_both_ways(spark):
    from tablewright.functions.quantiles import quantile_table

    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "g string, x double")
    small, large = (quantile_table(df, ["x"], [0.5], ["g"], in_task_rows=n) for n in (100, 1))
    assert small.columns == large.columns and rows(small) == rows(large)
    assert ("b", "x", 0) in [tuple(r)[:3] for r in large.collect()]


def test_one_hot_has_no_bound(spark):
    from tablewright.operators import features

    assert len(features.one_hot(spark.range(1100), ["id"]).columns) == 1100


def test_numbers_as_text(spark):
    from tablewright.functions.columns import text_form

    values = [1.0, 12345678.0, 1.5e15, 1.2345678e7, 0.0001234, -2.5e8, 1e16, 1e-5, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(text_form(df.schema["x"])).collect()]
    assert got == ["1.0", "12345678.0", "1500000000000000.0", "12345678.0", "0.0001234", "-250000000.0", "1.0E16", "1.0E-5", None, None]


def test_codes_are_no_numbers(spark):
    from tablewright.sources.csv import infer_types

    df = spark.createDataFrame([("10D", "1e3", "7"), ("20F", ".5", "8")], "a string, b string, c string")
    assert [f.dataType.simpleString() for f in infer_types(df).schema] == ["string", "double", "bigint"]


def test_several_statements_are_refused(spark):
    import pytest
    from pyspark.errors import PySparkException

    from tablewright.operators.sqltext import sql_select

    assert sql_select(spark.range(3), "SELECT * FROM df WHERE id > 0;").count() == 2
    with pytest.raises((ValueError, PySparkException)):
        sql_select(spark.range(3), "SELECT 1; DROP TABLE x")


@pytest.mark.parametrize("collide", [False, True])
@pytest.mark.parametrize("lookup_limit", [lookup.SMALL_ROWS, 0])
def test_duplicates_by_fingerprint(spark, monkeypatch, collide, lookup_limit):
    from tablewright.operators import cleaning

    monkeypatch.setattr(lookup, "SMALL_ROWS", lookup_limit)
    if collide:  # four fingerprints for all rows: whole rows have to decide
        few = lambda df: [F.pmod(F.col("id"), F.lit(40)), F.lit(0).cast("long")]
        monkeypatch.setattr(cleaning, "_fingerprint", few)
    nan = float("nan")
    plain = [(i, float(i), f"k{i}", None) for i in range(60)]
    twice = [(100, 0.0, None, "x"), (100, -0.0, None, "x"), (101, nan, "a", None), (101, None, "a", None)] + [(102, 1.5, "b", "c")] * 9
    apart = [(103, None, "a", "b"), (103, None, "b", "a"), (104, None, None, "a"), (104, None, "a", None)]
    df = spark.createDataFrame(plain + twice + apart, "id long, x double, k string, l string").repartition(5)
    assert rows(cleaning.duplicate_groups(df, True)) == rows(cleaning.duplicate_groups(df))
    assert cleaning.duplicate_count(df, True).first()[0] == 13
    assert rows(cleaning.duplicate_rows(df, True)) == rows(cleaning.duplicate_rows(df))
    assert rows(cleaning.drop_duplicates(df, True)) == rows(cleaning.drop_duplicates(df)) and cleaning.drop_duplicates(df, True).count() == 67
    mostly = df.where("id > 99")  # most rows are repeated
    assert rows(cleaning.duplicate_groups(mostly, True)) == rows(cleaning.duplicate_groups(mostly))
    assert cleaning.drop_duplicates(df.limit(0), True).count() == 0


def test_fingerprints_keep_whole_rows_out_of_the_shuffle(spark, capsys):
    from tablewright.operators import cleaning

    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    capsys.readouterr()
    cleaning.drop_duplicates(lines.unionByName(lines.limit(5)), True).explain("formatted")
    text = capsys.readouterr().out
    stays = text[: text.index("BroadcastHashJoin") if "BroadcastHashJoin" in text else 0]
    assert "Union" in text and stays.count("Exchange hashpartitioning") == 0


def test_hot_keys_of_long_text_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lookup, "SMALL_ROWS", 0)
    long_key = "k" * 5000
    big = spark.createDataFrame([(long_key, i) for i in range(30)] + [("short", i) for i in range(30)] + [(None, 1)], "k string, v int")
    derived = spark.createDataFrame([(long_key, 1), ("short", 2)], "k string, w int")
    assert [r["k"] for r in lookup._hot_keys(big.where("k is not null"), ["k"])] == ["short"]
    joined = lookup.lookup_join(big, derived, ["k"], "left")
    assert {(r["w"], r["count"]) for r in joined.groupBy("w").count().collect()} == {(1, 30), (2, 30), (None, 1)}


def test_many_repeated_rows_shuffle_no_whole_rows(spark, monkeypatch, capsys):
    """However many fingerprints occur twice, and however many of them share a bit."""
    from tablewright.operators import cleaning

    monkeypatch.setattr(lookup, "SMALL_ROWS", 10)
    df = spark.range(3000).selectExpr("id", "concat('k', id) AS k").repartition(4)
    df = df.unionByName(df.where("id % 10 = 0"))
    for most in (cleaning.MOST_BITS, 1 << 10):
        monkeypatch.setattr(cleaning, "MOST_BITS", most)
        assert cleaning.duplicate_groups(df, True).count() == 300
        found = cleaning.drop_duplicates(df, True)
        assert found.count() == 3000 and found.distinct().count() == 3000
        capsys.readouterr()
        cleaning.duplicate_groups(df, True).explain()
        assert "Join" not in capsys.readouterr().out
