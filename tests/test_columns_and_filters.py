from datetime import date, datetime

import pytest
from pyspark.errors import ParseException, PySparkException
from pyspark.sql import functions as F

from tablewright import Dataset
from tablewright.operators import columns, filters
from tablewright.operators.sqltext import sql_select
from tests.conftest import SF, rows


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_roles(spark, quirks):
    frame = quirks.withColumns({"t": F.lit("2024-01-01").cast("timestamp"), "list": F.array(F.lit(1))})
    assert columns.column_roles(frame) == {
        "numeric": ["id", "x", "constant", "empty", "odd.name"],
        "categorical": ["k", "list"],
        "datetime": ["t"],
        "boolean": ["b"],
    }
    assert columns.time_columns(frame) == ["t"]


def test_rename_ignores_unknown_and_rejects_empty(quirks):
    assert columns.rename_columns(quirks, {"k": "key", "nope": "z"}).columns[2] == "key"
    with pytest.raises(ValueError):
        columns.rename_columns(quirks, {"k": ""})


def test_strict_and_lenient_casts(spark):
    df = spark.createDataFrame([("1",), ("x",), ("1.7",), (None,), ("",)], "s string")
    with pytest.raises(PySparkException):
        columns.change_types(df, {"s": "int"}).collect()
    lenient = columns.change_types(df, {"s": "float"}, mode="lenient")
    assert [r["s"] for r in lenient.collect()] == [1.0, None, 1.7, None, None]
    truth = columns.change_types(df, {"s": "bool"})
    assert [r["s"] for r in truth.collect()] == [True, True, True, None, False]
    with pytest.raises(ValueError):
        columns.change_types(df, {"s": "complex"})


def test_datetime_casts(spark):
    df = spark.createDataFrame([(date(1970, 1, 2), datetime(1970, 1, 1, 0, 0, 1, 5))], "d date, t timestamp_ntz")
    row = columns.change_types(df, {"d": "int", "t": "float64"}).first()
    assert row["d"] == 86_400_000_000_000 and row["t"] == 1_000_005_000.0
    with pytest.raises(ValueError):
        columns.change_types(df, {"t": "bool"})


def test_numeric_range_drops_missing(quirks):
    assert ids(filters.numeric_range(quirks, "x", 1.0, 4.0)) == [1, 4]
    assert ids(filters.numeric_range(quirks, "odd.name", 10, 11)) == [1, 5]


def test_one_of(quirks):
    assert ids(filters.one_of(quirks, "k", [])) == [1, 2, 3, 4, 5]
    assert ids(filters.one_of(quirks, "k", ["a"])) == [1, 2]
    many = ["a"] + [f"v{i}" for i in range(3000)]
    assert ids(filters.one_of(quirks, "k", many)) == [1, 2]
    assert filters.one_of(quirks, "k", many).columns[0] in quirks.columns


def test_date_range_keeps_the_whole_last_day(spark):
    df = spark.createDataFrame(
        [(1, datetime(2024, 1, 31, 23, 59, 59, 500_000)), (2, datetime(2024, 2, 1)), (3, None), (4, datetime(2024, 1, 1))],
        "id int, t timestamp_ntz",
    )
    assert ids(filters.date_range(df, "t", date(2024, 1, 1), date(2024, 1, 31))) == [1, 4]
    text = df.withColumn("t", F.col("t").cast("string")).union(spark.createDataFrame([(5, "no date")], "id int, t string"))
    assert ids(filters.date_range(text, "t", date(2024, 1, 1), date(2024, 1, 31))) == [1, 4]
    days = df.withColumn("t", F.col("t").cast("date"))
    assert ids(filters.date_range(days, "t", date(2024, 2, 1), date(2024, 2, 1))) == [2]


def test_boolean(quirks):
    assert ids(filters.is_bool(quirks, "b", None)) == [1, 2, 3, 4, 5]
    assert ids(filters.is_bool(quirks, "b", False)) == [2]


def test_text_search(spark):
    df = spark.createDataFrame(
        [(1, "John", 1.5), (2, "johnny", 2.0), (3, None, 3.0), (4, "a.b", 4.0), (5, "axb", float("nan"))],
        "id int, s string, v double",
    )
    assert ids(filters.text_search(df, "john")) == [1, 2]
    assert ids(filters.text_search(df, "john", case=True)) == [2]
    assert ids(filters.text_search(df, "a.b")) == [4, 5]
    assert ids(filters.text_search(df, "a.b", literal=True)) == [4]
    assert ids(filters.text_search(df, "1.5", ["v"])) == [1]
    assert ids(filters.text_search(df, "nan")) == []
    assert ids(filters.text_search(df, "")) == [1, 2, 3, 4, 5]
    assert ids(filters.text_search(df, "^j.*y$")) == [2]
    assert ids(filters.text_search(df, "JOHN|AXB")) == [1, 2, 5]
    assert ids(filters.text_search(df, "x", [])) == []


def test_literal_search_with_quote_markers(spark):
    df = spark.createDataFrame([(1, r"a\Eb"), (2, "ab")], "id int, s string")
    assert ids(filters.text_search(df, r"a\Eb", literal=True)) == [1]


@pytest.mark.parametrize(
    "text",
    [
        "DROP TABLE df",
        "INSERT INTO df VALUES (1)",
        "EXPLAIN SELECT * FROM df",
        "SELECT 1; DROP TABLE x",
        "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a",
        "-- note\nCREATE TABLE t (a int)",
        "selection",
        "SELECT nothing FROM df",
    ],
)
def test_sql_refuses_all_but_queries(spark, quirks, text):
    with pytest.raises((ValueError, PySparkException)):
        sql_select(quirks, text).collect()
    with pytest.warns(UserWarning):
        assert sql_select(quirks, text, on_error="original") is quirks
    assert not spark.catalog.tableExists("t")


def test_sql_view_does_not_leak(spark, quirks):
    spark.range(3).createOrReplaceTempView("df")
    picked = sql_select(quirks, "/* all */ -- of\n SELECT id FROM df WHERE x > 1 -- last")
    assert spark.table("df").count() == 3
    spark.catalog.dropTempView("df")
    assert ids(picked) == [4, 5]  # NaN counts as missing
    assert not any(t.name == "df" for t in spark.catalog.listTables())
    assert sql_select(quirks, "  ") is quirks
    assert sql_select(quirks, "WITH a AS (SELECT id FROM df) SELECT count(*) AS n FROM a").first()["n"] == 5


def test_sql_keeps_order(quirks):
    got = sql_select(quirks, "SELECT id FROM df ORDER BY id DESC LIMIT 3").collect()
    assert [r["id"] for r in got] == [5, 4, 3]
    assert [r["id"] for r in sql_select(quirks, "SELECT id FROM df ORDER BY id DESC").collect()] == [5, 4, 3, 2, 1]


def test_summary(quirks):
    keep = [filters.NumericRange("x", 0, 10), filters.OneOf("k", ["a", "b"])]
    assert tuple(filters.filter_summary(quirks, keep).first()) == (5, 2, 40.0)
    assert tuple(filters.filter_summary(quirks.limit(0), keep).first()) == (0, 0, 0.0)
    assert filters.summary_message(5, 5) == "Showing all 5 rows"
    assert filters.summary_message(2000, 500) == "Filtered: 500 / 2,000 rows (25.0%)"
    assert filters.summary_message(0, 0) == "Showing all 0 rows"


def test_domains(spark, quirks):
    found = {r["column"]: r for r in filters.filter_domains(quirks).collect()}
    assert (found["x"]["min_value"], found["x"]["max_value"]) == ("1.0", "100.0")
    assert found["k"]["choices"] == ["a", "b"] and found["b"]["choices"] == ["false", "true"]
    assert found["empty"]["min_value"] is None
    wide = spark.range(200).select(F.col("id").cast("string").alias("many"), (F.col("id") % 50).cast("string").alias("few"))
    found = {r["column"]: r["choices"] for r in filters.filter_domains(wide).collect()}
    assert found["many"] is None and len(found["few"]) == 50


def test_dataset_outlives_a_session(spark, quirks, tmp_path):
    assert Dataset.restore(spark, str(tmp_path), "kept") is None
    Dataset.of(quirks).filter([filters.OneOf("k", ["a"])]).save(str(tmp_path), "kept")
    assert ids(Dataset.restore(spark, str(tmp_path), "kept").filtered) == [1, 2, 3, 4, 5]


def test_dataset_versions(quirks):
    data = Dataset.of(quirks)
    filtered = data.filter([filters.OneOf("k", ["a"])], sql="SELECT * FROM df WHERE id < 5")
    assert ids(filtered.filtered) == [1, 2] and ids(filtered.clean) == [1, 2, 3, 4, 5]
    featured = filtered.engineered(lambda df: df.withColumn("twice", F.col("id") * 2))
    assert "twice" in featured.model.columns and "twice" not in featured.filtered.columns
    assert ids(featured.reset_filters().filtered) == [1, 2, 3, 4, 5]
    cleaned = featured.cleaned(lambda df: df.drop("x"))
    assert cleaned.base.columns == cleaned.model.columns == cleaned.filtered.columns == cleaned.clean.columns
    assert "x" not in cleaned.clean.columns


def test_sql_text_reads_the_table_only(spark):
    df = spark.range(5)
    spark.range(3).createOrReplaceTempView("other")
    for text in ("SELECT * FROM other", "SELECT * FROM df WHERE id IN (SELECT id FROM other)", f"SELECT * FROM parquet.`{SF}/part.parquet`"):
        with pytest.raises(ValueError):
            sql_select(df, text)
    spark.catalog.dropTempView("other")
    assert sql_select(df, "WITH a AS (SELECT id FROM df), b AS (SELECT * FROM a) SELECT * FROM b JOIN a USING (id);").count() == 5
    with pytest.raises(Exception):
        sql_select(df, "SELECT 1; DROP TABLE x").collect()


def test_summary_of_a_chain_with_sql_text(spark):
    got = filters.filter_summary(spark.range(10), [filters.NumericRange("id", 0, 5)], "SELECT * FROM df WHERE id % 2 = 0")
    assert tuple(got.first()) == (10, 3, 30.0)


@pytest.fixture
def secret(spark, tmp_path):
    spark.createDataFrame([(1, "hidden")], "id int, word string").createOrReplaceTempView("secret")
    path = f"{tmp_path}/file"
    spark.table("secret").write.parquet(path)
    yield path
    spark.catalog.dropTempView("secret")


@pytest.mark.parametrize(
    "text",
    [
        "with secret as (select * from secret) select * from secret",
        "select '== Analyzed Logical Plan ==' as t, word from parquet.`{path}`",
        "with a as (select 1 as x), b as (select * from secret) select * from a",
        "with b as (select * from a), a as (select * from df) select * from b",
        "select * from (with inner_one as (select * from df) select * from inner_one) q, inner_one",
        "select id, (select max(word) from secret) as w from df",
        "select id from df where exists (select 1 from secret s where s.id = df.id)",
        "select id from df where id in (with df as (select * from secret) select id from df)",
        "select * from df, lateral (select word from secret)",
        "select * from identifier('sec' || 'ret')",
        "select identifier('reflect')('java.lang.System', 'getProperty', 'user.dir') from df",
        "select reflect('java.lang.System', 'getProperty', 'user.dir') as d from df",
        "select java_method('java.lang.System', 'getProperty', 'user.dir') as d from df",
        "select transform(id) using 'cat' as (x) from df",
        "select * from df version as of 3",
        "select * from spark_catalog.default.df",
        "table secret",
        "with recursive t(n) as (select 1 union all select n + 1 from t, secret where n < 3) select * from t",
    ],
)
def test_sql_reads_df_only(spark, quirks, secret, text):
    with pytest.raises((ValueError, ParseException)):
        sql_select(quirks, text.format(path=secret))


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("""select "'UnresolvedRelation [zz]" as t, id from df where id = 1""", [("'UnresolvedRelation [zz]", 1)]),
        ("select '== Analyzed Logical Plan ==' as t from df where id < 2", [("== Analyzed Logical Plan ==",)]),
        ("with secret as (select id + 1 as id from df) select * from secret where id = 3", [(3,)]),
        ("with df as (select id from df where id > 3) select * from df", [(4,), (5,)]),
        ("with a as (select id from df), b as (with a as (select id from a where id = 2) select * from a) select * from b", [(2,)]),
        ("with A as (select id from DF) select count(*) as n from a", [(5,)]),
        ("select id from df where id in (with a as (select max(id) as m from df) select m from a)", [(5,)]),
        ("with recursive t(n) as (select 1 union all select n + 1 from t where n < 3) select n from t", [(1,), (2,), (3,)]),
        ("select k, n from (select k, count(*) as n from df group by k having count(*) > 1) order by k", [("a", 2), ("b", 2)]),
        ("select id, v from df lateral view explode(array(1, 2)) e as v where id = 1", [(1, 1), (1, 2)]),
        ("select d.id from df d join (values (2), (3)) v(id) on d.id = v.id", [(2,), (3,)]),
        ("select id from df where id > 3 limit all", [(4,), (5,)]),
        ("select * from df |> where id > 3 |> select id |> order by id", [(4,), (5,)]),
        ("select k, id from df group by grouping sets ((k), (id)) having k = 'a' or id = 1", [("a", None), (None, 1)]),
        ("select id, v from df unpivot (v for n in (x, x as y)) where id = 1", [(1, 1.0), (1, 1.0)]),
        ("select '{\"a\": 1}' as j, id from df where id = 5", [('{"a": 1}', 5)]),
    ],
)
def test_sql_scopes_and_texts(quirks, secret, text, wanted):
    assert rows(sql_select(quirks, text)) == wanted


def test_sql_leaves_a_view_called_df_alone(spark, quirks):
    spark.range(3).createOrReplaceTempView("df")
    result = sql_select(quirks, "select id from df where id > 3")
    assert spark.table("df").count() == 3 and rows(result) == [(4,), (5,)]
    assert [t.name for t in spark.catalog.listTables(pattern="df*")] == ["df"]
    spark.catalog.dropTempView("df")
