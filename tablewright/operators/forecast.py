"""Trend-plus-seasonality forecasts, of days or of single rows.

``forecast`` reduces the table to one row per series and day; what is left of a series
is bounded by the calendar and is fitted in one task per series.

``forecast_rows`` fits the rows themselves, with a season within the day where stamps
carry a time.  A fit needs only the sums of products of the design columns, a matrix of
some sixty columns; these are summed over parts of each series and merged in a tree, so
one series may hold the whole table.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import check_names, number, ref
from tablewright.functions.lookup import lookup_join
from tablewright.session import scratch_path

# The fitting function travels to the executors by value, so they need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bounds and default of the horizon in days, width of the interval.
MIN_PERIODS, MAX_PERIODS, DEFAULT_PERIODS = 1, 365, 30
INTERVAL_Z = 1.2815515655446004  # 80 % of a normal distribution

# Parameters of the additive model (Taylor and Letham, 2018).
CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
CHANGEPOINT_SCALE = 0.05
SEASONALITY_SCALE = 10.0
SEASONS = {"yearly": (365.25, 10, 730), "weekly": (7.0, 3, 14)}  # period, order, days of history needed
WITHIN_DAY = (1.0, 4, 2)  # where stamps carry a time
ROUNDS = 30

STAMPS_PER_PART = 100_000
MERGED_AT_ONCE = 128
DAY_MICROS = 86_400_000_000


def daily_series(
    df: DataFrame, date_column: str, value_column: str, by: list[str] | None = None, aggregation: str = "mean"
) -> DataFrame:
    """``(*by, ds, y, n, within)``: one row per series and day; rows without date or value are left out.

    ``within`` is the sum of squared distances of the day's ``n`` values from their mean.
    """
    if aggregation not in ("mean", "sum"):
        raise ValueError(f"unknown aggregation: {aggregation!r}")
    by = by or []
    rows = df.select(
        *[ref(k) for k in by], ref(date_column).cast("date").alias("ds"), number(df, value_column).alias("y")
    ).where("ds IS NOT NULL AND y IS NOT NULL")
    total = F.avg("y") if aggregation == "mean" else F.sum("y")
    return rows.groupBy(*[ref(k) for k in by], "ds").agg(
        total.alias("y"), F.count("*").alias("n"), (F.var_pop("y") * F.count("*")).alias("within")
    )


def linear_trend(series: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(*by, days, slope, intercept, r2)`` of y over days since 1970-01-01."""
    keys = [ref(k) for k in by or []]
    day = F.unix_date("ds").cast("double")
    return series.groupBy(*keys).agg(
        F.count("*").alias("days"),
        F.regr_slope("y", day).alias("slope"),
        F.regr_intercept("y", day).alias("intercept"),
        F.regr_r2("y", day).alias("r2"),
    )


def forecast(
    df: DataFrame,
    date_column: str,
    value_column: str,
    periods: int = DEFAULT_PERIODS,
    by: list[str] | None = None,
    aggregation: str = "mean",
) -> DataFrame:
    """``(*by, ds, yhat, yhat_lower, yhat_upper)`` for the history and ``periods`` days beyond.

    Piecewise-linear trend whose slope changes are held back by a Laplace prior,
    plus yearly and weekly Fourier terms where the history is long enough.  For means
    the fit and the interval are those of the single rows: their spread within a day
    counts; sums are fitted and bounded day by day.
    """
    if not MIN_PERIODS <= periods <= MAX_PERIODS:
        raise ValueError(f"periods must lie between {MIN_PERIODS} and {MAX_PERIODS}")
    by = by or []
    series = daily_series(df, date_column, value_column, by, aggregation)
    output = T.StructType([series.schema[k] for k in by])
    for name, dtype in (("ds", T.DateType()), ("yhat", T.DoubleType()), ("yhat_lower", T.DoubleType()), ("yhat_upper", T.DoubleType())):
        output = output.add(name, dtype)
    weighted = aggregation == "mean"

    def fit_series(key: tuple, days: pd.DataFrame) -> pd.DataFrame:
        fitted = fit_days(days, periods, weighted)
        for name, value in zip(by, key):
            fitted[name] = value
        return fitted[[*by, "ds", "yhat", "yhat_lower", "yhat_upper"]]

    grouping = [ref(k) for k in by] or [F.lit(0).alias("series")]
    return series.groupBy(*grouping).applyInPandas(fit_series, output)


def _spots(days: np.ndarray) -> np.ndarray:
    """Where the slope may change: evenly over the first part of the days that have rows."""
    places = max(min(CHANGEPOINTS, int(CHANGEPOINT_RANGE * len(days)) - 1), 0)
    if not places:
        return days[:0]
    return days[np.linspace(0, int(CHANGEPOINT_RANGE * len(days)) - 1, places + 1).round().astype(int)[1:]]


def _design(at: np.ndarray, first: float, span: float, spots: np.ndarray, timed: bool) -> np.ndarray:
    """Columns of the model at the given days: level, slope, changes of slope, seasons."""
    t = (at - first) / span
    columns = [np.ones_like(t), t, *[np.maximum(t - (s - first) / span, 0.0) for s in spots]]
    for period, order, needed in [*SEASONS.values(), *([WITHIN_DAY] if timed else [])]:
        if span >= needed:
            for k in range(1, order + 1):
                columns += [np.sin(2 * np.pi * k * at / period), np.cos(2 * np.pi * k * at / period)]
    return np.column_stack(columns)


def _solve(gram: np.ndarray, moment: np.ndarray, noise: float, n_spots: int, spread) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, variance around them and sizes of the slope changes.

    Reweighted least squares: an absolute-value penalty on the slope changes.  ``spread``
    gives the variance around given coefficients.
    """
    changes, size = slice(2, 2 + n_spots), np.full(n_spots, CHANGEPOINT_SCALE)
    for _ in range(ROUNDS):
        penalty = np.full(len(moment), 1 / SEASONALITY_SCALE**2)
        penalty[:2] = 1 / 25.0
        penalty[changes] = 1 / (CHANGEPOINT_SCALE * np.maximum(size, 1e-6))
        beta = np.linalg.solve(gram + noise * np.diag(penalty), moment)
        noise, size = max(spread(beta), 1e-12), np.abs(beta[changes])
    return beta, noise, size


def _half_width(at: np.ndarray, last: float, span: float, noise: float, size: np.ndarray) -> np.ndarray:
    """Half of the interval: slope changes may go on as often and as large as so far."""
    beyond = np.maximum(at - last, 0.0) / span
    drift = len(size) * 2 * (size.mean() if len(size) else 0.0) ** 2 * beyond**3 / 3
    return INTERVAL_Z * np.sqrt(noise + drift)


def fit_days(days: pd.DataFrame, periods: int, weighted: bool) -> pd.DataFrame:
    """Fit one daily series and predict its days and the ``periods`` days after."""
    days = days.sort_values("ds")
    day = pd.to_datetime(days["ds"]).to_numpy().astype("datetime64[D]").astype("int64").astype(float)
    y = days["y"].to_numpy(dtype=float)
    weight = days["n"].to_numpy(dtype=float) if weighted else np.ones_like(y)
    first, span = day[0], max(day[-1] - day[0], 1.0)
    scale, spots = np.abs(y).max() or 1.0, _spots(np.unique(day))

    x, target = _design(day, first, span, spots, False), y / scale
    within = days["within"].sum() / scale**2 if weighted else 0.0
    noise = max(target.var() + within / weight.sum(), 1e-12)
    gram, moment = x.T @ (weight[:, None] * x), x.T @ (weight * target)
    around = lambda beta: (weight @ (target - x @ beta) ** 2 + within) / weight.sum()
    beta, noise, size = _solve(gram, moment, noise, len(spots), around)

    at = np.concatenate([day, day[-1] + np.arange(1, periods + 1)])
    yhat, half = _design(at, first, span, spots, False) @ beta, _half_width(at, day[-1], span, noise, size)
    return pd.DataFrame(
        {
            "ds": (np.datetime64("1970-01-01") + at.astype("int64").astype("timedelta64[D]")).astype("datetime64[ns]"),
            "yhat": yhat * scale,
            "yhat_lower": (yhat - half) * scale,
            "yhat_upper": (yhat + half) * scale,
        }
    ).assign(ds=lambda f: f["ds"].dt.date)


_SERIES = "id string, part long, parts long, first long, last long, scale double, timed boolean, spots array<long>"
_SUMS = f"{_SERIES}, rows double, squares double, moment array<double>, gram array<double>"
_FITTED = f"{_SERIES}, noise double, sizes array<double>, beta array<double>"
_SERIES_COLUMNS = [c.split()[0] for c in _SERIES.split(", ")]


def forecast_rows(
    df: DataFrame,
    date_column: str,
    value_column: str,
    periods: int = DEFAULT_PERIODS,
    by: list[str] | None = None,
) -> DataFrame:
    """``(*by, ds, yhat, yhat_lower, yhat_upper)`` for every stamp of the history and ``periods`` days beyond.

    The model of ``forecast``, fitted to the single rows, and a season within the day for a
    series that has more stamps than days.  ``ds`` is a timestamp without zone; the days beyond
    keep the time of the last stamp.  Rows without date or value are left out; a missing key is
    a series of its own; a table without rows gives none.

    Equal stamps are summed first.  A series of more than ``STAMPS_PER_PART`` stamps is summed
    and predicted in parts, so none of the steps sees a whole one.
    """
    if not MIN_PERIODS <= periods <= MAX_PERIODS:
        raise ValueError(f"periods must lie between {MIN_PERIODS} and {MAX_PERIODS}")
    by = by or []
    check_names(by, ["ds", "yhat", "yhat_lower", "yhat_upper"])
    keys = [ref(k).alias(f"__k{i}") for i, k in enumerate(by)]
    stamp = ref(date_column).cast("timestamp_ntz")
    since = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01'"), stamp)
    identity = F.to_json(F.struct(*keys)) if by else F.lit("")
    rows = df.select(*keys, identity.alias("id"), since.alias("at"), number(df, value_column).alias("y"))
    rows = rows.where("at IS NOT NULL AND y IS NOT NULL")
    first_keys = [F.first(f"__k{i}").alias(f"__k{i}") for i in range(len(by))]
    path = scratch_path(df.sparkSession, "stamps")
    rows.groupBy("id", "at").agg(
        F.count("*").cast("double").alias("n"),
        F.sum("y").alias("total"),
        F.sum(F.col("y") * F.col("y")).alias("squares"),
        F.max(F.abs("y")).alias("largest"),
        *first_keys,
    ).write.parquet(path)
    stamps = df.sparkSession.read.parquet(path)

    days = F.sort_array(F.collect_set(F.floor(F.col("at") / DAY_MICROS)))
    series = stamps.groupBy("id").agg(
        F.min("at").alias("first"),
        F.max("at").alias("last"),
        F.max("largest").alias("scale"),
        days.alias("days"),
        F.count("*").alias("stamps"),
        *first_keys,
    )
    described = series.select(
        "id",
        F.ceil(F.col("stamps") / STAMPS_PER_PART).alias("parts"),
        "first",
        "last",
        F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0).alias("scale"),
        (F.col("stamps") > F.size("days")).alias("timed"),
        F.col("days").alias("spots"),
    )
    in_parts = lookup_join(stamps, described.select("id", "parts"), ["id"])
    in_parts = in_parts.select("id", F.pmod(F.xxhash64("at"), "parts").alias("part"), "at", "n", "total", "squares")
    each_part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    to_sum = described.select("*", each_part).select(*[F.col(c).alias(c) for c in _SERIES_COLUMNS])
    sums = in_parts.groupBy("id", "part").cogroup(to_sum.groupBy("id", "part")).applyInPandas(_part_sums, _SUMS)
    most = described.agg(F.max("parts")).first()[0] or 1
    while most > 1:
        sums = sums.withColumn("part", F.floor(F.col("part") / MERGED_AT_ONCE)).groupBy("id", "part").applyInPandas(_merged, _SUMS)
        most = -(-most // MERGED_AT_ONCE)
    fitted = sums.mapInPandas(_fitted, _FITTED)
    path = scratch_path(df.sparkSession, "fitted")
    fitted.write.parquet(path)
    fitted = df.sparkSession.read.schema(fitted.schema).parquet(path)

    def predict(key: tuple, history: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        return _predicted(key, history, models, periods)

    to_predict = fitted.drop("part").select("*", each_part)
    predicted = (
        in_parts.select("id", "part", "at")
        .groupBy("id", "part")
        .cogroup(to_predict.groupBy("id", "part"))
        .applyInPandas(predict, "id string, at long, yhat double, yhat_lower double, yhat_upper double")
    )
    ds = F.expr(f"TIMESTAMP_NTZ '1970-01-01' + make_dt_interval(CAST(at DIV {DAY_MICROS} AS INT), 0, 0, CAST(at % {DAY_MICROS} AS DECIMAL(18, 6)) / 1000000)")
    named = lookup_join(predicted, series.select("id", *[f"__k{i}" for i in range(len(by))]), ["id"])
    return named.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(by)], ds.alias("ds"), "yhat", "yhat_lower", "yhat_upper")


def _model_at(at: pd.Series, one: pd.Series) -> np.ndarray:
    first, last = one["first"] / DAY_MICROS, one["last"] / DAY_MICROS
    spots = np.asarray(one["spots"], float)
    return _design(at.to_numpy(float) / DAY_MICROS, first, max(last - first, 1.0), spots, bool(one["timed"]))


def _part_sums(key: tuple, stamps: pd.DataFrame, series: pd.DataFrame) -> pd.DataFrame:
    """Sums of products of the design columns over the stamps of one part."""
    one = series.iloc[0].copy()
    one["spots"] = _spots(np.asarray(one["spots"], np.int64))  # so far all days
    x, n = _model_at(stamps["at"], one), stamps["n"].to_numpy()
    one["rows"], one["squares"] = n.sum(), stamps["squares"].sum() / one["scale"] ** 2
    one["moment"] = x.T @ (stamps["total"].to_numpy() / one["scale"])
    one["gram"] = (x.T @ (n[:, None] * x)).ravel()
    return pd.DataFrame([one])


def _merged(parts: pd.DataFrame) -> pd.DataFrame:
    """The sums of several parts as one, whatever order they come in."""
    parts = parts.sort_values(["rows", "squares"])
    one = parts.iloc[0].copy()
    for name in ("rows", "squares", "moment", "gram"):
        one[name] = sum(parts[name])
    return pd.DataFrame([one])


def _fitted(batches):
    """One model per series from its sums."""
    for batch in batches:
        models = []
        for _, one in batch.iterrows():
            moment, rows = np.asarray(one["moment"]), one["rows"]
            gram = np.asarray(one["gram"]).reshape(len(moment), -1)
            around = lambda beta, m=moment, g=gram, s=one["squares"], n=rows: (s - 2 * beta @ m + beta @ g @ beta) / n
            start = max(one["squares"] / rows - (moment[0] / rows) ** 2, 1e-12)
            beta, noise, sizes = _solve(gram, moment, start, len(one["spots"]), around)
            models.append({**{c: one[c] for c in _SERIES_COLUMNS}, "noise": noise, "sizes": sizes, "beta": beta})
        if models:
            yield pd.DataFrame(models)


def _predicted(key: tuple, stamps: pd.DataFrame, models: pd.DataFrame, periods: int) -> pd.DataFrame:
    """Stamps of one part with their estimates; the first part adds the days beyond."""
    one, at = models.iloc[0], stamps["at"]
    if key[1] == 0:
        at = pd.concat([at, pd.Series(one["last"] + np.arange(1, periods + 1) * DAY_MICROS)], ignore_index=True)
    first, last = one["first"] / DAY_MICROS, one["last"] / DAY_MICROS
    yhat = _model_at(at, one) @ np.asarray(one["beta"])
    half = _half_width(at.to_numpy(float) / DAY_MICROS, last, max(last - first, 1.0), one["noise"], np.asarray(one["sizes"]))
    scale = one["scale"]
    return pd.DataFrame({"id": one["id"], "at": at, "yhat": yhat * scale, "yhat_lower": (yhat - half) * scale, "yhat_upper": (yhat + half) * scale})
