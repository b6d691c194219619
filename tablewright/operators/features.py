"""Feature engineering: scaling, log transform, encodings, feature choice."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import number, numeric_names, present, ref, text_form
from tablewright.functions.lookup import lookup_join
from tablewright.functions.ranking import dense_codes
from tablewright.functions.reports import statistics
from tablewright.operators.profile import pearson

# Fixed value: label class of a missing value.
MISSING_CLASS = "None"


def scale(
    df: DataFrame, columns: list[str], method: str = "standard"
) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Scale columns; returns the table and ``{column: (centre, spread)}``.

    ``standard``: mean and population deviation.  ``minmax``: minimum and range.
    A column without spread becomes 0; missing values are ignored and stay.
    """
    if method not in ("standard", "minmax"):
        raise ValueError(f"unknown scaling method: {method!r}")
    if not columns:
        return df, {}
    aggregates = {}
    for name in columns:
        value = number(df, name)
        standard = method == "standard"
        aggregates["centre", name] = F.avg(value) if standard else F.min(value)
        aggregates["spread", name] = F.stddev_pop(value) if standard else F.max(value) - F.min(value)
    found = statistics(df, aggregates)
    fitted = {c: (found["centre", c], found["spread", c]) for c in columns}
    return apply_scale(df, fitted), fitted


def apply_scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """Apply a fitted scaling to this or another table."""
    scaled = {}
    for name, (centre, spread) in fitted.items():
        value = number(df, name)
        if centre is None:
            continue
        scaled[name] = (value - F.lit(centre)) / F.lit(spread if spread else 1.0)
    return df.withColumns(scaled) if scaled else df


def log_transform(df: DataFrame, columns: list[str]) -> DataFrame:
    """log(1 + x); a column reaching -1 or less is first shifted so that its minimum is 1."""
    if not columns:
        return df
    lowest = statistics(df, {c: F.min(number(df, c)) for c in columns})
    changed = {}
    for name in columns:
        low = lowest[name]
        shift = abs(low) + 1 if low is not None and low <= -1 else 0.0
        changed[name] = F.log1p(number(df, name) + F.lit(shift))
    return df.withColumns(changed)


def category_levels(df: DataFrame, columns: list[str], limit: int | None = None) -> dict[str, list[str]]:
    """Sorted distinct values of each column as text; more than a given ``limit`` is an error."""
    if not columns:
        return {}
    values = {c: present(df.schema[c]) for c in columns}
    wide = []
    if limit is not None:
        # The sketch keeps columns far above the bound out of the exact pass.
        about = statistics(df, {c: F.approx_count_distinct(v) for c, v in values.items()})
        wide = [c for c in columns if about[c] > 2 * limit]
    if not wide:
        pairs = {c: F.collect_set(F.when(v.isNotNull(), F.struct(v.alias("value"), text_form(df.schema[c]).alias("level")))) for c, v in values.items()}
        found = statistics(df, {c: F.sort_array(p) for c, p in pairs.items()})
        wide = [c for c in columns if limit is not None and len(found[c]) > limit]
    if wide:
        raise ValueError(f"columns {wide} have more than {limit} values: use label_encode or one_hot_vector")
    return {c: [pair["level"] for pair in found[c]] for c in columns}


def one_hot(df: DataFrame, columns: list[str], drop_first: bool = False, limit: int | None = None) -> DataFrame:
    """Replace each column by one boolean column ``<column>_<value>`` per value.

    Values are in order; a missing value is false everywhere.
    """
    levels = category_levels(df, columns, limit)
    kept = [ref(c) for c in df.columns if c not in columns]
    flags = []
    for name in columns:
        text = text_form(df.schema[name])
        for level in levels[name][1 if drop_first else 0 :]:
            flags.append(F.coalesce(text == F.lit(level), F.lit(False)).alias(f"{name}_{level}"))
    return df.select(*kept, *flags)


def one_hot_vector(df: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """Sparse form for any number of values: a vector ``<column>_onehot`` replaces each column.

    Values are in text order; a missing value gives a vector of zeros.  The values
    are numbered by Spark and do not pass the driver.
    """
    coded, places = df, []
    for name in columns:
        text = text_form(df.schema[name])
        codes = dense_codes(df.select(text.alias(name)), name, "code", limit)
        size = codes.table.count()
        joined = codes.join(coded.withColumn(name, text), name, "__code")
        # One place more than values: that of the missing value, which the encoder drops.
        places.append(f"{name}__place")
        described = {"ml_attr": {"type": "nominal", "num_vals": size + 1}}
        place = F.coalesce("__code", F.lit(size)).cast("double").alias(places[-1], metadata=described)
        coded = joined.select(*[ref(c) for c in coded.columns if c != name], place)
    encoder = OneHotEncoder(inputCols=places, outputCols=[f"{c}_onehot" for c in columns], dropLast=True)
    return encoder.fit(coded).transform(coded).drop(*places)


def label_encode(
    df: DataFrame, columns: list[str], limit: int | None = None
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Replace each column by the place of its text among the sorted distinct texts.

    A missing value is a class of its own.  Returns the table and, per column,
    the classes ``(class, code)`` for the way back.
    """
    encoded, classes = df, {}
    for name in columns:
        as_text = F.coalesce(text_form(df.schema[name]), F.lit(MISSING_CLASS))
        encoded = encoded.withColumn(name, as_text)
        codes = dense_codes(df.select(as_text.alias("class")), "class", "code", limit)
        classes[name] = codes.table
        joined = codes.join(encoded, name, "__code")
        encoded = joined.select(*[F.col("__code").alias(c) if c == name else ref(c) for c in df.columns])
    return encoded, classes


def label_decode(df: DataFrame, classes: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """Turn label codes back into their texts."""
    decoded = df
    for name, codes in classes.items():
        table = codes.withColumnsRenamed({"code": name, "class": "__class"})
        joined = lookup_join(decoded, table, [name], "left", limit)
        decoded = joined.select(*[F.col("__class").alias(c) if c == name else ref(c) for c in df.columns])
    return decoded


def encode_categorical(df: DataFrame, columns: list[str], method: str = "onehot") -> tuple[DataFrame, dict[str, DataFrame]]:
    """One-hot or label encoding by name."""
    if method == "onehot":
        return one_hot(df, columns), {}
    if method == "label":
        return label_encode(df, columns)
    raise ValueError(f"unknown encoding method: {method!r}")


def correlated_features(df: DataFrame, target: str, threshold: float = 0.8) -> list[str]:
    """Numeric columns whose correlation with the target exceeds the threshold in size."""
    others = [c for c in numeric_names(df) if c != target]
    found = statistics(df, {c: pearson(number(df, c), number(df, target)) for c in others}) if others else {}
    return [c for c in others if found[c] is not None and abs(found[c]) > threshold]
