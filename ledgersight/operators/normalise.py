"""From raw event columns to the typed event log the features work on."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv
from ..functions import amounts, calendar, casts


def keep_existing(df: DataFrame, columns) -> DataFrame:
    """Project onto the wanted columns that exist."""
    return df.select(*[c for c in columns if c in df.columns])


def ensure_column(df: DataFrame, name: str, default, spark_type: str,
                  strict: bool = True) -> DataFrame:
    """The column cast and null-filled when present, a typed literal when absent."""
    fallback = F.lit(default).cast(spark_type)
    if name not in df.columns:
        return df.withColumn(name, fallback)
    value = F.col(name).cast(spark_type) if strict else F.col(name).try_cast(spark_type)
    return df.withColumn(name, F.coalesce(value, fallback))


def normalise_strict(df: DataFrame) -> DataFrame:
    """Typed ids, amount, timestamp and session; a malformed value fails the query."""
    df = df.withColumns({
        "event_id": F.col("event_id").cast("bigint"),
        "customer_id": F.col("customer_id").cast("bigint"),
        "operaton_amt": F.col("operaton_amt").cast("double"),
        "event_ts": casts.strict_timestamp("event_dttm"),
    })
    df = ensure_column(df, "session_id", fv.NULL_INTEGER, "bigint")
    return df.withColumn("event_us", calendar.micros("event_ts"))


def normalise_lenient(df: DataFrame) -> DataFrame:
    """Integer feature space; malformed or absent values become -1, bad timestamps null."""
    typed = {
        "event_ts": casts.lenient_timestamp("event_dttm"),
        "amt": F.col("operaton_amt").cast("double"),
    }
    absent = F.lit(fv.NULL_INTEGER)
    for name, (source, spark_type) in fv.LENIENT_INTEGERS.items():
        typed[name] = (casts.lenient_int(source, spark_type) if source in df.columns
                       else absent.cast(spark_type))
    for name, (source, pattern) in fv.DIGIT_PATTERNS.items():
        typed[name] = (casts.digits(source, pattern) if source in df.columns
                       else absent.cast("smallint"))
    raw = {"event_dttm", "operaton_amt", "mcc_code", "battery", "device_system_version",
           "screen_size", "developer_tools", "compromised"}
    return (df.withColumns(typed).drop(*raw)
            .withColumn("event_us", calendar.micros("event_ts")))


def add_event_features(df: DataFrame) -> DataFrame:
    """Calendar, amount and screen features of the single event."""
    return df.withColumns({
        **calendar.calendar_features("event_ts"),
        "amt_log_abs": amounts.log_abs("amt"),
        "amt_is_negative": amounts.is_negative("amt"),
        "screen_pixels": amounts.screen_pixels(),
        "screen_ratio": amounts.screen_ratio(),
    })


def normalise_categories(df: DataFrame, columns=fv.CATEGORY_COLUMNS) -> DataFrame:
    """Categories as text, null or absent becoming MISSING."""
    return df.withColumns({
        c: casts.category(c) if c in df.columns else F.lit(fv.NULL_CATEGORY) for c in columns
    })


def numeric_columns(df: DataFrame, exclude=fv.ID_COLUMNS) -> list[str]:
    return [f.name for f in df.schema
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def coerce_numeric(df: DataFrame, columns) -> DataFrame:
    """Columns as double, non-numbers becoming null."""
    return df.withColumns({c: casts.lenient_double(c) for c in columns})


def feature_columns(columns, exclude=fv.META_COLUMNS + fv.LEAKAGE_COLUMNS,
                    categorical=fv.CATEGORICAL_FEATURES):
    """(all features, categorical, numeric) after removing ids, meta and label columns."""
    features = [c for c in columns if c not in exclude]
    return (features, [c for c in features if c in categorical],
            [c for c in features if c not in categorical])


def velocity_feature_columns(columns):
    """Features of the velocity table: everything but ids, time, label and split columns."""
    excluded = set(fv.NON_FEATURE_COLUMNS) | {"event_ts", "event_us"}
    return feature_columns(columns, excluded, fv.CATEGORY_COLUMNS)
