"""Dates and times: parsing of texts and numbers, inference of date columns, formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import finite


def parse_datetime(text: Column) -> Column:
    """A text as a timestamp: a bare date is midnight in the session's zone; ISO dates and times with or without a zone; fractions
    of a second are cut to milliseconds. Null for all other texts, plain numbers included."""
    trimmed = F.trim(text)
    iso = trimmed.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$")
    short = F.regexp_replace(trimmed, r"(\.\d{3})\d+", "$1")
    return F.when(iso, F.try_to_timestamp(short))


def timestamp_of_number(value: Column) -> Column:
    """Seconds (1e9 to 1e12) and milliseconds (1e12 to 1e14) since 1970 as a timestamp, null elsewhere."""
    v, size = finite(value.cast("double")), F.abs(value.cast("double"))
    seconds = F.when((size >= 1e9) & (size < 1e12), v).when((size >= 1e12) & (size < 1e14), v / 1000)
    return F.timestamp_millis(F.round(seconds * 1000).cast("long"))


def infer_kind(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, n_dates, kind: `datetime` as soon as one text has a time of day, `date` where there are bare dates only, else null."""
    aggs = []
    for c in columns:
        text = F.col(f"`{c}`").cast("string")
        parsed = parse_datetime(text).isNotNull()
        aggs += [F.count(text).alias(f"{c}__n"), F.count_if(parsed).alias(f"{c}__d"), F.count_if(parsed & text.rlike(r"^\s*\d{4}-\d{2}-\d{2}\s*$")).alias(f"{c}__b")]
    parts = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}__{k}`").alias(a) for k, a in (("n", "n"), ("d", "n_dates"), ("b", "n_bare"))]) for c in columns]
    rows = df.agg(*aggs).select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    kind = F.when(F.col("n_dates") > F.col("n_bare"), "datetime").when(F.col("n_bare") > 0, "date")
    return rows.select("column", "n", "n_dates", kind.alias("kind"))


def _millis(time: Column) -> Column:
    """Milliseconds since 1970, rounded to the nearest."""
    return F.round(F.unix_micros(time) / 1000).cast("long")


def since(then: Column, now: Column, units: int = 3) -> Column:
    """How long ago, or from now: whole minutes between times to the millisecond, in up to `units` units: years of 365 days, months of 30, w, d, h, m.

    Units that are 0 are left out, but for the minutes (`0m ago`); null where a time is.
    """
    apart = _millis(now) - _millis(then)
    left, parts = F.floor(F.abs(apart) / 60_000), []
    for name, size in (("y", 525_600), ("mo", 43_200), ("w", 10_080), ("d", 1_440), ("h", 60), ("m", 1)):
        value = F.floor(left / size)
        parts.append(F.when((value > 0) | F.lit(name == "m"), F.concat(value.cast("string"), F.lit(name))))
        left = left % size
    words = F.array_join(F.slice(F.array_compact(F.array(*parts)), 1, units), " ")
    return F.when(apart >= 0, F.concat(words, F.lit(" ago"))).when(apart < 0, F.concat(words, F.lit(" from now")))


def written(time: Column, mode: str = "datetime", now: Column | None = None) -> Column:
    """A timestamp as text: `date`, `time` (to minutes), `datetime` in the session's zone, `iso` (UTC, milliseconds) or `relative` to `now`."""
    if mode == "relative":
        return since(time, F.current_timestamp() if now is None else now)
    if mode == "iso":
        utc = F.convert_timezone(None, F.lit("UTC"), time.cast("timestamp_ltz").cast("timestamp_ntz"))
        return F.date_format(utc.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.date_format(time, {"date": "yyyy-MM-dd", "time": "HH:mm", "datetime": "yyyy-MM-dd HH:mm"}[mode])
