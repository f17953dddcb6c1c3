"""Scalar and vector expressions, all built from functions that run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if any coordinate is null."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def time_parts(unix_time: str) -> dict[str, Column]:
    """UTC month, day, hour and day of week (Monday 0), by arithmetic that no session time zone can shift."""
    days = F.floor(F.col(unix_time) / 86400).cast("int")
    date = F.date_add(F.lit("1970-01-01").cast("date"), days)
    return {"month": F.month(date), "day": F.dayofmonth(date), "hour": F.floor(F.pmod(F.col(unix_time), F.lit(86400)) / 3600).cast("int"), "dayofweek": F.weekday(date)}


def parse_bool(text: Column) -> Column:
    """1 or 0 for the usual spellings, null for anything else."""
    word = F.lower(F.trim(text.cast("string")))
    return F.when(word.isin("true", "t", "1", "yes", "y"), 1).when(word.isin("false", "f", "0", "no", "n"), 0)


def safe_name(text: Column) -> Column:
    """A value as part of a column name: runs of other characters become one underscore. Two values may get one name."""
    return F.regexp_replace(F.lower(text), "[^0-9a-z]+", "_")


def one_hot(rows: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """One 0/1 column per training category; unknown and null values have zeros everywhere."""
    names: dict[str, list[str]] = {}
    for c in categories:
        names.setdefault("".join(x if x.isascii() and x.isalnum() else "_" for x in c.lower()), []).append(c)
    return rows.select("*", *[F.coalesce(F.col(column).isin(*values), F.lit(False)).cast("int").alias(f"{column}_{name}") for name, values in sorted(names.items())])


def missing_indicators(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select("*", *[F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in columns])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is missing or zero."""
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def euclidean(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return norm(diff)


def distmult(a: Column, relation: Column, b: Column) -> Column:
    return dot(F.zip_with(a, relation, lambda x, r: x.cast("double") * r.cast("double")), b)


def bce_with_logits(logit: Column, target: Column) -> Column:
    """Numerically stable binary cross-entropy of a logit."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def pair_key(card: Column, merchant: Column, merchants: int) -> Column:
    """One long for a (card, merchant) pair of dense ids; bijective for merchant < merchants."""
    return card.cast("long") * merchants + merchant


def unpair(key: Column, merchants: int) -> tuple[Column, Column]:
    return F.floor(key / merchants).cast("long"), key % merchants


def log_age(seconds: Column) -> Column:
    return F.log1p(F.greatest(seconds, F.lit(0)).cast("double"))


def sentinel_to_null(rows: DataFrame, columns: list[str], guards: dict[str, list[str]] | None = None) -> DataFrame:
    """-1 and below mean "not computed": null. Amounts may be negative, so they are null where their guard count is.

    ``guards`` maps a count column to the amount columns it speaks for.
    """
    guarded = {c: g for g, cs in (guards or {}).items() for c in cs}
    null = lambda c: F.when(F.col(c) > -1, F.col(c))
    out = []
    for c in rows.columns:
        if c in guarded:
            out.append(F.when(null(guarded[c]).isNotNull(), F.col(c)).alias(c))
        else:
            out.append(null(c).alias(c) if c in columns else F.col(c))
    return rows.select(*out)
