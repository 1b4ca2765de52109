"""Schema and quality gates: rules compiled into one aggregate, version guards, content digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks its contract."""


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): how many rows break each rule, a null verdict included: one pass, however many rules."""
    broken = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return broken.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("n")) for name in rules])))


def assert_schema(df: DataFrame, columns: dict[str, str], version: int | None = None, version_column: str = "schema_version") -> DataFrame:
    """``df`` if it has the columns with these types and, if asked for, one version only; else an error."""
    have = dict(df.dtypes)
    wrong = {c: have.get(c) for c, t in columns.items() if have.get(c) != t}
    if wrong:
        raise ContractError(f"columns missing or of another type: {wrong}")
    if version is not None:
        found = [r[0] for r in df.select(version_column).distinct().limit(5).collect()]
        if found != [version]:
            raise ContractError(f"schema version {found}, not {version}")
    return df


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row as JSON with sorted keys; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def content_digest(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, digest): a digest of a multiset of rows, whatever their order and partitions. Row digests are
    summed up in four integer parts, so no task gathers a table; equal rows count as often as they occur."""
    hashed = df.withColumn("__d", row_digest(df.columns))
    part = lambda k: F.sum(F.conv(F.substring("__d", 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)"))
    out = [F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[part(k).cast("string") for k in range(8)]), 256).alias("digest")]
    return hashed.groupBy(*keys).agg(*out) if keys else hashed.agg(*out)


def bucket_of(text: Column, buckets: int = 100) -> Column:
    """The SHA-256 of a text as one number modulo ``buckets``, by Horner's rule over its hex digits."""
    digits = F.split(F.sha2(text, 256), "")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda a, d: (a * 16 + F.conv(d, 16, 10).cast("int")) % buckets)


def normal_name(given: Column, known: tuple[str, ...]) -> Column:
    """A name without white space around it, in lower case; null stays null, and one that isn't known is an error."""
    plain = F.lower(F.regexp_replace(given, r"^\s+|\s+$", ""))
    return F.when(given.isNull() | plain.isin(*known), plain).otherwise(F.raise_error(F.concat(F.lit("unknown name "), given)).cast("string"))


def parsed_spec(given: Column) -> Column:
    """struct(kind, spec) of an argument that is JSON or text, without white space around it: json for an object or array, else
    text; null stays null, and an empty one is an error."""
    plain = F.regexp_replace(given, r"^\s+|\s+$", "")
    shape = F.schema_of_variant(F.try_parse_json(plain))
    kind = F.when(given.isNull(), F.lit(None).cast("string")).when(plain == "", F.raise_error(F.lit("an argument can't be empty")).cast("string"))
    return F.struct(kind.when(F.coalesce(shape.startswith("OBJECT") | shape.startswith("ARRAY"), F.lit(False)), "json").otherwise("text").alias("kind"), plain.alias("spec"))
