"""Content fingerprints and inventories (K rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .order import ranked


def row_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """``__row``: the exact text of a row; doubles by their bits, nulls apart from texts."""
    kinds = dict(df.dtypes)
    exact = [F.coalesce(F.hex(F.col(c).cast("binary")) if kinds[c] in ("string", "binary") else F.col(c).cast("string"), F.lit("\0")) for c in columns]
    return df.withColumn("__row", F.concat_ws("\x1f", *exact))


def fingerprint(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys, n, fingerprint``: of the multiset of rows of each group, whatever their order.

    Each row's SHA-256 counts by three sums of its parts, so groups of any size aggregate map-side
    and none is gathered in one place; the sums, the count and the column names are hashed again.
    """
    rows = row_text(df, columns).withColumn("__h", F.sha2("__row", 256))
    part = lambda i: F.sum(F.conv(F.substring("__h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)"))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(part(i).alias(f"__p{i}") for i in range(3)))
    whole = F.sha2(F.concat_ws("|", F.lit(",".join(columns)), F.col("n").cast("string"), *(F.col(f"__p{i}").cast("string") for i in range(3))), 256)
    return sums.select(*keys, "n", whole.alias("fingerprint"))


def ordered_fingerprint(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """``keys, n, fingerprint``: of the rows of each group in order, and of the names and types of the columns.

    Each row counts with its place, so rows that change places change the fingerprint, and how
    rows are dealt over partitions doesn't. Places are found in ranges and added up over them, and
    digests aggregate map-side: no group is gathered in one task. Rows that ``order`` leaves equal
    stand in order of their own text.
    """
    kinds = dict(df.dtypes)
    placed = ranked(row_text(df, columns), keys, [*order, "__row"], "__place")
    made = fingerprint(placed, keys, ["__place", *columns])
    schema = ",".join(f"{c}:{kinds[c]}" for c in columns)
    return made.withColumn("fingerprint", F.sha2(F.concat(F.lit(schema + "|"), F.col("fingerprint")), 256))


def fingerprint_diff(a: DataFrame, b: DataFrame, keys: list[str], categories: list[str]) -> DataFrame:
    """The first category, in the given order, whose fingerprints differ; null if none does."""
    left = a.select(*keys, *(F.col(c).alias(f"__a_{c}") for c in categories))
    right = b.select(*keys, *(F.col(c).alias(f"__b_{c}") for c in categories))
    rows = left.join(right, keys, "full")
    first = F.coalesce(*(F.when(~F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}")), F.lit(c)) for c in categories))
    return rows.select(*keys, first.alias("differs"))


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
