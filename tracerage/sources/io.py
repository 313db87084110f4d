"""Readers, writers and catalogues."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and executors share (spark.checkpoint.dir).

    Without that setting a local session takes a folder of its own machine; any other one fails.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/checkpoints"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, most: int = 0) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage.

    ``most``: rows of a file, for long rows. Spark's reader unpacks up to 4,096 rows of a file at once.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", most).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task sorts or numbers. 200 tasks, up to which Spark deals rows out without sorting them, hold 240 million.
TASK_ROWS = 1_200_000


def tasks_for(table: DataFrame) -> int:
    """Tasks to deal the rows of a stored table to: the session's number, or more where a task would get beyond TASK_ROWS."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // TASK_ROWS))


OBSERVATION = "well long, obs_id long, element string, concentration double, error double, unit string, date double"


def read_observations(spark: SparkSession, path: str, schema: str = OBSERVATION) -> DataFrame:
    """Tab-separated observations; a missing error is 0.0, which means missing until errors are filled."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema).withColumn("error", F.coalesce("error", F.lit(0.0)))


def read_wide_raw(spark: SparkSession, path: str) -> DataFrame:
    """``date, element, unit, value``: one row for each positive cell of wide raw files.

    Lines that begin with ``element`` and ``unit`` head a file; the others are a date and values.
    """
    return wide_cells(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\t").alias("cells")))


def wide_cells(lines: DataFrame) -> DataFrame:
    """The same from ``file, cells``: values meet their element and unit by file and place."""
    cells = lines.select("file", F.col("cells")[0].alias("head"), F.posexplode("cells").alias("at", "cell")).where("at > 0")
    names = cells.where("head = 'element'").select("file", "at", F.col("cell").alias("element"))
    units = cells.where("head = 'unit'").select("file", "at", F.col("cell").alias("unit"))
    values = cells.where("head not in ('element', 'unit')").select("file", "at", F.col("head").alias("date"), F.expr("try_cast(cell as double)").alias("value")).where("value > 0")
    return values.join(names, ["file", "at"]).join(units, ["file", "at"]).select("date", "element", "unit", "value")


def unpivot_measurements(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Wide to long: ``element, concentration`` for each of the columns; empty cells go."""
    return df.unpivot(ids, columns, "element", "concentration").where("concentration is not null")


def read_chronicle(spark: SparkSession, root: str) -> DataFrame:
    """``tracer, date, value`` of files under ``tracer=<name>`` folders; lines with # are comments."""
    return spark.read.option("comment", "#").schema("date double, value double, tracer string").csv(root).select("tracer", "date", "value")


def clean_chronicle(df: DataFrame, factor: float = 1.0) -> DataFrame:
    """Numbers out of dirty text (doubled points, blanks), times a unit factor; what is no number goes."""
    number = lambda c: F.expr(f"try_cast(regexp_replace(trim({c}), '[.]+', '.') as double)")
    return df.select("tracer", number("date").alias("date"), (number("value") * factor).alias("value")).where("date is not null and value is not null")


def read_draws(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A sample table with its index column."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def read_histograms(spark: SparkSession, root: str) -> DataFrame:
    """``parameter, val, hist`` of tab-separated histogram files under ``parameter=<name>`` folders; other headers are an error."""
    rows = spark.read.option("sep", "\t").option("header", True).option("enforceSchema", False).schema("val double, hist double, parameter string").csv(root)
    return rows.select("parameter", "val", "hist")


def read_statistics(spark: SparkSession, path: str, names: list[str], index: str = "parameter") -> DataFrame:
    """A table of descriptive statistics with its index column (whatever its header, often none) under the name ``index``."""
    schema = ", ".join([f"{index} string", *(f"`{n}` double" for n in names)])
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def read_key_values(spark: SparkSession, root: str, group: str, keys: list[str]) -> DataFrame:
    """Lines ``key<tab>value``, split once; a row for each folder ``<group>=...``, a column for each key."""
    lines = spark.read.text(root).select(group, F.split("value", "\t", 2).alias("kv"))
    return lines.select(group, F.col("kv")[0].alias("key"), F.col("kv")[1].alias("value")).groupBy(group).pivot("key", keys).agg(F.first("value"))


def harvest(spark: SparkSession, root: str, pattern: str, names: list[str], schema: str, form: str = "parquet", files: str = "*") -> DataFrame:
    """Result tables under a tree, with columns taken from each file's path by a pattern's groups.

    ``form`` is parquet, or tsv for text tables with a header. Files whose path doesn't match the
    pattern are left out.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", files).schema(schema)
    rows = reader.parquet(root) if form == "parquet" else reader.csv(root, sep="\t", header=True)
    rows = rows.withColumn("__path", F.col("_metadata.file_path")).where(F.col("__path").rlike(pattern))
    for i, name in enumerate(names, 1):
        rows = rows.withColumn(name, F.regexp_extract("__path", pattern, i))
    return rows.drop("__path")


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def read_result_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``case_id, tracer, value, attempt, objective``: maps of tracers and lists of attempts, flattened."""
    rows = spark.read.schema(schema).json(path)
    return rows.select("case_id", "attempts", F.explode("values").alias("tracer", "value")).select("case_id", "tracer", "value", F.posexplode("attempts").alias("attempt", "objective"))


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Parquet, or tab-separated text (``tsv``, ``tsv.gz``), or ``json``."""
    if form.startswith("tsv"):
        df.write.csv(path, sep="\t", header=True, compression="gzip" if form.endswith("gz") else "none")
    elif form == "json":
        df.write.json(path)
    else:
        df.write.parquet(path)


def to_wide_series(df: DataFrame, elements: list[str], date: str = "date", element: str = "element", value: str = "value") -> DataFrame:
    """A row for each date, a column for each element; more than one value of a cell is an error."""
    once = df.groupBy(date, element).agg(F.count("*").alias("n"), F.first(value).alias("v"))
    once = once.withColumn("v", F.when(F.col("n") == 1, F.col("v")).otherwise(F.raise_error(F.lit("more than one value of an element and date")).cast("double")))
    return once.groupBy(date).pivot(element, elements).agg(F.first("v"))


def write_per_group(df: DataFrame, path: str, group: str = "well") -> None:
    """A folder for each value of a column."""
    df.write.partitionBy(group).parquet(path)


def parameter_catalogue(specs: DataFrame) -> DataFrame:
    """Model parameters with flags: whether the range lies in the domain, the start in the range, the step is positive."""
    inside = lambda x, strict: F.when(F.col(strict), (F.col(x) >= F.col("lo")) & (F.col(x) <= F.col("hi"))).otherwise((F.col(x) > F.col("lo")) & (F.col(x) < F.col("hi")))
    rows = specs.withColumn("range_ok", inside("cal_lo", "inclusive") & inside("cal_hi", "inclusive") & (F.col("cal_lo") < F.col("cal_hi")))
    return rows.withColumn("init_ok", F.col("init").between(F.col("cal_lo"), F.col("cal_hi"))).withColumn("step_ok", F.col("step") > 0)


def tracer_catalogue(specs: DataFrame) -> DataFrame:
    """Tracers with their decay rate: ln 2 / half-life or 1 / mean lifetime; both given is an error."""
    rate = F.when(F.col("half_life").isNotNull() & F.col("mean_lifetime").isNotNull(), F.raise_error(F.lit("half_life and mean_lifetime exclude each other")).cast("double"))
    rate = rate.when(F.col("half_life").isNotNull(), F.log(F.lit(2.0)) / F.col("half_life")).when(F.col("mean_lifetime").isNotNull(), 1.0 / F.col("mean_lifetime"))
    return specs.withColumn("decay_rate", rate)
