"""Place lists from CSV and landed answers (JSON, JSONP, HTML), read by Spark from any path it knows."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import records
from ..functions import text as X
from ..operators.validation import header_issues
from ..plans.work import written


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of texts by header; names trimmed (and rid of a byte-order mark), blank lines skipped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def csv_headers(spark: SparkSession, path: str, names: str = "*.csv") -> DataFrame:
    """(path, file, header): the first line of each of a folder's files, by partial aggregates over the files' first blocks."""
    lines = spark.read.option("pathGlobFilter", names).text(path).select("value", F.monotonically_increasing_id().alias("_at"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_start"))
    return lines.where("_start = 0").groupBy("path", "file").agg(F.min_by("value", "_at").alias("header"))


def header_names(header: str) -> list[str]:
    """The names in a header line, trimmed and rid of a byte-order mark."""
    found = next(csv.reader([header.lstrip("\ufeff")]), [])
    return [name.strip() for name in found]


def _by_header(spark: SparkSession, path: str, names: str) -> dict[tuple[str, ...], list[tuple[str, str]]]:
    """Files (path, name) by their header's names. One short row a file reaches the driver, as for any listing of files."""
    out: dict[tuple[str, ...], list[tuple[str, str]]] = {}
    for row in csv_headers(spark, path, names).orderBy("path").toLocalIterator():
        out.setdefault(tuple(header_names(row["header"])), []).append((row["path"], row["file"]))
    return out


def csv_directory(spark: SparkSession, path: str, names: str = "*.csv") -> DataFrame:
    """All CSV files of a folder with the file's name, each read by its own header.

    Files of one header are read together; columns meet by name, and what a file doesn't have is null. Of a name that a
    header repeats the last column counts. A folder without files has the file's name as its only column and no rows.
    """
    parts = []
    for header, files in _by_header(spark, path, names).items():
        kept = [n not in header[k + 1 :] and n != "" for k, n in enumerate(header)]
        schema = T.StructType([T.StructField(f"_c{k}", T.StringType()) for k in range(len(header))])
        rows = spark.read.schema(schema).options(header=True, multiLine=True, escape='"', mode="PERMISSIVE", enforceSchema=True).csv([p for p, _ in files])
        parts.append(rows.select(*[F.col(f"_c{k}").alias(n) for k, n in enumerate(header) if kept[k]], F.col("_metadata.file_name").alias("file")))
    if not parts:
        return spark.createDataFrame([], "file string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def header_faults(spark: SparkSession, path: str, known: tuple[str, ...], names: str = "*.csv") -> DataFrame:
    """(file, severity, issue) of every file's header: repeated and missing names are errors, unknown ones warnings."""
    faults = [(file, *fault) for header, files in _by_header(spark, path, names).items() for fault in header_issues(list(header), known) for _, file in files]
    return spark.createDataFrame(faults, "file string, severity string, issue string")


def line_count(spark: SparkSession, path: str) -> DataFrame:
    """Lines of each file without its header, nothing parsed."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"))
    return lines.groupBy("file").agg((F.count(F.lit(1)) - 1).cast("long").alias("n_rows"))


def numbered_rows(df: DataFrame, first: int = 2) -> DataFrame:
    """File row numbers (the header is row 1): numbers within partitions, shifted by the sizes of those before.

    Rows are written with their partition's number before they are counted: read twice, a plan may be cut into other
    partitions (Spark joins small ones as it goes), and counts of one cut don't fit another. One count for each partition
    comes to the driver and is broadcast (16 bytes each, so it grows with partitions, not rows); rows aren't moved.
    """
    spark = df.sparkSession
    at = written(df.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    at = at.withColumns({"_p": F.shiftright("_id", 33), "_n": F.col("_id").bitwiseAND((1 << 33) - 1)})
    sizes = sorted(map(tuple, at.groupBy("_p").agg(F.max("_n") + 1).collect()))
    shifts, total = [], first
    for p, n in sizes:
        shifts.append((p, total))
        total += n
    return at.join(F.broadcast(spark.createDataFrame(shifts, "_p long, _shift long")), "_p").withColumn("row", F.col("_n") + F.col("_shift")).drop("_id", "_p", "_n", "_shift")


def answers(spark: SparkSession, path: str) -> DataFrame:
    """Landed answers, one file a row: (file, body), JSONP unwrapped."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.col("_metadata.file_name").alias("file"), records.jsonp_body(F.col("value")).alias("body"))


def answer_records(bodies: DataFrame, data_path: str | None = None, group_key: str | None = None) -> DataFrame:
    """Each record of each answer as a JSON text; ``group_key`` flattens lists of groups that hold lists."""
    rows = bodies.select(*[c for c in bodies.columns if c != "body"], F.explode(records.record_array(F.col("body"), data_path)).alias("record"))
    if group_key:
        rows = rows.withColumn("record", F.explode(records.record_array(F.col("record"), group_key, ())))
    return rows


ID_KEYS = ("id", "storeId", "store_id", "locationId", "uuid", "code")


def distinct_records(rows: DataFrame, order: str = "record") -> DataFrame:
    """One row for each record's id (the first key that has one), else for its name and place."""
    value = lambda k: X.present(records.value(F.col("record"), k))
    key = F.coalesce(*[value(k) for k in ID_KEYS], F.concat_ws("_", *[F.coalesce(value(k), F.lit("")) for k in ("name", "latitude", "longitude")]))
    return rows.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def backup_restored(spark: SparkSession, df: DataFrame, path: str, column: str, key: str = "handle") -> DataFrame:
    """The table with a column's values from a JSON backup."""
    old = spark.read.json(path).select(key, F.col(column).alias("_old"))
    return df.join(old, key, "left").withColumn(column, F.coalesce("_old", column)).drop("_old")
