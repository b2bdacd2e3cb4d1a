"""Reading raw flow exports from CSV files, each record with its file, row, line and byte offset."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_IN_NAME = r"(\d{2}-\d{2}-\d{4})"
#: Files with more different headers than this are not one table.
MOST_HEADERS = 200


def file_date(name: Column) -> Column:
    """The dd-mm-yyyy in a file name, else null."""
    return F.try_to_date(F.regexp_extract(name, DAY_IN_NAME, 1), "dd-MM-yyyy")


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_file, line, source_line, byte_offset) of every physical line, line numbers from 1, offsets from 0.

    A file may be cut into splits at will: within a split lines stand in order, and counts and lengths of the splits
    before it give where it starts, so no file is numbered in one task. A line keeps no line break. A byte order mark,
    which the reader takes from a file, shows in the file's size and counts in the offsets. Files must be UTF-8.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select("*", "_metadata.file_name", "_metadata.file_path", "_metadata.file_block_start", "_metadata.file_size")
    lines = lines.select(F.col("file_name").alias("source_file"), F.col("file_path").alias("_path"), F.col("file_block_start").alias("_split"), F.col("file_size").alias("_size"), "value", F.monotonically_increasing_id().alias("_id"))
    size = F.octet_length("value") + 1
    inside = Window.partitionBy("_path", "_split").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumns({"_n": F.row_number().over(Window.partitionBy("_path", "_split").orderBy("_id")), "_o": F.coalesce(F.sum(size).over(inside), F.lit(0))})
    splits = lines.groupBy("_path", "_split", "_size").agg(F.count(F.lit(1)).alias("_c"), F.sum(size).alias("_s"))
    before = Window.partitionBy("_path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.sum("_s").over(Window.partitionBy("_path")) < F.col("_size"), 3).otherwise(0)
    starts = splits.select("_path", "_split", mark.alias("_mark"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o0"))
    joined = placed.join(starts, ["_path", "_split"])
    number = F.col("_n") + F.col("_n0")
    text = F.regexp_replace("value", "\r$", "")
    text = F.when(number == 1, F.regexp_replace(text, "^\ufeff", "")).otherwise(text)
    return joined.select("source_file", "_path", text.alias("line"), number.alias("source_line"), (F.col("_o") + F.col("_o0") + F.when(number > 1, F.col("_mark")).otherwise(0)).alias("byte_offset"))


def read_flow_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All records as text columns, with source_file, file_date, source_row (from 1 after the header), source_line and
    byte_offset; columns that a file lacks are null. A record whose field count differs from its header raises when it
    is used. Files without lines give no rows; a folder without any header gives an error.
    """
    lines = numbered_lines(spark, paths)
    headers = lines.where("source_line = 1").select("_path", F.col("line").alias("_header"))
    different = [r["_header"] for r in headers.select("_header").distinct().limit(MOST_HEADERS + 1).collect()]
    if not different or len(different) > MOST_HEADERS:
        raise ValueError(f"{len(different)} different headers")
    records = lines.where("source_line > 1").join(headers, "_path")
    made: DataFrame | None = None
    for header in sorted(different):
        names = next(iter(_split_header(header)))
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_bad"]])
        own = records.where(F.col("_header") == header)
        parsed = F.from_csv("line", _ddl(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "nullValue": "\x01", "emptyValue": "", "maxCharsPerColumn": "-1"})
        rows = own.withColumn("_r", parsed)
        checked = F.when(F.col("_r._bad").isNotNull(), F.raise_error(F.concat(F.lit("field count of "), F.col("source_file"), F.lit(" line "), F.col("source_line").cast("string")))).otherwise(F.col("source_line"))
        columns = [F.coalesce(F.col("_r").getField(n), F.lit("")).alias(n) for n in names]
        one = rows.select("source_file", file_date(F.col("source_file")).alias("file_date"), (checked - 1).alias("source_row"), "source_line", "byte_offset", *columns)
        made = one if made is None else made.unionByName(one, allowMissingColumns=True)
    return made


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema.fields)


def _split_header(line: str):
    from siltstream.sources.csv_rejects import split_line

    names = split_line(line)
    if names is None:
        raise ValueError("a header is not well-formed")
    seen: dict[str, int] = {}
    for i, n in enumerate(names):
        seen[n] = seen.get(n, 0) + 1
        if seen[n] > 1:
            names[i] = f"{n}.{seen[n] - 1}"
    yield names


def line_counts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_file, n_lines): physical lines per file, an independent count of rows."""
    return spark.read.option("lineSep", "\n").text(paths).groupBy(F.col("_metadata.file_name").alias("source_file")).agg(F.count(F.lit(1)).alias("n_lines"))


def read_report(spark: SparkSession, path: str, where: str = "true") -> DataFrame:
    """A report with a header, all text, filtered while it is read."""
    return spark.read.option("header", True).csv(path).where(where)


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted items without output of the same keys: what a resumed run still has to do."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def safe_name(name: str) -> str:
    """A column name as a report uses it."""
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")
