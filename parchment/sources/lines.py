"""JSON Lines of a fixed schema, whose lines keep their numbers however a file is cut into splits.

A split of a file knows its lines in order, but not how many stand before it. Lines of splits are counted, the counts of a
file's splits add up to where each begins, and a line's number is that plus its place in its split. Nothing but a row per
split leaves the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SPLIT = ["file", "_split"]


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, number, line) of text files, numbers from 1, blank lines included. A line ends at \\n, \\r or \\r\\n; the last one
    may lack an end. Any file system and compression that Spark reads."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.col("value").alias("line"))
    # A task reads its splits one after the other, each in order, so this number rises by one a line inside a split.
    read = read.withColumn("_place", F.monotonically_increasing_id())
    splits = read.groupBy(*SPLIT).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select(*SPLIT, (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_from"))
    return read.join(starts, SPLIT).select("file", (F.col("_place") + F.col("_from")).alias("number"), "line")


def problem(line: Column, schema: StructType) -> Column:
    """Why a line doesn't fit a schema, or null: not JSON of these types, a field that the schema doesn't have, or one that it
    calls not nullable missing or null. Fields inside fields are checked for their types alone."""
    wide = StructType([StructField(f.name, f.dataType, True) for f in schema] + [StructField("_bad", StringType())])
    parsed = F.from_json(line, wide, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    known = F.coalesce(F.json_object_keys(line), F.array().cast("array<string>"))
    extra = F.array_except(known, F.array(*(F.lit(f.name) for f in schema)))
    missing = F.array_compact(F.array(*(F.when(parsed[f.name].isNull(), F.lit(f.name)) for f in schema if not f.nullable)))
    return (
        F.when(parsed.isNull() | parsed["_bad"].isNotNull() | F.json_object_keys(line).isNull(), "not an object of the schema's types")
        .when(F.size(extra) > 0, F.concat(F.lit("unknown fields "), F.array_join(extra, ", ")))
        .when(F.size(missing) > 0, F.concat(F.lit("no value for "), F.array_join(missing, ", ")))
    )


def bad_lines(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """(file, number, line, problem) of the lines that don't fit. Blank lines are skipped, but count."""
    lines = numbered_lines(spark, path).where(F.trim(F.translate("line", "\t\r\n\f\x0b", "     ")) != "")
    return lines.withColumn("problem", problem(F.col("line"), schema)).where("problem is not null")


def typed_rows(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """The rows of JSON Lines files, with `file` and `number`; reading a line that doesn't fit fails with both and the reason."""
    lines = numbered_lines(spark, path).where(F.trim(F.translate("line", "\t\r\n\f\x0b", "     ")) != "")
    why = problem(F.col("line"), schema)
    told = F.concat(F.col("file"), F.lit(":"), F.col("number").cast("string"), F.lit(": "), why, F.lit(": "), F.substring("line", 1, 200))
    sound = F.when(why.isNotNull(), F.raise_error(told).cast("string")).otherwise(F.col("line"))
    loose = StructType([StructField(f.name, f.dataType, True) for f in schema])
    return lines.select("file", "number", F.from_json(sound, loose).alias("row")).select("file", "number", "row.*")
