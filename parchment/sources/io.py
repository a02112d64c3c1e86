"""Typed JSON Lines, logs, CSV queues and content hashes."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON Lines table of a fixed schema; a line that doesn't fit fails the job, with its file and number where
    check_rows() is asked. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(file, number, line): the lines that don't fit, and where they stand. Files of lines are numbered by the ends of
    lines before them, which only the files with bad lines are read again for."""
    wide = StructType([*schema.fields, StructField("_bad", StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    known = F.map_keys(F.from_json("line", "map<string,string>"))
    extra = F.size(F.array_except(F.coalesce(known, F.array().cast("array<string>")), F.array(*(F.lit(f.name) for f in schema.fields)))) > 0
    parsed = F.from_json("line", wide, {"columnNameOfCorruptRecord": "_bad"})
    bad = lines.where(parsed["_bad"].isNotNull() | extra).distinct()
    text = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), F.split(F.decode("content", "UTF-8"), "\r?\n").alias("ls"))
    numbered = text.join(bad.select("file").distinct(), "file", "left_semi").select("file", F.posexplode("ls").alias("at", "line"))
    return numbered.join(bad, ["file", "line"], "left_semi").select("file", (F.col("at") + 1).alias("number"), "line")


def check_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """read_rows() that names the first bad line as file:number before anything else is done."""
    first = bad_rows(spark, path, schema).orderBy("file", "number").first()
    if first:
        raise ValueError(f"{first['file']}:{first['number']}: {first['line'][:200]}")
    return read_rows(spark, path, schema)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite_rows(df: DataFrame, path: str, *order: str) -> None:
    """Replaces a table; with an order, as one sorted file, for small tables that must be the same byte by byte."""
    (df.coalesce(1).sortWithinPartitions(*order) if order else df).write.mode("overwrite").json(path)


def read_documents(spark: SparkSession, path: str, *suffixes: str) -> DataFrame:
    """(path, length, content) of the files below a folder with one of the suffixes, in any case, by path."""
    either = lambda s: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s)
    glob = "*{" + ",".join(map(either, suffixes)) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length", "content").orderBy("path")


def write_queue(df: DataFrame, path: str, keys: list[str], models: list[str]) -> None:
    """A review queue as CSV: one value column per model and an empty label."""
    wide = df.groupBy(*keys).pivot("model", models).agg(F.first("value"))
    wide.select(*keys, *(F.col(m).alias(f"{m}_value") for m in models), F.lit("").alias("label")).write.mode("overwrite").option("header", True).csv(path)


def read_labels(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Labels of a queue; rows without one are left out."""
    df = spark.read.option("header", True).csv(path)
    missing = [c for c in [*keys, "label"] if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return df.where(F.trim("label") != "").select(*keys, "label")


def write_documents(df: DataFrame, path: str, *order: str) -> int:
    """A small summary as one JSON document, a list of its rows, indented, letters of all scripts kept; how many rows.
    Rows are fetched a partition at a time."""
    rows = [json.loads(r[0]) for r in df.orderBy(*order).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()]
    text = json.dumps(rows, ensure_ascii=False, indent=2)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return len(rows)


def config_hash(config: Any) -> str:
    """The first 16 hex digits of the SHA-256 of canonical JSON."""
    text = json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def stale(wanted: DataFrame, artifacts: DataFrame, keys: list[str], *hashes: str) -> DataFrame:
    """Rows of `wanted` whose artifact is missing or was made from other inputs or another configuration."""
    return wanted.join(artifacts.select(*keys, *hashes).distinct(), [*keys, *hashes], "left_anti")


def route(path: Column, patterns: list[tuple[str, str]]) -> Column:
    """The name of the first glob pattern that a lower-cased path matches, or null."""
    out = F.lit(None).cast("string")
    for glob, name in reversed(patterns):
        regex = "^" + "".join(".*" if c == "*" else "." if c == "?" else f"\\Q{c}\\E" for c in glob.lower()) + "$"
        out = F.when(F.lower(path).rlike(regex), name).otherwise(out)
    return out


class ArtifactStore:
    """Results of stages by document, kept with the hashes of what they were made from, and made again only where those
    differ. path holds one table a stage: doc_id, config_hash, input_hash, payload (JSON)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, stage: str) -> DataFrame:
        """The last artifact of each document; empty before the first run."""
        schema = "doc_id string, config_hash string, input_hash string, payload string, run long"
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{stage}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        from ..operators.joins import latest

        return latest(self.spark.read.schema(schema).parquet(f"{self.path}/{stage}"), ["doc_id"], "run")

    def run(self, stage: str, inputs: DataFrame, config: Any, compute) -> DataFrame:
        """Artifacts of all inputs (doc_id, payload): compute, a function of such a DataFrame to one like it, sees only those
        whose input or configuration is new. Fresh ones are read, and new ones appended, which a failure leaves undone."""
        h = config_hash(config)
        wanted = inputs.select("doc_id", F.col("payload").alias("_in"), content_hash(F.col("payload")).alias("input_hash"), F.lit(h).alias("config_hash"))
        known = self.read(stage)
        todo = stale(wanted, known, ["doc_id"], "config_hash", "input_hash")
        made = compute(todo.select("doc_id", F.col("_in").alias("payload"))).select("doc_id", "payload")
        number = (known.agg(F.coalesce(F.max("run"), F.lit(0))).first()[0]) + 1
        rows = made.join(todo.select("doc_id", "config_hash", "input_hash"), "doc_id").select("doc_id", "config_hash", "input_hash", "payload", F.lit(number).cast("long").alias("run"))
        rows.write.mode("append").parquet(f"{self.path}/{stage}")
        return self.read(stage).join(wanted.select("doc_id"), "doc_id", "left_semi").select("doc_id", "payload")


def done_ids(log: DataFrame, id: str = "id", error: str = "error") -> DataFrame:
    """Ids that a log holds without an error: what a resumed run skips."""
    return log.where(F.col(error).isNull()).select(id).distinct()


def refuse_secrets(df: DataFrame, pattern: str) -> DataFrame:
    """df, unless any of its texts matches the pattern: then reading it fails."""
    hit = F.lit(False)
    for f in df.schema:
        if isinstance(f.dataType, StringType):
            hit = hit | F.coalesce(F.col(f.name).rlike(pattern), F.lit(False))
    return df.where(F.when(hit, F.raise_error(F.lit("a record holds what looks like a secret")).cast("boolean")).otherwise(F.lit(True)))


def pdf_route(fonts: Column) -> Column:
    """digital or scanned, by a font listing: digital if any line follows its two header lines."""
    return F.when(F.size(F.filter(F.slice(F.split(fonts, "\n"), 3, 1 << 20), lambda x: F.trim(x) != "")) > 0, "digital").otherwise("scanned")
