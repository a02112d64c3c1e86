"""A corpus pipeline of five stages over `documents`: toxicity, near duplicates, repeated passages, benchmark
passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
one's docs. All but the last return the columns of documents; columns that documents has besides are carried along.
An empty table passes through; null texts count as empty; null and repeated ids are kept apart by their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm import decontamination, jaccard, packing, substrings, toxicity
from parchment.llm.common import Scratch, table


def _folded(docs: DataFrame) -> DataFrame:
    """(rest, text): all other columns as one, so that columns which operators add can't clash with them."""
    return docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("rest"), "text")


def _unfolded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from labels, scores at 0.5 or more go."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return _unfolded(toxicity.score(_folded(docs), lexicon, keep_text=True).where("score < 0.5"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more of their five-word shingles, the one with the
    smallest id stays. Documents meet by bits of their SimHash fingerprints."""
    return jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that stand anywhere else too are cut out of all texts; n_chars follows."""
    found = substrings.remove_repeats(_folded(docs), characters=True).withColumnRenamed("kept", "text")
    out = _unfolded(found, docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of any benchmark item go; an item of fewer words than a window is one window, which any
    text may hold by chance, so of such items two are asked for."""
    benchmark = table(spark, sf_dir, "benchmark")
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"), F.lit(0)))
    found = decontamination.decontaminate(_folded(docs), benchmark.where(words >= decontamination.WINDOW))
    found = found.where(F.size("hit_items") == 0)
    if not benchmark.where(words < decontamination.WINDOW).isEmpty():
        found = decontamination.decontaminate(found.select("rest", "text"), benchmark).where(F.size("hit_items") < 2)
    return _unfolded(found, docs.columns)



def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: Learned scores, byte strings, hashes and token ids: no stage can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.put(stage(spark, docs, sf_dir), f"stage{k}")
        scratch.drop(f"stage{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
