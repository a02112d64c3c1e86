"""Deterministic sampling: largest-remainder quotas, stratified picks, round robin, page picks, review queues."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


def seeded(*keys: str, seed: int = 42) -> Column:
    """A pseudo-random order that depends on keys and seed alone."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *keys), 256)


def quotas(df: DataFrame, stratum: str, cap: int) -> DataFrame:
    """(stratum, size, quota): cap dealt in proportion to the strata; the largest remainders get one more, ties by
    name. All rows where there are no more than cap. Works on one row a stratum."""
    sizes = df.groupBy(F.coalesce(F.col(stratum), F.lit("")).alias(stratum)).agg(F.count("*").alias("size"))
    every = sizes.groupBy().agg(F.sum("size").alias("total"))
    share = sizes.crossJoin(F.broadcast(every)).withColumn("whole", F.floor(F.lit(cap) * F.col("size") / F.col("total")))  # one row on the right
    rest = F.pmod(F.lit(cap) * F.col("size"), F.col("total"))
    w = Window.orderBy(F.desc("rest"), stratum)
    ranked = share.withColumn("rest", rest).withColumn("rank", F.row_number().over(w)).withColumn("given", F.sum("whole").over(Window.partitionBy()))
    quota = F.when(F.col("total") <= cap, F.col("size")).otherwise(F.col("whole") + (F.col("rank") <= cap - F.col("given")).cast("long"))
    return ranked.select(stratum, "size", quota.cast("long").alias("quota"))


def stratified(df: DataFrame, stratum: str, cap: int, order: Column) -> DataFrame:
    """The first rows by `order` of each stratum, as many as its quota. Strata may be of any size."""
    named = df.withColumn(stratum, F.coalesce(F.col(stratum), F.lit("")))
    ranked = ordered.rank(named, [stratum], [order], "_rank")
    return ranked.join(quotas(df, stratum, cap).drop("size"), stratum).where("_rank <= quota").drop("_rank", "quota")


def round_robin(df: DataFrame, group: str, order: Column, n: int) -> DataFrame:
    """n rows, one of each group in turn."""
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return ranked.where(F.col("turn") <= n).orderBy("turn", group).limit(n)


def probe_pages(df: DataFrame, group: str, page: str, id: str, n: int = 5) -> DataFrame:
    """One first page per group, then more rows by id, n in all."""
    first = F.row_number().over(Window.partitionBy(group).orderBy((F.col(page) != 1), id)) == 1
    chosen = df.withColumn("chosen", first & (F.col(page) == 1))
    return chosen.orderBy(F.desc("chosen"), id).limit(n)


def compared(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, known, differs, values) of cells (keys, model, value, and normal, what is compared, if there is such a column):
    how many models have a value, whether models differ (null against a value included), and all values by model. Of a cell
    that a model gives twice its greatest value counts."""
    normal = "normal" if "normal" in cells.columns else "value"
    one = cells.groupBy(*keys, "model").agg(F.max(F.struct("value", F.col(normal).alias("normal"))).alias("v"))
    per = one.groupBy(*keys).agg(F.count("v.value").alias("known"), F.count("*").alias("n"), F.min("v.normal").alias("least"), F.max("v.normal").alias("most"), F.count("v.normal").alias("told"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "v.value")))).alias("values"))
    differs = F.coalesce(F.col("least") != F.col("most"), F.lit(False)) | ((F.col("told") < F.col("n")) & (F.col("told") > 0))
    return per.select(*keys, "known", differs.alias("differs"), "values")


def review_queue(cells: DataFrame, keys: list[str], share: float = 0.1, seed: int = 42) -> DataFrame:
    """Cells worth a look: all on which models differ, and a share of those on which they agree, by a hash. Cells that are
    null everywhere go. See compared()."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    drawn = F.crc32(text.cast("binary")) % 1000 < round(share * 1000)
    return compared(cells, keys).where("known > 0").where(F.col("differs") | drawn).select(*keys, "differs", "values")


def dense(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Rows 0 to the largest index of each key; missing ones are added with nulls."""
    every = df.groupBy(*keys).agg(F.max(index).alias("_m")).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m").cast("long"))).alias(index))
    return every.join(df.withColumn(index, F.col(index).cast("long")), [*keys, index], "left")


def bin_quotas(df: DataFrame, value: str, keys: list[str], n: int) -> DataFrame:
    """(keys, bin, size, quota) of scores in bins zero, mid and one: n rows a key in proportion to the bins, at least one
    of each that has rows. Missing rows go to the largest remainders, rows too many come off the largest quota. Works on
    three rows a key."""
    v = F.col(value)
    sizes = df.groupBy(*keys, F.when(v == 0, "zero").when(v == 1, "one").otherwise("mid").alias("bin")).agg(F.count("*").alias("size"))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        size = dict(zip(pdf["bin"], pdf["size"], strict=True))
        total = sum(size.values())
        most = min(n, total)
        quota = {b: max(1, most * s // total) for b, s in size.items()}
        for b in sorted(size, key=lambda b: (-(most * size[b] % total), b)):
            quota[b] += sum(quota.values()) < most and quota[b] < size[b]
        while sum(quota.values()) > most:
            quota[max(quota, key=lambda b: (quota[b], b))] -= 1
        return pdf.assign(quota=[quota[b] for b in pdf["bin"]])

    schema = sizes.withColumn("quota", F.lit(0).cast("long")).schema
    return sizes.groupBy(*keys).applyInPandas(settle, schema)


def seed_of(*keys: str | Column) -> Column:
    """The number of the first eight hex digits of the SHA-256 of keys joined by a bar."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *keys), 256), 1, 8), 16, 10).cast("long")
