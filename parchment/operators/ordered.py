"""Ranks, neighbours and running values inside groups of any size.

A window over a group runs in one task. Here rows are dealt by ranges of group and order, so that a large group lies in
many parts; windows run inside a part, and what a part must know of those before it travels as one row a group and part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import keep

#: Column of the group's key as one struct, in which nulls are equal, and column of the part.
KEY, PART = "_key", "_part"


def ranged(df: DataFrame, key: list[str], order: list[str | Column], parts: int | None = None) -> DataFrame:
    """df with _key and _part: parts follow each other by key, then order. Rows equal in both share a part. The table is
    written, as ranges come from samples that differ from run to run."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn(KEY, F.struct(*key)).repartitionByRange(n, KEY, *order)
    return keep(dealt.withColumn(PART, F.spark_partition_id()), "ranged")


def _inside(order: list[str | Column]):
    return Window.partitionBy(KEY, PART).orderBy(*order)


def earlier():
    """All parts of a group before the current one: as many rows as the group has parts."""
    return Window.partitionBy(KEY).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def with_rank(dealt: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """A ranged() table with each row's place in its group, from 1; rows of equal order in any order."""
    sizes = dealt.groupBy(KEY, PART).agg(F.count("*").alias("_n"))
    before = sizes.select(KEY, PART, F.coalesce(F.sum("_n").over(earlier()), F.lit(0)).alias("_before"))
    local = dealt.withColumn(name, F.row_number().over(_inside(order)).cast("long"))
    return local.join(before, [KEY, PART]).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def with_running(dealt: DataFrame, order: list[str | Column], value: str, name: str = "rank", running: str = "running") -> DataFrame:
    """with_rank(), and the sum of `value` over the rows in front of each one in its group, in the same pass."""
    sums = dealt.groupBy(KEY, PART).agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    before = sums.select(KEY, PART, *(F.coalesce(F.sum(c).over(earlier()), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_s")))
    inside = F.sum(value).over(_inside(order).rowsBetween(Window.unboundedPreceding, -1))
    local = dealt.withColumns({name: F.row_number().over(_inside(order)).cast("long"), running: F.coalesce(inside, F.lit(0))})
    out = local.join(before, [KEY, PART]).withColumns({name: F.col(name) + F.col("_n_before"), running: F.col(running) + F.col("_s_before")})
    return out.drop("_n_before", "_s_before")


def with_neighbours(dealt: DataFrame, order: list[str], values: list[str], circular: bool = False, place_in_part: str | None = None) -> DataFrame:
    """A ranged() table with structs `before` and `after`, values of the rows around each one in its group, null at its ends,
    or, if circular, of the group's other end, and `group_size`. Rows of equal order are in any order; place_in_part names a
    column of each row's place in its part, from 1, in that order."""
    value = F.struct(*values)
    w = _inside(order)
    place = F.struct(*order, value.alias("_v"))
    edges = dealt.groupBy(KEY, PART).agg(F.min(place).alias("_lo"), F.max(place).alias("_hi"), F.count("*").alias("_n"))
    by_part, whole = Window.partitionBy(KEY).orderBy(PART), Window.partitionBy(KEY)
    before, after = F.lag("_hi").over(by_part), F.lead("_lo").over(by_part)
    if circular:
        before = F.coalesce(before, F.max_by("_hi", PART).over(whole))
        after = F.coalesce(after, F.min_by("_lo", PART).over(whole))
    edges = edges.select(KEY, PART, before["_v"].alias("_from"), after["_v"].alias("_to"), F.sum("_n").over(whole).alias("group_size"))
    local = dealt.withColumns({"before": F.lag(value).over(w), "after": F.lead(value).over(w), **({} if place_in_part is None else {place_in_part: F.row_number().over(w).cast("long")})})
    out = local.join(edges, [KEY, PART])
    return out.withColumns({"before": F.coalesce("before", "_from"), "after": F.coalesce("after", "_to")}).drop("_from", "_to")


def rank(df: DataFrame, key: list[str], order: list[str | Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """df with each row's place by order among those of its key, from 1: a row_number() that splits large groups."""
    return with_rank(ranged(df, key, order, parts), order, name).drop(KEY, PART)


def neighbours(df: DataFrame, key: list[str], order: list[str], values: list[str], circular: bool = False, parts: int | None = None) -> DataFrame:
    """df with `before` and `after`, lag() and lead() of values, and `group_size`; large groups are split."""
    return with_neighbours(ranged(df, key, order, parts), order, values, circular).drop(KEY, PART)


# --- running values ----------------------------------------------------------------------------------------------
#
# What a row does to a running value is one of three maps: `set` it (to a value or null), `add` to it (null stays null),
# or `reset` it (null stays null, anything else becomes the value). The maps of rows one after the other make one such map.

SET, ADD, RESET = "set", "add", "reset"
WIDE = "decimal(30,4)"


def mapped(kind: Column, value: Column) -> Column:
    return F.struct(kind.alias("kind"), value.cast(WIDE).alias("value"))


def identity() -> Column:
    return mapped(F.lit(ADD), F.lit(0))


def applied(m: Column, running: Column) -> Column:
    """A map's result."""
    return F.when(m["kind"] == SET, m["value"]).when(running.isNull(), F.lit(None)).when(m["kind"] == ADD, running + m["value"]).otherwise(m["value"]).cast(WIDE)


def composed(df: DataFrame, m: str, by: list[str], order: str | Column, name: str) -> DataFrame:
    """df with the map of all rows of a group up to and with each one. Running windows of one specification only."""
    w = Window.partitionBy(*by).orderBy(order)
    kind, value = F.col(m)["kind"], F.col(m)["value"]
    added = F.sum(F.when(kind == ADD, value).otherwise(F.lit(0).cast(WIDE))).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast(WIDE)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_added", added)
    point = F.last(F.when(kind != ADD, F.struct(value.alias("value"), F.col("_added").alias("added"))), ignorenulls=True).over(so_far)
    fixed = F.last(F.when(kind == SET, F.struct(value.alias("value"))), ignorenulls=True).over(so_far)
    df = df.withColumns({"_point": point, "_fixed": fixed})
    since = (F.col("_point.value") + F.col("_added") - F.col("_point.added")).cast(WIDE)
    after_set = F.when(F.col("_fixed.value").isNotNull(), since)
    out = F.when(F.col("_fixed").isNotNull(), mapped(F.lit(SET), after_set)).when(F.col("_point").isNotNull(), mapped(F.lit(RESET), since)).otherwise(mapped(F.lit(ADD), F.col("_added")))
    return df.withColumn(name, out).drop("_added", "_point", "_fixed")


def running_before(rows: DataFrame, m: str, seq: str, part_seq: str, start: str, name: str = "running") -> DataFrame:
    """A ranged() table with the running value in front of each row. rows: _key, _part, a map, its order in the group and
    its part's (seq, part_seq), and the value in front of the group's first row (start, the same in all of a group's rows).
    What the parts do is asked for before their rows, so these are worked out once and written."""
    inside = composed(rows, m, [KEY, PART], seq, "_upto")
    w = Window.partitionBy(KEY, PART).orderBy(seq)
    inside = keep(inside.withColumn("_prefix", F.coalesce(F.lag("_upto").over(w), identity())), "inside")
    whole = inside.groupBy(KEY, PART).agg(F.max(F.struct(seq, "_upto"))["_upto"].alias("_map"), F.min(part_seq).alias("_at"), F.min(start).alias("_start"))
    whole = composed(whole, "_map", [KEY], "_at", "_whole")
    before = F.coalesce(F.lag("_whole").over(Window.partitionBy(KEY).orderBy("_at")), identity())
    # Written, its size is known: a short one is broadcast, and the rows stay where they are.
    carry = keep(whole.select(KEY, PART, applied(before, F.col("_start").cast(WIDE)).alias("_carry")), "carry")
    return inside.join(carry, [KEY, PART]).withColumn(name, applied(F.col("_prefix"), F.col("_carry"))).drop("_upto", "_prefix", "_carry")
