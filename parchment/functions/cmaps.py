"""Maps of a font's codes to text (ToUnicode), read and written as text: PDF objects stay outside.

Entries are rows. A map has at most as many as codes of two bytes, so writing one gathers a bounded list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries of a block, by the format.
BLOCK = 100
# What stands around a map's blocks.
HEAD = "/CIDInit /ProcSet findresource begin\n12 dict begin\nbegincmap\n/CIDSystemInfo << /Registry (Adobe) /Ordering (UCS) /Supplement 0 >> def\n/CMapName /Repaired-UCS def\n/CMapType 2 def\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n"
TAIL = "endcmap\nCMapName currentdict /CMap defineresource pop\nend\nend\n"
HEX, SPACE = "[0-9A-Fa-f]", r"[\s]*"


def number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def utf16(digits: Column) -> Column:
    """Text of the hex digits of its UTF-16 bytes; no digits are empty text."""
    return F.decode(F.unhex(digits), "UTF-16BE")


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def entries(df: DataFrame, cmap: str, *keys: str) -> DataFrame:
    """(keys, code, text) of maps in a column: their bfchar and bfrange entries. Of a code that a map has twice the later
    counts, ranges after single ones. A range's texts differ in their last byte, up to 255; codes beyond have none. Null maps
    and such without blocks have no rows."""
    single = F.flatten(F.transform(_all(F.col(cmap), r"(?s)beginbfchar(.*?)endbfchar", 1), lambda b: _all(b, f"<{HEX}+>{SPACE}<{HEX}*>")))
    ranges = F.flatten(F.transform(_all(F.col(cmap), r"(?s)beginbfrange(.*?)endbfrange", 1), lambda b: _all(b, rf"(?s)<{HEX}+>{SPACE}<{HEX}+>{SPACE}(?:<{HEX}*>|\[[^\]]*\])")))
    told = lambda of, is_range: F.transform(of, lambda e: F.struct(F.lit(is_range).alias("range"), e.alias("entry")))
    both = F.concat(told(single, False), told(ranges, True))
    rows = df.select(*keys, F.posexplode(both).alias("_at", "_e")).select(*keys, "_at", "_e.*")
    part = lambda k: F.get(_all(F.col("entry"), f"<({HEX}*)>", 1), F.lit(k))
    rows = rows.withColumns({"_lo": number(part(0)), "_hi": F.when(F.col("range"), number(part(1))).otherwise(number(part(0))), "_to": F.when(F.col("range"), part(2)).otherwise(part(1)), "_list": F.col("entry").endswith("]")})
    rows = rows.withColumn("_items", F.slice(_all(F.col("entry"), f"<({HEX}*)>", 1), 3, 1 << 16)).where("_hi >= _lo")
    last = number(F.right("_to", F.lit(2)))
    room = F.when(~F.col("range"), F.lit(0)).when(F.col("_list"), F.size("_items") - 1).when(F.length("_to") > 0, 255 - last).otherwise(F.col("_hi") - F.col("_lo"))
    rows = rows.withColumn("_n", F.least(F.col("_hi") - F.col("_lo"), room.cast("long"))).where("_n >= 0")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), "_n")).alias("_k"))
    counted = F.concat(F.expr("left(_to, length(_to) - 2)"), F.lpad(F.hex(last + F.col("_k")), 2, "0"))
    text = F.when(F.col("_list"), F.get("_items", F.col("_k").cast("int"))).when(F.col("range") & (F.length("_to") > 0), counted).otherwise(F.col("_to"))
    found = rows.select(*keys, (F.col("_lo") + F.col("_k")).alias("code"), utf16(text).alias("text"), "_at", "_k")
    return found.groupBy(*keys, "code").agg(F.max_by("text", F.struct("_at", "_k")).alias("text"))


def written(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, cmap): maps of rows (keys, code, text), codes of two bytes each once, in blocks in the order of codes."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("code")) - 1
    line = F.concat(F.lit("<"), F.lpad(F.hex("code"), 4, "0"), F.lit("> <"), F.hex(F.encode("text", "UTF-16BE")), F.lit(">\n"))
    blocks = rows.select(*keys, F.floor(place / BLOCK).alias("_b"), F.struct("code", line.alias("line")).alias("_l"))
    blocks = blocks.groupBy(*keys, "_b").agg(F.sort_array(F.collect_list("_l")).alias("_ls"))
    one = F.concat(F.size("_ls").cast("string"), F.lit(" beginbfchar\n"), F.array_join(F.transform("_ls", lambda x: x.line), ""), F.lit("endbfchar\n"))
    whole = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_b", one.alias("text")))).alias("_bs"))
    return whole.select(*keys, F.concat(F.lit(HEAD), F.array_join(F.transform("_bs", lambda x: x.text), ""), F.lit(TAIL)).alias("cmap"))


def decoded(texts: DataFrame, maps: DataFrame, id: str, codes: str, *keys: str) -> DataFrame:
    """(id, text) of codes (array of long) by maps (keys, code, text) of the same keys; codes that a map lacks are U+FFFD. One
    row a text: its codes are one value as well."""
    at = texts.select(id, *keys, F.posexplode_outer(codes).alias("_at", "code"))
    said = F.when(F.col("_at").isNull(), "").otherwise(F.coalesce("text", F.lit("�")))
    found = at.join(maps, [*keys, "code"], "left").select(id, F.struct("_at", said.alias("t")).alias("c"))
    return found.groupBy(id).agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.t), "").alias("text"))
