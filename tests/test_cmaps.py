"""Code maps: entries of all forms, and a round trip."""

import pytest
from pyspark.sql import functions as F

from parchment.functions import cmaps

MAP = """x begincmap 2 beginbfchar
<0041> <0E01>
<0042>  <D83DDE00>
<0043> <>
endbfchar junk <0001> <0002>
2 beginbfrange
<0050> <0052> <0E10>
<0060><0062> [<0061> <00620063>
<0064>]
<00FE> <0103> <00FD>
<0041> <0041> <005A>
<0070> <0073> [<0031>]
<0081> <0080> <0031>
endbfrange
1 beginbfchar
<0044> <0044>
endbfchar"""


def test_entries(spark):
    df = spark.createDataFrame([("f", MAP), ("none", "no blocks"), ("null", None)], "font string, cmap string")
    got = {(r.font, r.code): r.text for r in cmaps.entries(df, "cmap", "font").collect()}
    want = {0x41: "Z", 0x42: "\U0001f600", 0x43: "", 0x44: "D", 0x50: "ฐ", 0x51: "ฑ", 0x52: "ฒ", 0x60: "a", 0x61: "bc", 0x62: "d", 0x70: "1", 0xFE: "ý", 0xFF: "þ", 0x100: "ÿ"}
    assert got == {("f", k): v for k, v in want.items()}


@pytest.mark.parametrize("n", [1, 100, 101, 450])
def test_round_trip(spark, n):
    rows = [("a", i * 3, chr(0x0E00 + i % 90) * (1 + i % 3) if i % 7 else "\U0001f600") for i in range(n)] + [(None, 7, "\u0000x")]
    df = spark.createDataFrame(rows, "font string, code long, text string")
    maps = cmaps.written(df.repartition(3), "font")
    assert maps.count() == 2 and maps.where("font = 'a'").first().cmap.count("beginbfchar\n<") == -(-n // 100)
    back = cmaps.entries(maps, "cmap", "font")
    assert {tuple(r) for r in back.select("font", "code", "text").collect()} == set(rows)
    texts = spark.createDataFrame([(1, "a", [0, 3, 0, 1]), (2, "a", []), (3, "b", [0])], "id int, font string, codes array<long>")
    assert {r.id: r.text for r in cmaps.decoded(texts, df.where("font is not null"), "id", "codes", "font").collect()} == {1: "\U0001f600" + (rows[1][2] if n > 1 else "�") + "\U0001f600�", 2: "", 3: "�"}
