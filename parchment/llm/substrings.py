"""Exact removal of repeated byte strings, by suffix structures of bounded size.

Any window of `length` bytes keeps the smallest hash of its grams as its anchor. Two equal windows have equal
anchors at equal places, so a string can only repeat among the surroundings of equal anchors. Those are brought
together (equal surroundings once, with their count) in shards of bounded size. Each shard builds the Burrows-Wheeler
transform of its surroundings and derives common prefixes by increasing value: breadth-first, each interval boundary
found at length l is extended backwards to boundaries of length l + 1, and the search stops at the threshold. What
no boundary separates then shares at least `length` bytes.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RollingHash, Scratch, meet, mix, often_from, slices, table, text_bytes

LENGTH, GRAM = 200, 32
#: Bytes of surroundings in a shard; different surroundings of one anchor beyond which its windows are counted by
#: content hash (of 128 bits), dealt out over the cluster, as one shard can't hold them.
SHARD_BYTES, HOT = 1 << 20, 6000
#: Bytes that are searched for anchors at once; a dozen arrays of eight bytes each go with them.
CHUNK, PLACE = 1 << 18, np.uint64((1 << 23) - 1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    p = 1
    while 2 * p <= w:
        x = np.minimum(x[:-p], x[p:])
        p *= 2
    return np.minimum(x[: len(x) - (w - p)], x[w - p :]) if p < w else x


def anchors(data: np.ndarray, offsets: np.ndarray, hashes: RollingHash, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, place in row, gram hash, bytes before, bytes behind, hash of the surroundings) of every anchor.

    The surroundings are the windows whose anchor it is, which all lie in its row.
    """
    size = np.diff(offsets)
    empty = np.zeros(0, np.int64)
    if len(data) < length or size.max(initial=0) < length:
        return empty, empty, empty.view(np.uint64), empty, empty, empty.view(np.uint64)
    sums = hashes.sums(data)
    n = len(data) - gram + 1
    grams = sums[gram:] - sums[:n]
    grams *= hashes.down[:n]
    grams = mix(grams)
    least = grams & ~PLACE
    least |= np.arange(n, dtype=np.uint64)
    least = sliding_min(least, length - gram + 1)
    inside = np.zeros(len(least), bool)  # windows that lie in one row
    for s, e in zip(offsets[:-1][size >= length].tolist(), offsets[1:][size >= length].tolist(), strict=True):
        inside[s : e - length + 1] = True
    window = np.flatnonzero(inside)
    at = (least[window] & PLACE).astype(np.int64)
    del least, inside
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    at, begin, end = at[first], window[first], window[last] + length
    row = np.searchsorted(offsets, at, "right") - 1
    around = hashes.spans(sums, begin, end)
    return row, at - offsets[row], grams[at], at - begin, end - at - gram, mix(around + (at - begin).astype(np.uint64))


def row_anchors(data: np.ndarray, offsets: np.ndarray, hashes: RollingHash, length: int, gram: int, chunk: int = CHUNK):
    """anchors() of each row in turn, as (row, columns). Of rows longer than a chunk the windows are dealt out in
    runs; an anchor whose windows meet a run's end has an entry on either side."""
    for i, j in slices(offsets, chunk):
        if offsets[j] - offsets[i] <= chunk:
            found = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], hashes, length, gram)
            cut = np.searchsorted(found[0], np.arange(j - i + 1))
            for r in range(j - i):
                yield i + r, tuple(c[cut[r] : cut[r + 1]] for c in found[1:])
            continue
        parts, whole = [], data[offsets[i] : offsets[j]]
        for s in range(0, len(whole) - length + 1, chunk):
            part = whole[s : s + chunk + length - 1]
            _, at, *rest = anchors(part, np.array([0, len(part)]), hashes, length, gram)
            parts.append((at + s, *rest))
        yield i, tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def suffix_array(symbols: np.ndarray, most: int) -> np.ndarray:
    """Ranks of all suffixes of the symbols (at least 0), by prefix doubling. Suffixes that share more than `most`
    symbols go by their places."""
    n, key = len(symbols), np.zeros(len(symbols), np.int64)
    for t in range(7):
        key[: n - t] |= symbols[t:].astype(np.int64) << (9 * (6 - t))
    order = np.argsort(key).astype(np.int32)
    new = np.ones(n, bool)
    key = key[order]
    np.not_equal(key[1:], key[:-1], out=new[1:])
    del key
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
    tied, k = order[~(new & np.append(new[1:], True))].astype(np.int64), 7
    del order, new
    while len(tied):
        ahead = np.where(tied + k < n, rank[np.minimum(tied + k, n - 1)] + 1, 0) if k <= most else tied
        key = rank[tied].astype(np.int64) * (n + 1) + ahead
        sub = np.argsort(key)
        tied, key = tied[sub], key[sub]
        old, place = rank[tied], np.arange(len(tied))
        new = np.ones(len(tied), bool)
        new[1:] = np.diff(key) != 0
        group = np.ones(len(tied), bool)
        group[1:] = np.diff(old) != 0
        head = np.maximum.accumulate(np.where(group, place, 0))
        rank[tied] = old + np.maximum.accumulate(np.where(new, place, 0)) - head
        tied = tied[~(new & np.append(new[1:], True))]
        k *= 2
    return rank


def long_prefixes(symbols: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by rank, and True where one shares at least `length` symbols, none of them 0, with the one before.

    The transform is searched `step` symbols at a time, as a multi-step index does. psi[v] is the rank of suffix v
    without its first `step` symbols, the inverse of the transform's last-to-first mapping of `step` symbols.
    Boundaries of level 0 stand where the first `step` symbols differ or hold a 0. A boundary of level l within
    (psi[v - 1], psi[v]], extended backwards by the symbols that v - 1 and v share, is the boundary v of level l + 1:
    common prefixes of level l have l * step symbols and fewer than (l + 1) * step. The search ends at the threshold.
    """
    n = len(symbols)
    step = max(k for k in range(1, 9) if length % k == 0)
    sa = np.empty(n, np.int32)
    sa[rank] = np.arange(n, dtype=np.int32)
    psi = rank[np.minimum(sa + step, n - 1)]
    found = np.zeros(n, bool)
    found[0] = True
    for t in range(step):
        first = symbols[np.minimum(sa + t, n - 1)]
        found[1:] |= (first[1:] != first[:-1]) | (first[1:] == 0)
    todo = np.flatnonzero(~found).astype(np.int32)
    low, high = psi[todo - 1], psi[todo]
    del psi
    for _ in range(length // step - 1):
        seen = np.cumsum(found, dtype=np.int32)
        split = seen[high] > seen[low]
        if not split.any():
            break
        found[todo[split]] = True
        todo, low, high = todo[~split], low[~split], high[~split]
    return sa, ~found


#: Pieces of a window's reach, by which texts are told that can't hold a repeated window.
PIECES = 8


def relevant(texts: list[bytes], anchor: np.ndarray, before: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last byte) of the parts of texts in which windows of `length` bytes can repeat.

    A window that reaches between piece a and a + 1 to the left of the anchor holds a pieces there and all but a + 1
    to the right: that string must repeat at its place for the window to do.
    """
    reach = length - gram
    pieces = max(1, min(PIECES, reach))
    edges = [reach * a // pieces for a in range(pieces + 1)]
    hashes, sizes = RollingHash(13), np.array([len(t) for t in texts])
    sums = hashes.sums(np.frombuffer(b"".join(texts), np.uint8))
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    at, ends = starts + before, starts + sizes
    low, high = np.full(len(texts), 1 << 60), np.full(len(texts), -1)
    for a in range(pieces):
        s, e = at - edges[a], at + gram + (reach - edges[a + 1])
        fit = np.flatnonzero((s >= starts) & (e <= ends))
        key = hashes.spans(sums, s[fit], e[fit]) ^ mix(anchor[fit].view(np.uint64))
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        fit = fit[counts[inverse] > 1]
        low[fit] = np.minimum(low[fit], np.maximum(at[fit] - edges[a + 1], starts[fit]))
        high[fit] = np.maximum(high[fit], np.minimum(at[fit] + gram + reach - edges[a], ends[fit]))
    some = np.flatnonzero((high >= 0) & (high - low >= length))
    return some, low[some] - starts[some], high[some] - starts[some]


def repeated_windows(texts: list[bytes], anchor: np.ndarray, before: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, least and most bytes before the anchor) of windows that two texts of one anchor share at one place."""
    some, low, high = relevant(texts, anchor, before, length, gram)
    if not len(some):
        return some, some, some
    # Equal parts of equal anchors stand for each other: all their windows repeat.
    ahead = before[some] - low
    parts: dict[tuple, int] = {}
    of = np.array([parts.setdefault((a, b, texts[i][s:e]), len(parts)) for i, a, b, s, e in zip(some.tolist(), anchor[some].tolist(), ahead.tolist(), low.tolist(), high.tolist(), strict=True)])
    a, b = (np.array([k[c] for k in parts]) for c in (0, 1))
    least, most = _search([k[2] for k in parts], a, b, length)
    several = np.bincount(of) > 1
    sizes = np.array([len(k[2]) for k in parts])
    reach = np.minimum(b, length - gram)
    most[several] = reach[several]
    least[several] = np.maximum(b - (sizes - length), 0)[several]
    got = np.flatnonzero(most[of] >= 0)
    return some[got], least[of[got]], most[of[got]]


def _search(texts: list[bytes], anchor: np.ndarray, before: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the least and most bytes before the anchor of its repeated windows; most is -1 without any."""
    sizes = np.array([len(t) + 1 for t in texts])
    symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int16) + np.int16(1)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    symbols[starts + sizes - 1] = 0
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    sa, same = long_prefixes(symbols, suffix_array(symbols, 2 * int(sizes.max())), length)
    at = np.flatnonzero(same | np.append(same[1:], False))
    run = np.cumsum(~same)[at]
    place = sa[at].astype(np.int64)
    text = owner[place].astype(np.int64)
    ahead = before[text] - (place - starts[text])
    names = np.unique(anchor, return_inverse=True)[1]
    key = (run * (names.max(initial=0) + 1) + names[text]) * (length + 1) + ahead
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    text, ahead = text[twice], ahead[twice]
    least, most = np.full(len(texts), 1 << 30), np.full(len(texts), -1)
    np.minimum.at(least, text, ahead)
    np.maximum.at(most, text, ahead)
    return least, most


def _scan(docs: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """(row, doc, z, h, sh, pos, ll, rl): the other columns, compressed bytes and anchors of each row; row is unique."""
    docs = docs.select(F.struct(*([c for c in docs.columns if c != text] or [F.lit(None).cast("int").alias("none")])).alias("doc"), F.col(text).alias("text"))
    schema = docs.select(F.lit(0).cast("long").alias("row"), "doc", F.lit(None).cast("binary").alias("z"), *(F.lit(None).cast("array<long>").alias(c) for c in ("h", "sh")), *(F.lit(None).cast("array<int>").alias(c) for c in ("pos", "ll", "rl"))).schema

    def run(batches):
        hashes, squeeze, row = RollingHash(11), zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets, CHUNK):
                z, found, part, cut = [], [], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                view = memoryview(np.ascontiguousarray(part))
                for r, columns in row_anchors(part, cut, hashes, length, gram):
                    z.append(squeeze.compress(view[cut[r] : cut[r + 1]]))
                    found.append(columns)
                ends = pa.array(np.concatenate([[0], np.cumsum([len(c[0]) for c in found])]), pa.int32())
                pos, h, ll, rl, sh = (np.concatenate([c[k] for c in found]) for k in range(5))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.view(np.int64) if kind == pa.int64() else x, kind)) for x, kind in ((h, pa.int64()), (sh, pa.int64()), (pos, pa.int32()), (ll, pa.int32()), (rl, pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(z))), batch.column("doc").slice(i, j - i), pa.array(z, pa.binary()), *lists], names=["row", "doc", "z", "h", "sh", "pos", "ll", "rl"])
                row += len(z)

    return docs.mapInArrow(run, schema)


def _fetch(batches, gram: int):
    """Surroundings that rows were asked for."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        h, sh, ll, out = [], [], [], []
        for z, asked in zip(batch.column("z"), batch.column("asked").to_pylist(), strict=True):
            data = unpack.decompress(z.as_py())
            for q in asked:
                h.append(q["h"]), sh.append(q["sh"]), ll.append(q["ll"])
                out.append(data[q["pos"] - q["ll"] : q["pos"] + gram + q["rl"]])
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(sh, pa.int64()), pa.array(ll, pa.int32()), pa.array(out, pa.binary())], names=["h", "sh", "ll", "around"])


COVER = "h long, sh long, s int, e int"


def repeats(docs: DataFrame, scratch: Scratch, text: str, length: int, gram: int, shard_bytes: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """The scanned rows, and (row, spans): byte ranges (s, e) that windows with equal others cover; may overlap."""
    rows = scratch.put(_scan(docs, text, length, gram), "rows")
    places = rows.select("row", F.explode(F.arrays_zip("h", "sh", "pos", "ll", "rl")).alias("a")).select("row", "a.*")
    often = places.groupBy("h").agg(F.count("*").alias("n"), (F.min("sh") != F.max("sh")).alias("many")).where("n > 1")
    often = scratch.put(often, "often")
    most = often_from(often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    again = scratch.put(meet(places, often.select("h", "many", "n"), ["h"], most), "again")
    kinds = again.groupBy("h", "sh").agg(F.count("*").alias("n"), F.min(F.struct("row", "pos", "ll", "rl")).alias("of"), F.max("many").alias("many"))
    kinds = scratch.put(kinds, "kinds")
    scratch.drop("often")
    asked = kinds.where("many").select("of.row", F.struct("h", "sh", "of.pos", "of.ll", "of.rl").alias("q")).groupBy("row").agg(F.collect_list("q").alias("asked"))
    around = rows.select("row", "z").join(asked, "row").select("z", "asked").mapInArrow(lambda b: _fetch(b, gram), "h long, sh long, ll int, around binary")
    size = kinds.where("many").agg(F.coalesce(F.sum(F.col("of.ll") + F.col("of.rl") + gram), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))
    crowded = scratch.put(kinds.where("many").groupBy("h").count().where(F.col("count") > hot).select("h"), "crowded")
    any_hot = not crowded.isEmpty()
    if any_hot:
        around = scratch.put(around, "around")
    shared = around.join(crowded, "h", "left_anti") if any_hot else around
    shared = shared.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))

    def shard(t: pa.Table) -> pa.Table:
        h, sh, ll = (t.column(c).to_numpy() for c in ("h", "sh", "ll"))
        got, least, most = repeated_windows(t.column("around").to_pylist(), h, ll.astype(np.int64), length, gram)
        return pa.table({"h": h[got], "sh": sh[got], "s": (-most).astype(np.int32), "e": (length - least).astype(np.int32)})

    covers = shared.groupBy("shard").applyInArrow(shard, COVER)
    if any_hot:
        def windows(batches):
            for batch in batches:
                for h, sh, ll, data in zip(*(batch.column(c).to_pylist() for c in ("h", "sh", "ll", "around")), strict=True):
                    n = max(0, len(data) - length + 1)
                    seen = [xxhash.xxh3_128_digest(data[i : i + length]) for i in range(n)]
                    yield pa.RecordBatch.from_arrays([pa.array([h] * n, pa.int64()), pa.array([sh] * n, pa.int64()), pa.array(range(ll, ll - n, -1), pa.int32()), pa.array(seen, pa.binary())], names=["h", "sh", "l", "w"])

        each = scratch.put(around.join(crowded, "h").mapInArrow(windows, "h long, sh long, l int, w binary"), "windows")
        twice = scratch.put(each.groupBy("h", "l", "w").agg(F.count("*").alias("n")).where("n > 1"), "twice")
        ends = meet(each, twice, ["h", "l", "w"], most, "left_semi").groupBy("h", "sh").agg((-F.max("l")).alias("s"), (length - F.min("l")).alias("e"))
        covers = covers.union(ends.select("h", "sh", F.col("s").cast("int"), F.col("e").cast("int")))
    whole = kinds.where(F.col("n") > 1).select("h", "sh", (-F.col("of.ll")).alias("s"), (F.col("of.rl") + gram).alias("e"), "n").where(F.col("e") - F.col("s") >= length)
    numbered = covers.withColumn("n", F.lit(1).cast("long")).union(whole).groupBy("h", "sh").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n"))
    covers = scratch.put(numbered, "covers")
    spans = meet(again.select("h", "sh", "row", "pos"), covers, ["h", "sh"], most)
    spans = spans.groupBy("row").agg(F.collect_list(F.struct((F.col("pos") + F.col("s")).alias("s"), (F.col("pos") + F.col("e")).alias("e"))).alias("spans"))
    scratch.drop("kinds", "crowded", "around", "windows", "twice")
    return rows, spans


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """spans without the bytes of UTF-8 characters that they cut."""
    out = []
    for s, e in spans:
        while s < e and data[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot: int = HOT, characters: bool = False) -> DataFrame:
    """docs without `text`, with n_bytes, spans and kept (columns of these names are replaced): one row per document.

    spans are the maximal byte runs covered by `length`-byte strings that also start anywhere else, in this document
    or another, on the input as given; kept are the bytes outside them, as binary.
    With `characters`, spans leave the characters whole that they would cut, and kept is a string. Null texts are empty; texts
    shorter than `length` keep all; repeated rows are removed from each other whole.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    rows, spans = repeats(docs, scratch, text, length, gram, shard_bytes, hot)
    schema = rows.select("doc", F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast("array<struct<s:long,e:long>>").alias("spans"), F.lit(None).cast("string" if characters else "binary").alias("kept")).schema

    def cut(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, runs, kept = [], [], []
            for z, found in zip(batch.column("z"), batch.column("spans").to_pylist(), strict=True):
                data = unpack.decompress(z.as_py())
                sizes.append(len(data))
                spans = merge([(x["s"], x["e"]) for x in found or ()])
                runs.append(whole_characters(data, spans) if characters else spans)
                at, parts = 0, []
                for s, e in runs[-1]:
                    parts.append(data[at:s])
                    at = e
                kept.append(b"".join([*parts, data[at:]]))
            spans = pa.array([[{"s": s, "e": e} for s, e in r] for r in runs], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sizes, pa.int64()), spans, pa.array(kept, pa.binary()).cast(pa.string()) if characters else pa.array(kept, pa.binary())], names=["doc", "n_bytes", "spans", "kept"])

    keep = [F.col("doc")[c].alias(c) for c in docs.columns if c not in (text, "n_bytes", "spans", "kept")]
    return rows.select("row", "doc", "z").join(spans, "row", "left").select("doc", "z", "spans").mapInArrow(cut, schema).select(*keep, "n_bytes", "spans", "kept")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_substrings: the contract's columns for every document."""
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


