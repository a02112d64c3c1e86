"""SimHash near-duplicates by exact comparison in tiles.

Fingerprints of 64 bits within `radius` bits agree on at least AGREE of radius + AGREE bit fields. The distinct
fingerprints that share so many fields form a bucket, one for each choice of them (38 bits in ten tables for a radius of 2, so
that buckets stay small in corpora of billions); buckets are compared exactly in tiles, sorted by population count,
by numpy's exclusive-or and bit counts; pairs of tiles whose population counts differ by more than the radius are
skipped. Of the links of a tile, only a spanning forest goes on, so a group of n copies gives n - 1 rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACES, Scratch, meet, often_from, parts, slices, table, text_bytes, word_spans
from .graph import components, local_components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fields that linked fingerprints surely agree on.
AGREE = 3
#: Fingerprints of a bucket that one task compares; larger buckets are dealt out in pairs of tiles of this size.
TILE = 4096
EDGES = "a long, b long"


def shingles_of(data: np.ndarray, offsets: np.ndarray, shingle: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each shingle of each row of UTF-8 bytes, its row, and the number of shingles of each row."""
    low = LOWER[data]
    starts, ends, counts = word_spans(~SPACES[low], offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(counts), np.int64)
    # Words joined by single spaces: each word's bytes and one space behind it.
    lengths = ends - starts
    at = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    joined = np.full(int(at[-1] + lengths[-1] + 1), 0x20, np.uint8)
    shift = np.repeat(at - starts, lengths)
    source = np.flatnonzero(~SPACES[low])
    joined[source + shift] = low[source]
    per_row = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    first_word = np.concatenate([[0], np.cumsum(counts)])[:-1]
    row = np.repeat(np.arange(len(counts)), per_row)
    rank = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(per_row)])[:-1], per_row)
    head = first_word[row] + rank
    tail = np.where(counts[row] >= shingle, head + shingle - 1, first_word[row] + counts[row] - 1)
    begin, end = at[head], at[tail] + lengths[tail]
    buf, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(buf[b:e], seed) for b, e in zip(begin.tolist(), end.tolist(), strict=True)), np.uint64, len(row))
    return hashes, row, per_row


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each row of UTF-8 bytes, as int64."""
    hashes, row, per_row = shingles_of(data, offsets, shingle, seed)
    ones = np.zeros((len(per_row), 64), np.int64)
    for i in range(0, len(row), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows = row[i : i + (1 << 16)]
        cut = np.flatnonzero(np.diff(rows, prepend=-1))
        ones[rows[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    majority = (ones * 2 > per_row[:, None]).astype(np.uint8)
    return np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel().view(np.int64)


def fingerprint(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, seed: int = SEED, keep_text: bool = False) -> DataFrame:
    """docs, without `text` unless keep_text, with a column fp (long); a column of that name is replaced.

    Null, empty and blank texts have fingerprint 0; fewer words than a shingle are hashed as one sequence.
    """
    keep = [c for c in docs.columns if c != "fp" and (keep_text or c != text)]
    schema = docs.select(*keep, F.lit(0).cast("long").alias("fp")).schema

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            found = [fingerprints_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle, seed) for i, j in slices(offsets, 2 << 20)]
            fp = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), fp], names=[*keep, "fp"])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def tile_links(x: np.ndarray, y: np.ndarray | None, radius: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs within radius, one of x and one of y, or both of x. Compares tile by tile."""
    def sort(v):
        pop = np.bitwise_count(v.view(np.uint64)).astype(np.int64)
        order = np.argsort(pop, kind="stable")
        return v.view(np.uint64)[order], pop[order], order

    xs, xp, xo = sort(x)
    ys, yp, yo = (xs, xp, xo) if y is None else sort(y)
    a, b = [], []
    for i in range(0, len(xs), tile):
        xi, lo, hi = xs[i : i + tile], xp[i], xp[min(i + tile, len(xs)) - 1]
        for j in range(i if y is None else 0, len(ys), tile):
            if yp[j] - hi > radius or lo - yp[min(j + tile, len(ys)) - 1] > radius:
                continue  # no pair of these tiles can be within the radius
            near = np.bitwise_count(xi[:, None] ^ ys[None, j : j + tile]) <= radius
            p, q = np.nonzero(near)
            a.append(xo[i + p])
            b.append(yo[j + q])
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _stars(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    label = local_components(len(values), a, b)
    far = np.flatnonzero(label != np.arange(len(values)))
    return pa.RecordBatch.from_arrays([pa.array(values[far]), pa.array(values[label[far]])], names=["a", "b"])


def _bucket_links(keys: np.ndarray, values: np.ndarray, radius: int) -> pa.RecordBatch:
    """Links inside whole buckets, given in the order of keys: small ones at once, large ones in tiles."""
    pop = np.bitwise_count(values.view(np.uint64)).astype(np.int64)
    order = np.lexsort((pop, keys))
    keys, values, pop = keys[order], values[order], pop[order]
    cut = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1 if len(keys) else 0)) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(cut, len(keys)))
    a, b = [], []
    for s, n in zip(cut[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        p, q = tile_links(values[s : s + n], None, radius)
        a.append(s + p)
        b.append(s + q)
    i = np.flatnonzero(np.repeat(sizes <= 64, sizes))
    d = 0
    while len(i):
        d += 1
        i = i[i + d < len(keys)]
        i = i[(keys[i + d] == keys[i]) & (pop[i + d] - pop[i] <= radius)]
        near = i[np.bitwise_count(values[i].view(np.uint64) ^ values[i + d].view(np.uint64)) <= radius]
        a.append(near)
        b.append(near + d)
    return _stars(values, np.concatenate(a), np.concatenate(b)) if a else _stars(values, np.zeros(0, np.int64), np.zeros(0, np.int64))


def links(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): edges between the fingerprints (column fp, each once) whose components are those of all pairs within
    radius bits. Every edge lies within components of such pairs; not every pair is an edge."""
    n_fields = radius + AGREE
    edges = [64 * f // n_fields for f in range(n_fields + 1)]
    keys = []
    for chosen in combinations(range(n_fields), AGREE):
        mask = sum((1 << edges[f + 1]) - (1 << edges[f]) for f in chosen)
        keys.append(F.struct(F.lit(mask - (1 << 64) if mask >> 63 else mask).alias("mask"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("value")))
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", F.xxhash64("k.mask", "k.value").alias("key"))
    sizes = scratch.put(rows.groupBy("key").count().where("count > 1"), "sizes")
    n = parts(distinct)

    def run(batches):
        held_k, held_v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            k, v = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in ((held_k, "key"), (held_v, "fp")))
            if len(k):
                whole = int(np.searchsorted(k, k[-1]))
                yield _bucket_links(k[:whole], v[:whole], radius)
                held_k, held_v = k[whole:], v[whole:]
        if len(held_k):
            yield _bucket_links(held_k, held_v, radius)

    small = rows.join(sizes.where(F.col("count") <= tile), "key").select("key", "fp")
    found = small.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, EDGES)
    hot = sizes.where(F.col("count") > tile)
    if hot.isEmpty():
        return found
    # Large buckets: each population count is dealt into slices of about a tile by a hash; slices meet in pairs.
    big = scratch.put(rows.join(hot.select("key"), "key").withColumn("pop", F.bit_count("fp")), "big")
    cells = big.groupBy("key", "pop").count().withColumn("slices", F.ceil(F.col("count") / tile).cast("int"))
    big = big.join(cells.drop("count"), ["key", "pop"]).withColumn("slice", F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int"))
    tiles = scratch.put(cells.select("key", "pop", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")), "tiles")
    other = tiles.select("key", F.col("pop").alias("pop2"), F.col("slice").alias("slice2"))
    near = tiles.withColumn("pop2", F.explode(F.sequence(F.col("pop"), F.col("pop") + radius)))
    pairs = near.join(other, ["key", "pop2"]).where("pop2 > pop or slice2 >= slice").withColumn("unit", F.xxhash64("key", "pop", "slice", "pop2", "slice2"))
    pairs = scratch.put(pairs, "pairs")
    left = big.join(pairs.select("key", "pop", "slice", "unit"), ["key", "pop", "slice"]).select("unit", "fp", F.lit(0).alias("side"))
    right = pairs.where("pop <> pop2 or slice <> slice2").select("key", F.col("pop2").alias("pop"), F.col("slice2").alias("slice"), "unit")
    right = big.join(right, ["key", "pop", "slice"]).select("unit", "fp", F.lit(1).alias("side"))

    def compare(t: pa.Table) -> pa.Table:
        fp, side = t.column("fp").to_numpy(), t.column("side").to_numpy()
        x, y = fp[side == 0], fp[side == 1]
        if len(y):
            a, b = tile_links(x, y, radius)
            out = _stars(np.concatenate([x, y]), a, b + len(x))
        else:
            out = _stars(x, *tile_links(x, None, radius))
        return pa.Table.from_batches([out])

    return found.union(left.union(right).groupBy("unit").applyInArrow(compare, EDGES))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id, component): one row per document, in its connected component of linked fingerprints.

    component_id is the smallest doc_id of the component, component its smallest fingerprint. Equal fingerprints are linked, those of empty texts
    (0) included. Repeated rows stay; null ids belong to a component but never name it, unless it has no other.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.put(fingerprint(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), "text", shingle, seed), "fps")
    distinct = scratch.put(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    nodes = components(links(distinct.select("fp"), scratch, radius, tile), scratch)
    out = named(fps, distinct, nodes, scratch)
    scratch.drop("sizes", "distinct", "big", "tiles", "pairs")
    return out


def named(fps: DataFrame, distinct: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """What near_duplicates() returns, of rows (doc_id, fp), of (fp, least doc_id, number of rows) and components of
    fingerprints. Neither the copies of one text nor the texts of one component meet in one task."""
    members = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.col("n").alias("rows"), F.coalesce("component", "fp").alias("component"))
    names = members.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"), F.sum("rows").alias("rows"))
    names = scratch.put(names, "names")
    kinds, rows = names.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    known = meet(members, names.drop("rows"), ["component"], often_from(kinds)).select("fp", "component_id", "component", F.col("rows").alias("n"))
    return meet(fps, scratch.put(known, "named"), ["fp"], often_from(rows)).select("doc_id", "fp", "component_id", "component")


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The row with the smallest id of each component of near_duplicates(docs), all columns as they are.

    Of repeated rows one stays; a component without ids keeps one of its rows."""
    shingle, seed = options.get("shingle", SHINGLE), options.get("seed", SEED)
    return first_rows(docs, near_duplicates(docs, id, text, **options), lambda rest: fingerprint(rest, "t", shingle, seed, keep_text=True), id, text)


def first_rows(docs: DataFrame, found: DataFrame, mark, id: str, text: str) -> DataFrame:
    """The rows of docs that stay by components `found`; mark adds the column fp to rows with texts t."""
    n, ids = found.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == ids:
        stay = found.where("doc_id = component_id").select(F.col("doc_id").alias(id))
        return docs.join(stay, id, "left_semi").select(*docs.columns)
    # Ids that are null or not unique: rows are told apart by id, fingerprint and content.
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("w")).select(F.col("w.doc_id").alias("_id"), F.col("w.fp").alias("_fp"))
    rest = docs.select(F.struct(*(c for c in docs.columns if c not in (id, text))).alias("rest"), F.col(id).alias("i"), F.col(text).alias("t")) if len(docs.columns) > 2 else docs.select(F.lit(0).alias("rest"), F.col(id).alias("i"), F.col(text).alias("t"))
    near = mark(rest).join(first, F.col("i").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")))
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("i", "fp").orderBy("t"))).where("k = 1")
    return near.select(*(F.col("i").alias(c) if c == id else F.col("t").alias(c) if c == text else F.col("rest")[c].alias(c) for c in docs.columns))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_simhash: the contract's columns for every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
