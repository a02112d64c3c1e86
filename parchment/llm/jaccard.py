"""Near-duplicates by SimHash, at a Jaccard similarity of word shingles.

A set of shingles has a fingerprint of BITS bits, one SimHash. Those of sets of similarity s differ in a share of
arccos(2s / (1 + s)) / pi of their bits, 0.15 at 0.8. Up to BUCKET fingerprints are all compared; of more, those meet that
agree on all of some sampled bits, in as many samples (tables) as leave but MISS of the pairs of similarity 0.8 apart: for each
twofold corpus a bit more, so that buckets stay as large. Inside buckets, fingerprints are compared in tiles by numpy's
exclusive-or and bit counts, tiles being skipped by population counts; RADIUS is where sets of similarity 0.8 differ at most (all
but 1 in 100 million, and 1 in 100,000 of sets of four and five shingles, whose bits tie most often).

Each set is checked against the nearest and the smallest one within the radius. Where a bucket then still holds sets within the
radius that nothing links and that met in no earlier table, these alone bring their whole sets to the bucket's task, so that pairs
near the limit, of which there may be the square of a bucket's size, never become rows; of a bucket's links only a forest goes on. Shingles of a set are
told by 32-bit hashes: two unlike ones of 300 shingles are taken to share one in 50,000 pairs, which moves their similarity by
less than 0.002.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, parts, slices, text_bytes
from .graph import components
from .simhash import SEED, first_rows, named, shingles_of

#: Words of a shingle and the least similarity of a link, as a fraction.
SHINGLE, SIMILARITY = 5, (4, 5)
#: Minima that tell near copies among a model's few examples (toxicity); links() doesn't use them.
BANDS, ROWS = 30, 5
#: Bits of a set's fingerprint, and by how many those of linked sets differ at most.
BITS, RADIUS = 256, 76
#: Fingerprints that a bucket holds on average at most, the share of pairs at the limit that may meet in no bucket, and the
#: tables whose rows are on disk at once.
BUCKET, MISS, AT_ONCE = 1024, 1e-5, 32
#: Sets of a bucket that one task compares at once; larger ones are dealt out in pairs of tiles of this size.
TILE = 2048


def sets_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row of UTF-8 bytes in their order, where each row starts among them, and a
    hash of each row's set, 0 for an empty one."""
    hashes, row, per_row = shingles_of(data, offsets, shingle, seed)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    starts = np.searchsorted(row, np.arange(len(per_row) + 1))
    fp = np.zeros(len(per_row), np.uint64)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        fp[full] = mix(np.add.reduceat(mix(hashes), starts[full]) + np.diff(starts)[full].astype(np.uint64))
    return hashes, starts, fp


def bands_of(hashes: np.ndarray, starts: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The keys of the buckets of each set, which isn't empty: one row of `bands` numbers per set."""
    rng = np.random.default_rng(7)
    out = np.zeros((len(starts) - 1, bands), np.uint64)
    for b in range(bands):
        key = np.full(len(out), rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(rows):
            key = mix(key ^ np.minimum.reduceat(mix(hashes ^ rng.integers(0, 2**64, dtype=np.uint64)), starts[:-1]))
        out[:, b] = key
    return out


def simhash_of(hashes: np.ndarray, starts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The fingerprint of each set, which isn't empty, as rows of bits / 64 numbers: a bit is 1 if set in over half of the
    shingles' hashes."""
    size = np.diff(np.append(starts, len(hashes)))
    out = np.zeros((len(starts), bits // 64), np.uint64)
    rng = np.random.default_rng(5)
    for word in range(bits // 64):
        salt = rng.integers(0, 2**64, dtype=np.uint64)
        for i, j in slices(np.append(starts, len(hashes)), 1 << 16):
            s = starts[i:j] - starts[i]
            each = mix(hashes[starts[i] : starts[i] + int(size[i:j].sum())] ^ salt)
            ones = np.add.reduceat(np.unpackbits(each.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), s, axis=0, dtype=np.int32)
            out[i:j, word] = np.packbits(ones * 2 > size[i:j, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def shingled(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, seed: int = SEED, keep_text: bool = False, keys: bool = False, prints: bool = False) -> DataFrame:
    """docs, without `text` unless keep_text, with a column fp (long, a hash of the set of shingles, 0 for texts without words), and if
    `keys` its buckets (array<long>, empty for texts without words), and if `prints` its fingerprint, sim (binary), and the upper
    halves of its hashes, brief (array<int>), both null for texts without words."""
    keep = [c for c in docs.columns if c not in ("fp", "keys", "sim", "brief") and (keep_text or c != text)]
    extra = [F.lit(None).cast("array<long>").alias("keys")] if keys else []
    extra += [F.lit(None).cast("binary").alias("sim"), F.lit(None).cast("array<int>").alias("brief")] if prints else []
    schema = docs.select(*keep, F.lit(0).cast("long").alias("fp"), *extra).schema

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            for i, j in slices(offsets, 1 << 20):
                hashes, starts, fp = sets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle, seed)
                cols = [*(batch.column(c).slice(i, j - i) for c in keep), pa.array(fp.view(np.int64))]
                full = np.flatnonzero(np.diff(starts))
                if keys:
                    held = bands_of(hashes, np.append(starts[full], len(hashes))) if len(full) else np.zeros((0, BANDS), np.uint64)
                    at = np.concatenate([[0], np.cumsum(np.diff(starts) > 0)]) * BANDS
                    cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(held.ravel().view(np.int64))))
                if prints:
                    sim, brief = [None] * (j - i), [None] * (j - i)
                    half = (hashes >> np.uint64(32)).astype(np.uint32)
                    for r, v in zip(full.tolist(), simhash_of(hashes, starts[full]) if len(full) else (), strict=True):
                        sim[r], brief[r] = v.tobytes(), np.unique(half[starts[r] : starts[r + 1]]).view(np.int32)
                    cols += [pa.array(sim, pa.binary()), pa.array(brief, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def tables_for(sets: int, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits, tables) by which so many fingerprints meet."""
    bits = max(0, math.ceil(math.log2(max(sets, 1) / bucket)))
    if not bits:
        return 0, 1
    p, q = SIMILARITY
    share = math.acos(2 * p / (p + q)) / math.pi
    apart = np.array([math.comb(BITS, d) * share**d * (1 - share) ** (BITS - d) for d in range(BITS + 1)])
    agree = np.array([math.comb(BITS - d, bits) / math.comb(BITS, bits) for d in range(BITS + 1)])
    tables = 1
    while (apart[: RADIUS + 1] * (1 - agree[: RADIUS + 1]) ** tables).sum() > MISS:
        tables += 1
    return bits, tables


def samples(bits: int, tables: int) -> np.ndarray:
    """The sampled bits of each table, a row each."""
    rng = np.random.default_rng(11)
    return np.array([rng.choice(BITS, bits, replace=False) for _ in range(tables)], np.int64).reshape(tables, bits)


def keys_of(sim: np.ndarray, chosen: np.ndarray, first: int = 0) -> np.ndarray:
    """The buckets of fingerprints in the tables with these sampled bits, the first of which has this number: a row of numbers per
    fingerprint."""
    bits = np.unpackbits(sim.view(np.uint8).reshape(len(sim), -1), axis=1, bitorder="little")
    out = np.repeat(np.arange(first, first + len(chosen), dtype=np.int64)[None], len(sim), axis=0)
    for column in chosen.T:
        out = out * 2 + bits[:, column]
    return out


def masks_of(chosen: np.ndarray) -> np.ndarray:
    """The sampled bits of each table as a mask over fingerprints."""
    out = np.zeros((len(chosen), BITS), np.uint8)
    np.put_along_axis(out, chosen, 1, axis=1)
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def within(x: np.ndarray, y: np.ndarray | None, radius: int, tile: int = 128):
    """(rows of x, rows of y, by how many bits they differ) of all pairs within the radius, tile by tile; without y of each two
    rows of x. Tiles are skipped whose population counts are too far apart."""
    half = y is None
    popx = np.bitwise_count(x).sum(1, dtype=np.int32)
    ox = np.argsort(popx, kind="stable")
    oy, sy = ox, popx[ox]
    xs = ys = np.ascontiguousarray(x[ox].T)
    room, count = np.empty((tile, tile), np.uint64), np.empty((tile, tile), np.uint8)
    if not half:
        popy = np.bitwise_count(y).sum(1, dtype=np.int32)
        oy = np.argsort(popy, kind="stable")
        sy, ys = popy[oy], np.ascontiguousarray(y[oy].T)
    for i in range(0, len(ox), tile):
        e = min(i + tile, len(ox))
        low, high = np.searchsorted(sy, popx[ox[i]] - radius), np.searchsorted(sy, popx[ox[e - 1]] + radius, "right")
        for j in range(i if half else int(low), int(high), tile):
            f = min(j + tile, int(high))
            d = np.zeros((e - i, f - j), np.uint8)  # fewer than 256, or of opposites 0, which share no hash
            for a, b in zip(xs, ys, strict=True):
                d += np.bitwise_count(np.bitwise_xor(a[i:e, None], b[None, j:f], out=room[: e - i, : f - j]), out=count[: e - i, : f - j])
            near = d <= radius
            if half and i == j:
                near &= np.tri(e - i, f - j, -1, bool).T
            flat = np.flatnonzero(near)
            if len(flat):
                p, q = np.divmod(flat, f - j)
                yield ox[i + p], oy[j + q], d[p, q]


def unmet(sim: np.ndarray, a: np.ndarray, b: np.ndarray, before: np.ndarray) -> np.ndarray:
    """True for pairs of rows that agree on all bits of none of the masks: they met in no earlier table."""
    out, at = np.zeros(len(a), bool), np.arange(len(a))
    for mask in before:
        if not len(at):
            break
        at = at[((sim[a[at]] ^ sim[b[at]]) & mask).any(1)]
    out[at] = True
    return out


def bucket_links(part: np.ndarray, sim: np.ndarray, brief: list[np.ndarray], left: np.ndarray, right: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of a bucket that make its parts one where any left and right row of them are similar: a forest over
    the parts. Two rows that agree on all bits of a mask of `before` met in an earlier table, and aren't compared again."""
    p, q = SIMILARITY
    size = np.array([len(b) for b in brief])
    names, at = np.unique(part, return_inverse=True)
    parent = list(range(len(names)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    out_a, out_b = [], []
    for i, j, _ in within(sim[left], sim[right], RADIUS):
        a, b = left[i], right[j]
        near = (at[a] != at[b]) & (np.minimum(size[a], size[b]) * q >= np.maximum(size[a], size[b]) * p)
        a, b = a[near], b[near]
        new = unmet(sim, a, b, before)
        a, b = a[new], b[new]
        if not len(a):
            continue
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        cut = np.flatnonzero(np.diff(a, prepend=-1))
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(a)], strict=True):
            own, others = int(a[s]), b[s:e]
            home = root(int(at[own]))
            others = others[[root(k) != home for k in at[others].tolist()]]
            if not len(others):
                continue
            held = np.concatenate([brief[k] for k in others])
            place = np.searchsorted(brief[own], held)
            place[place == size[own]] = 0
            shared = np.add.reduceat((brief[own][place] == held).astype(np.int64), np.cumsum(size[others]) - size[others])
            for k in others[shared * (p + q) >= (size[own] + size[others]) * p].tolist():
                x, y = root(int(at[own])), root(int(at[k]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out_a.append(own)
                    out_b.append(k)
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


FOUND = "a long, b long"


def _pairs(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(fp[a], fp[b])), pa.array(np.maximum(fp[a], fp[b]))], names=["a", "b"])


def _arrays(t: pa.Table, *names: str) -> list:
    """Columns of a table as numpy, fingerprints as rows of numbers and briefs as a list."""
    out = [t.column(c).to_numpy() for c in names]
    sim = np.frombuffer(b"".join(t.column("sim").to_pylist()), np.uint64).reshape(len(t), BITS // 64)
    brief = t.column("brief").combine_chunks()
    flat, cut = brief.values.to_numpy().view(np.uint32), brief.offsets.to_numpy()
    return [*out, sim, [flat[s:e] for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]]


def found_links(members: DataFrame, sizes: DataFrame, tile: int, chosen: np.ndarray) -> DataFrame:
    """(a, b) of buckets (key, fp, part, rest, sim, brief): links between rows of `rest`, those outside a bucket's main part,
    and all rows of other parts. sizes (key, n, m): rows and rest of each bucket."""
    n, masks, bits = parts(members), masks_of(chosen), chosen.shape[1]

    def run(batches):
        for t in whole_buckets(batches):
            yield from buckets(t)

    def buckets(t: pa.Table):
        keys, fp, part, rest, sim, brief = _arrays(t, "key", "fp", "part", "rest")
        cut = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=True):
            where = np.arange(e - s)
            x, y = bucket_links(part[s:e], sim[s:e], brief[s:e], where[rest[s:e]], where, masks[: keys[s] >> bits])
            a.append(x + s)
            b.append(y + s)
        yield _pairs(fp, np.concatenate(a), np.concatenate(b))

    columns = ["fp", "part", "sim", "brief"]
    small = members.join(sizes.where(F.col("n") <= tile).select("key"), "key").select("key", *columns, "rest")
    found = small.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(run, FOUND)
    hot = sizes.where(F.col("n") > tile)
    if hot.isEmpty():
        return found
    # Large buckets: slices of the rest meet slices of all rows, each pair in a task of its own.
    deal = hot.select("key", F.ceil(F.col("m") / tile).cast("int").alias("sm"), F.ceil(F.col("n") / tile).cast("int").alias("sn"))
    big = members.join(deal, "key")
    slice_ = lambda c: F.pmod(F.xxhash64("fp"), F.col(c)).cast("int")
    unit = lambda i, j: F.xxhash64("key", i, j).alias("unit")
    left = big.where("rest").withColumn("i", slice_("sm")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("sn") - 1))).select(unit("i", "j"), "key", *columns, F.lit(0).alias("side"))
    right = big.withColumn("j", slice_("sn")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("sm") - 1))).select(unit("i", "j"), "key", *columns, F.lit(1).alias("side"))

    def compare(t: pa.Table) -> pa.Table:
        keys, fp, part, side, sim, brief = _arrays(t, "key", "fp", "part", "side")
        return pa.Table.from_batches([_pairs(fp, *bucket_links(part, sim, brief, np.flatnonzero(side == 0), np.flatnonzero(side == 1), masks[: keys[0] >> bits]))])

    return found.union(left.union(right).groupBy("unit").applyInArrow(compare, FOUND))


WORDS = [f"s{w}" for w in range(BITS // 64)]
KEYED = "key long, fp long, " + ", ".join(f"{w} long" for w in WORDS)


def keyed(sims: DataFrame, chosen: np.ndarray, first: int) -> DataFrame:
    """(key, fp, s0, s1, ...) of sets (fp, sim): a row for each bucket of a set, with the numbers of its fingerprint."""

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                sim = np.frombuffer(b"".join(part.column("sim").to_pylist()), np.uint64).reshape(len(part), -1)
                cols = [keys_of(sim, chosen, first).ravel(), *(np.repeat(c, len(chosen)) for c in (part.column("fp").to_numpy(), *sim.T.view(np.int64)))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "fp", *WORDS])

    return sims.mapInArrow(run, KEYED)


def _words(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.stack([t.column(w).to_numpy().view(np.uint64) for w in WORDS], axis=1)


SEEN = "key long, fp long, far int, near long, least long"


def seen(rows: DataFrame) -> DataFrame:
    """(key, fp, far, near, least) of those rows of whole buckets (key, fp, s0, s1, ...) that have others within the radius: the
    nearest, by how many bits, and the smallest."""

    def run(batches):
        return map(buckets, whole_buckets(batches))

    def buckets(t: pa.Table) -> pa.RecordBatch:
        keys, fp, sim = t.column("key").to_numpy(), t.column("fp").to_numpy(), _words(t)
        none = np.int64(1) << np.int64(62)
        best, least = np.full(len(keys), none), np.full(len(keys), none)
        cut = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=True):
            for i, j, d in within(sim[s:e], None, RADIUS):
                a, b = np.concatenate([i, j]) + s, np.concatenate([j, i]) + s
                np.minimum.at(best, a, np.concatenate([d, d]).astype(np.int64) << 32 | b)
                np.minimum.at(least, a, b)
        at = np.flatnonzero(best < none)
        far, near = best[at] >> 32, best[at] & 0xFFFFFFFF
        return pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(fp[at]), pa.array(far.astype(np.int32)), pa.array(fp[near]), pa.array(fp[least[at]])], names=["key", "fp", "far", "near", "least"])

    return rows.repartition(parts(rows), "key").sortWithinPartitions("key", "fp").mapInArrow(run, SEEN)


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in the order of their keys, with all rows of a key in one table."""
    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = held.column("key").to_numpy()
        if keys[0] != keys[-1]:
            cut = int(np.searchsorted(keys, keys[-1]))
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and len(held):
        yield held


def crossing(members: DataFrame, label: DataFrame, sims: DataFrame, chosen: np.ndarray) -> DataFrame:
    """Those of the members (key, fp) of buckets that have another of another part and a like size within the radius, whom they
    met in no earlier table: only these need their whole sets. label: (fp, component); sims: (fp, sim, size)."""
    masks, bits, (p, q) = masks_of(chosen), chosen.shape[1], SIMILARITY

    def run(batches):
        for t in whole_buckets(batches):
            keys, part, size = (t.column(c).to_numpy() for c in ("key", "part", "size"))
            sim, hit = np.frombuffer(b"".join(t.column("sim").to_pylist()), np.uint64).reshape(len(t), -1), np.zeros(len(t), bool)
            cut = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=True):
                for i, j, _ in within(sim[s:e], None, RADIUS):
                    a, b = i + s, j + s
                    other = (part[a] != part[b]) & (np.minimum(size[a], size[b]) * q >= np.maximum(size[a], size[b]) * p)
                    a, b = a[other], b[other]
                    new = unmet(sim, a, b, masks[: keys[s] >> bits])
                    hit[a[new]] = hit[b[new]] = True
            yield from t.select(["key", "fp"]).filter(pa.array(hit)).to_batches()

    placed = members.join(label, "fp", "left").withColumn("part", F.coalesce("component", "fp")).join(sims, "fp").select("key", "fp", "part", "size", "sim")
    return placed.repartition(parts(placed), "key").sortWithinPartitions("key", "fp").mapInArrow(run, "key long, fp long")


def seen_large(rows: DataFrame, label: DataFrame, scratch: Scratch, tile: int, chosen: np.ndarray) -> DataFrame:
    """(key, fp) of those rows of large buckets (key, fp, s0, s1, ...) that have others of another part within the radius, whom
    they met in no earlier table.
    Slices of the rows outside a bucket's main part meet slices of all, each pair in a task of its own."""
    placed = rows.join(label, "fp", "left").withColumn("part", F.coalesce("component", "fp")).drop("component")
    main = placed.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("m"))
    main = main.select("key", F.col("m.part").alias("main"), F.ceil((F.col("n") - F.col("m.n")) / tile).cast("int").alias("sm"), F.ceil(F.col("n") / tile).cast("int").alias("sn"))
    big = scratch.put(placed.join(F.broadcast(main.where("sm > 0")), "key"), "big")
    slice_ = lambda c: F.pmod(F.xxhash64("fp"), F.col(c)).cast("int")
    unit = F.xxhash64("key", "i", "j").alias("unit")
    columns, masks, bits = ["key", "fp", "part", *WORDS], masks_of(chosen), chosen.shape[1]
    left = big.where("part <> main").withColumn("i", slice_("sm")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("sn") - 1))).select(unit, *columns, F.lit(0).alias("side"))
    right = big.withColumn("j", slice_("sn")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("sm") - 1))).select(unit, *columns, F.lit(1).alias("side"))

    def compare(t: pa.Table) -> pa.Table:
        side, part, sim = t.column("side").to_numpy(), t.column("part").to_numpy(), _words(t)
        x, y, hit = np.flatnonzero(side == 0), np.flatnonzero(side == 1), np.zeros(len(t), bool)
        if len(x) and len(y):
            for i, j, _ in within(sim[x], sim[y], RADIUS):
                a, b = x[i], y[j]
                other = part[a] != part[b]
                a, b = a[other], b[other]
                new = unmet(sim, a, b, masks[: t.column("key")[0].as_py() >> bits])
                hit[a[new]] = hit[b[new]] = True
        return t.select(["key", "fp"]).filter(pa.array(hit))

    return left.union(right).groupBy("unit").applyInArrow(compare, "key long, fp long").distinct()


def links(rows: DataFrame, scratch: Scratch, tile: int = TILE, bucket: int = BUCKET) -> DataFrame:
    """(a, b): edges between the sets of rows (fp, sim, brief) whose components are those of all similar pairs whose
    fingerprints share a bucket.

    First each set is checked against the nearest and the smallest fingerprint within the radius, in buckets of over `tile`
    sets against the bucket's smallest. Then, of what that leaves in several parts in a bucket, sets outside the largest part
    are compared with all others."""
    sims = scratch.put(rows.where("sim is not null").select("fp", "sim", F.size("brief").alias("size")).groupBy("fp").agg(F.first("sim").alias("sim"), F.first("size").alias("size")), "sets")
    chosen = samples(*tables_for(sims.count(), bucket))
    passes = [(f, keyed(sims, chosen[f : f + AT_ONCE], f)) for f in range(0, len(chosen), AT_ONCE)]
    pairs, members, large = [], [], []
    for f, met in passes:
        hot = scratch.put(met.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("hub")).where(F.col("n") > tile).select("key", "hub"), f"hot{f}")
        small = met
        if not hot.isEmpty():
            small = met.join(F.broadcast(hot.select("key")), "key", "left_anti")
            big = met.join(F.broadcast(hot), "key")
            hubs = big.where("fp = hub").select("key", *(F.col(w).alias(f"h{w}") for w in WORDS))
            far = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"h{w}"))) for w in WORDS), F.lit(0))
            star = big.where("fp <> hub").join(F.broadcast(hubs), "key").select("fp", "hub", far.alias("far")).where(F.col("far") <= RADIUS)
            pairs.append(scratch.put(star.groupBy("fp").agg(F.min(F.struct("far", "hub")).alias("h")).select("fp", "h.far", F.col("h.hub").alias("near"), F.col("h.hub").alias("least")), f"star{f}"))
            large.append(met.join(F.broadcast(hot.select("key")), "key"))
        found = scratch.put(seen(small), f"seen{f}")
        pairs.append(found.drop("key"))
        members.append(found.select("key", "fp"))
    first = _union(pairs).groupBy("fp").agg(F.min(F.struct("far", "near")).alias("h"), F.min("least").alias("least"))
    first = first.select("fp", F.explode(F.array("h.near", "least")).alias("other"))
    near = scratch.put(_similar(first.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct(), rows, scratch), "near")
    label = components(near, Scratch(near.sparkSession, "jaccard-near")).withColumnRenamed("node", "fp")
    members = [scratch.put(crossing(_union(members), label, sims, chosen), "crossing")]
    for k, met in enumerate(large):
        members.append(scratch.put(seen_large(met, label, scratch, tile, chosen), f"large{k}"))
    placed = scratch.put(_placed(_union(members), label, sims, rows, scratch), "placed")
    sizes = scratch.put(placed.groupBy("key").agg(F.count("*").alias("n"), F.count_if("rest").alias("m")).where("m > 0"), "sizes")
    return near.union(found_links(placed, sizes, tile, chosen))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


#: Bits of a row of marks, and the rows of marks that are broadcast at most, of 4 KB each.
MARKS, MOST_MARKS = 1 << 15, 1 << 12


def _marked(rows: DataFrame, wanted: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """rows whose fp leaves the same mark as one of those wanted (fp): all with a wanted one, and few others as long as 16 marks
    a wanted one fit. Rows are told where they are, before any of them travels."""
    slots = MARKS * min(MOST_MARKS, max(1, -(-wanted.count() * 16 // MARKS)))
    slot = F.pmod("fp", F.lit(slots))
    group, place = F.floor(slot / MARKS).cast("int"), F.pmod(slot, F.lit(MARKS))
    marks = scratch.put(wanted.groupBy(group.alias("group")).agg(F.bitmap_construct_agg(place).alias("marks")), name)
    byte = F.conv(F.hex(F.substring("marks", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("group", group).join(F.broadcast(marks), "group")
    return met.where(byte.bitwiseAND(F.expr(f"shiftleft(1, cast(pmod(pmod(fp, {slots}), 8) as int))")) != 0).select(*rows.columns)


def _briefs(rows: DataFrame, wanted: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(fp, brief) of the wanted fingerprints, each once. Of other sets only those travel that leave the mark of a wanted one."""
    wanted = scratch.put(wanted.distinct(), f"{name}-wanted")
    few = _marked(rows.select("fp", "brief"), wanted, scratch, f"{name}-marks")
    # An inner join, as Spark moves a semi join below the one with the marks, where all rows travel.
    return few.join(wanted, "fp").groupBy("fp").agg(F.first("brief").alias("brief"))


def _similar(pairs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) whose sets have the similarity. Only sets of these pairs travel."""
    p, q = SIMILARITY
    pairs = scratch.put(pairs, "pairs")
    sets = scratch.put(_briefs(rows, pairs.select(F.col("a").alias("fp")).union(pairs.select("b")), scratch, "pairs"), "pair-sets")
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("brief").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("brief").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared * (p + q) >= (F.size("x") + F.size("y")) * p).select("a", "b")


def _placed(members: DataFrame, label: DataFrame, sims: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """members (key, fp) of buckets that hold more than one part of the links so far: with part, sim, brief, and rest, false
    for the bucket's largest part (of as large ones the smallest)."""
    placed = members.join(label, "fp", "left").select("key", "fp", F.coalesce("component", "fp").alias("part"))
    main = placed.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("kinds"), F.max(F.struct("n", (-F.col("part")).alias("p"))).alias("m")).where("kinds > 1")
    kept = scratch.put(placed.join(main.select("key", (-F.col("m.p")).alias("main")), "key").select("key", "fp", "part", (F.col("part") != F.col("main")).alias("rest")), "kept")
    held = _briefs(rows, kept.select("fp"), scratch, "kept").join(sims.select("fp", "sim"), "fp")
    return kept.join(held, "fp").select("key", "fp", "part", "sim", "brief", "rest")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", tile: int = TILE, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id, component) as of simhash.near_duplicates(), with fp a hash of the shingle set. Texts
    of fewer words than a shingle are one shingle; texts without words are equal."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = scratch.put(shingled(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), prints=True), "rows")
    fps = scratch.put(rows.select("doc_id", "fp"), "fps")
    distinct = scratch.put(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    edges = scratch.put(links(rows, scratch, tile, bucket), "edges")
    scratch.drop_all_but("fps", "distinct", "edges")
    out = named(fps, distinct, components(edges, scratch), scratch)
    scratch.drop("distinct", "edges", "names")
    return out


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """As simhash.one_of_each(), of the components of near_duplicates(docs)."""
    return first_rows(docs, near_duplicates(docs, id, text), lambda rest: shingled(rest, "t", keep_text=True), id, text)
