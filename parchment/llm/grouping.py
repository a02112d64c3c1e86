"""Packing whole documents into as few sequences as possible by a grouping genetic algorithm.

Genes are whole sequences, not documents. A crossover puts well-filled sequences of one parent into the other, takes out
those of the other that hold any of the same documents, and best-fits the documents that lost their place. Documents lie
in shards of bounded size; several islands breed packings of each shard, every one in a row of its own, and their elites
migrate between epochs. Sequences without any room are done. The documents of all others go on to the next
level, dealt to fewer shards, so that what each shard leaves open is filled from others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, parts, table
from .packing import END, Ids

LENGTH = 2048
#: Documents of a shard, islands that breed a shard, packings on an island, epochs, and children of an epoch.
SHARD, ISLANDS, POPULATION, EPOCHS, CHILDREN = 2048, 4, 6, 3, 30
ISLANDS_A_TASK = 16
#: A level whose open sequences hold over this share of its documents again is the last: further ones gain nothing.
SHRINKS = 0.9


def best_fit(items: list[int], open_: list[int], rooms: list[int], n: int, capacity: int) -> tuple[list[int], dict[int, int]]:
    """Puts each of some sizes, in this order, into the sequence where the least room stays, or into a new one.

    open_ are the sequences with room, rooms how much they have, n the number of all. Returns the sequence of each item, and
    the room left in those with room and the new ones, by number. Sequences wait by their room; one number whose bits are the
    rooms that occur finds the least that is large enough.
    """
    waiting: dict[int, list[int]] = {}
    bits, left_in, where = 0, dict(zip(open_, rooms)), []
    for b, r in zip(open_, rooms):
        if r in waiting:
            waiting[r].append(b)
        else:
            waiting[r] = [b]
            bits |= 1 << r
    for size in items:
        fits = bits >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            held = waiting[r]
            b = held.pop()
            if not held:
                del waiting[r]
                bits ^= 1 << r
            left = r - size
        else:
            b, left, n = n, capacity - size, n + 1
        left_in[b] = left
        where.append(b)
        if left:
            if left in waiting:
                waiting[left].append(b)
            else:
                waiting[left] = [b]
                bits |= 1 << left
    return where, left_in


class Packing:
    """A packing of a shard: the sequence of each item, and the room in each sequence."""

    def __init__(self, where: np.ndarray, room: np.ndarray):
        self.where, self.room = where, room
        #: Less is better: fewer sequences, then the room in as few of them as possible.
        self.cost = (len(room), -int(room @ room))

    @classmethod
    def of(cls, where: np.ndarray, sizes: np.ndarray, capacity: int) -> Packing:
        return cls(where, capacity - np.bincount(where, sizes).astype(np.int64))

    def ideal(self, sizes: np.ndarray, capacity: int) -> bool:
        """Nothing can be better: the least number of sequences, at most one of which has room."""
        return np.count_nonzero(self.room) <= 1 and len(self.room) == -(-int(sizes.sum()) // capacity)


def rebuilt(lost: np.ndarray, where: np.ndarray, room: np.ndarray, sizes: np.ndarray, capacity: int, noise: float, rng: np.random.Generator) -> Packing:
    """The packing (where, room), whose items `lost` have no place yet: they are best-fitted by descending size, disturbed by
    up to a share of noise. where changes in place."""
    n_kept = len(room)
    key = sizes[lost] * (1 - noise * rng.random(len(lost))) if noise else sizes[lost]
    lost = lost[np.argsort(-key, kind="stable")]
    open_ = np.flatnonzero(room)
    places, left_in = best_fit(sizes[lost].tolist(), open_.tolist(), room[open_].tolist(), n_kept, capacity)
    where[lost] = places
    after = np.zeros(max(n_kept, max(left_in, default=-1) + 1), np.int64)
    after[: n_kept] = room
    after[np.fromiter(left_in, np.int64, len(left_in))] = np.fromiter(left_in.values(), np.int64, len(left_in))
    return Packing(where, after)


def crossed(a: Packing, b: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """a with up to an eighth of b's sequences, drawn from its better-filled half, injected whole: a's sequences that hold any
    of the same items go, and what else they held is best-fitted."""
    good = np.argpartition(b.room + rng.random(len(b.room)), len(b.room) // 2)[: max(1, len(b.room) // 2)]
    chosen = np.zeros(len(b.room), bool)
    chosen[good[rng.integers(0, len(good), rng.integers(1, max(2, len(b.room) // 8 + 1)))]] = True
    inside = chosen[b.where]
    out = np.zeros(len(a.room), bool)
    out[a.where[inside]] = True
    stay = ~out
    n = int(stay.sum())
    where = np.where(inside, (n - 1 + np.cumsum(chosen))[b.where], (np.cumsum(stay) - 1)[a.where])
    lost = np.flatnonzero(out[a.where] & ~inside)
    return rebuilt(lost, where, np.concatenate([a.room[stay], b.room[chosen]]), sizes, capacity, 0, rng)


def mutated(a: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """a with some sequences that have room, and half as many that have none, dissolved and best-fitted again."""
    open_, full = np.flatnonzero(a.room), np.flatnonzero(a.room == 0)
    n = max(2, len(a.room) // 16)
    out = np.zeros(len(a.room), bool)
    for some, k in ((open_, n), (full, n // 2)):
        if len(some):
            out[some[rng.integers(0, len(some), k)]] = True
    out[np.argmax(a.room)] = True
    stay = ~out
    lost = np.flatnonzero(out[a.where])
    return rebuilt(lost, (np.cumsum(stay) - 1)[a.where], a.room[stay], sizes, capacity, 0.3 * (rng.random() < 0.5), rng)


def founders(sizes: np.ndarray, capacity: int, n: int, rng: np.random.Generator) -> list[Packing]:
    """Best fit by descending size, the first as it is, all others with disturbed sizes."""
    none, out = np.zeros(0, np.int64), []
    for k in range(n):
        out.append(rebuilt(np.arange(len(sizes)), np.zeros(len(sizes), np.int64), none, sizes, capacity, 0.4 * (k > 0), rng))
        if out[-1].ideal(sizes, capacity):
            break
    return out


def breed(population: list[Packing], sizes: np.ndarray, capacity: int, children: int, size: int, rng: np.random.Generator) -> list[Packing]:
    """An epoch of an island: children replace the worst packing where they are better. Best first."""
    population = sorted(population, key=lambda p: p.cost)[:size]
    for _ in range(children):
        if population[0].ideal(sizes, capacity):
            break
        i, j = rng.integers(0, len(population), (2, 2)).min(axis=1)
        a, b = population[i], population[j]
        child = crossed(a, b, sizes, capacity, rng) if a is not b and rng.random() < 0.5 else mutated(a, sizes, capacity, rng)
        if all(child.cost != p.cost for p in population):
            population.append(child)
            population.sort(key=lambda p: p.cost)
            del population[size:]
    return population


#: An island, or a packing that migrates to it (then without sizes): packings are their sequences as 16-bit numbers, best first.
ISLAND = "shard long, island int, migrates boolean, sizes binary, packings array<binary>, sequences long, spread double"
_ISLAND = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("migrates", pa.bool_()), ("sizes", pa.binary()), ("packings", pa.list_(pa.binary())), ("sequences", pa.int64()), ("spread", pa.float64())])


def _islands(batches: Iterator[pa.RecordBatch], seed: tuple[int, int], capacity: int, islands: int, children: int, population: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Founds or breeds islands, each of which its migrant follows, if there is one; sends each one's best to the next island
    of the shard, or, in the last epoch, gives that alone. The same rows give the same rows again."""
    now = None

    def end() -> pa.RecordBatch:
        rng = np.random.default_rng([*seed, now["shard"], now["island"]])
        sizes = np.frombuffer(now["sizes"], np.uint16).astype(np.int64)
        held = [Packing.of(np.frombuffer(x, np.uint16).astype(np.int64), sizes, capacity) for x in now["packings"] or []]
        held = breed(held or founders(sizes, capacity, population, rng), sizes, capacity, children, population, rng)
        found = [p.where.astype(np.uint16).tobytes() for p in held]
        best = {"shard": now["shard"], "packings": found[:1], "sequences": held[0].cost[0], "spread": float(held[0].cost[1])}
        if last:
            return pa.RecordBatch.from_pylist([best | {"island": now["island"]}], schema=_ISLAND)
        return pa.RecordBatch.from_pylist([now | {"packings": found}, best | {"island": (now["island"] + 1) % islands, "migrates": True}], schema=_ISLAND)

    for batch in batches:
        for i in range(len(batch)):
            (row,) = batch.slice(i, 1).to_pylist()
            if row["migrates"]:
                now["packings"] += row["packings"]
            else:
                if now:
                    yield end()
                now = row
    if now:
        yield end()


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, sizes) of shards (shard, items)."""
    for batch in batches:
        items = batch.column("items")
        flat, at = items.flatten().field("length").to_numpy(zero_copy_only=False).astype(np.uint16), items.offsets.to_numpy() - items.offsets[0].as_py()
        yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array([flat[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())], names=["shard", "sizes"])


def _placed(batches: Iterator[pa.RecordBatch], level: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """The items of shards (shard, items, packing), with their sequence, their offset there, and the room it has left."""
    for batch in batches:
        items, packings, shards = batch.column("items"), batch.column("packing"), batch.column("shard").to_pylist()
        at = items.offsets.to_numpy() - items.offsets[0].as_py()
        flat = items.flatten()
        length = flat.field("length").to_numpy(zero_copy_only=False).astype(np.int64)
        sequence, offset, room = (np.zeros(len(length), np.int64) for _ in range(3))
        for k, (i, j) in enumerate(zip(at, at[1:])):
            where, n = np.frombuffer(packings[k].as_py(), np.uint16).astype(np.int64), length[i:j]
            order = np.argsort(where, kind="stable")
            before = np.cumsum(n[order]) - n[order]
            first = np.searchsorted(where[order], where[order])
            offset[i:j][order] = before - before[first]
            room[i:j] = (capacity - np.bincount(where, n).astype(np.int64))[where]
            sequence[i:j] = (level << 56) + (shards[k] << 16) + where
        columns = {f.name: flat.field(f.name) for f in flat.type} | {"sequence_id": pa.array(sequence), "offset": pa.array(offset), "room": pa.array(room)}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def group(items: DataFrame, scratch: Scratch, capacity: int = LENGTH, shard: int = SHARD, islands: int = ISLANDS, population: int = POPULATION, epochs: int = EPOCHS, children: int = CHILDREN) -> DataFrame:
    """items (uid, length, ...) with sequence_id and offset. Lengths lie between 1 and capacity - 1; uids are distinct.

    Sequences are gapless from offset 0. An empty table gives no rows. Shards hold `shard` to twice as many items on average, by the hash of
    their uids: a third of all documents alike are dealt like any others.
    """
    names, done, level, now = items.columns, None, 0, items
    n = now.count()
    while True:
        shards = max(1, n // shard)
        deal = F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)).alias("shard")
        held = scratch.put(now.select(deal, F.struct("uid", *(c for c in names if c != "uid")).alias("item")).groupBy("shard").agg(F.sort_array(F.collect_list("item")).alias("items")), f"shards{level}")
        sizes = held.mapInArrow(_sizes, "shard long, sizes binary")
        alive = sizes.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(False).alias("migrates"), "sizes", F.lit(None).cast("array<binary>").alias("packings"))
        # About ISLANDS_A_TASK islands a task, or fewer where there aren't enough for all cores.
        spread = max(min(shards * islands, items.sparkSession.sparkContext.defaultParallelism), shards * islands // ISLANDS_A_TASK)
        for epoch in range(epochs):
            alive = alive.repartition(spread, "shard", "island").sortWithinPartitions("shard", "island", "migrates")
            alive = alive.mapInArrow(lambda b, seed=(level, epoch): _islands(b, seed, capacity, islands, children, population, seed[1] == epochs - 1), ISLAND)
        best = alive.groupBy("shard").agg(F.min_by(F.get("packings", F.lit(0)), F.struct("sequences", "spread", "island")).alias("packing"))
        schema = T.StructType([*(items.schema[c] for c in sorted(names, key=lambda c: c != "uid")), *(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "room"))])
        put = scratch.put(held.join(best, "shard").mapInArrow(lambda b, level=level: _placed(b, level, capacity), schema), f"placed{level}")
        scratch.drop(f"shards{level}")
        left = put.where("room > 0").count() if shards > 1 else 0
        last = shards == 1 or left == 0 or left > SHRINKS * n
        out = (put if last else put.where("room = 0")).drop("room")
        done = out if done is None else done.unionByName(out)
        if last:
            return done
        now, n, level = put.where("room > 0").select(*names), left, level + 1


def cut(docs: DataFrame, id: str, text: str, length: int, vocabulary: str | None) -> DataFrame:
    """(uid, doc, piece, start, length, ids_crc32): each document's ids, END last, in one piece, or in several of `length`
    ids, the first of which may be shorter."""
    def run(batches):
        ids, end = Ids(vocabulary), np.array([END], np.uint16).tobytes()
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            column, owners = batch.column(text), batch.column(id)
            for i in range(0, len(column), 512):
                owner, rows = [], []
                for k, t in enumerate(column[i : i + 512].to_pylist()):
                    x = np.frombuffer(ids.of(t or "") + end, np.uint16).astype("<u4")
                    stops = range((len(x) - 1) % length + 1, len(x) + 1, length)
                    for piece, stop in enumerate(stops):
                        first = 0 if piece == 0 else stop - length
                        owner.append(i + k)
                        rows.append((uid, piece, first, stop - first, zlib.crc32(x[first:stop].tobytes())))
                        uid += 1
                uids, piece, first, size, crc = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(uids), owners.take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(first), pa.array(size), pa.array(crc)], names=["uid", "doc", "piece", "start", "length", "ids_crc32"])

    whole = docs.select(F.col(id).alias("doc")).schema["doc"].dataType
    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("doc", whole), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    return docs.select(id, text).mapInArrow(run, schema)


def pack_whole(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, vocabulary: str | None = None, **breeding: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece.

    A document's ids are its text's, then END; null and empty texts are END alone. Only documents of over `length` ids are
    cut, from their end, into pieces of `length`, so that the first may be shorter. A piece of `length` ids is a sequence of
    its own, all others are packed by group(). Repeated rows, and null and repeated ids, are packed each. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "grouping")
    pieces = scratch.put(cut(docs, id, text, length, vocabulary), "pieces")
    full = pieces.where(F.col("length") == length).withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")})
    out = group(pieces.where(F.col("length") < length), scratch, length, **breeding).unionByName(full)
    return out.select(F.col("doc").alias(id), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11_grouping: the contract's columns for every piece."""
    return pack_whole(table(spark, sf_dir, "documents"))
