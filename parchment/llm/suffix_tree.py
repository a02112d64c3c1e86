"""Language-model scoring by a probabilistic suffix tree over words.

Contexts of one, two, ... words are grown level by level from all training text. A context and the word behind it are an
entry if they occur SUPPORT times or more together, whatever the corpus's size; the context becomes a state if its
next-word distribution diverges enough from that of its longest shorter state. Distributions are smoothed by absolute
discounting into that shorter state, down to the add-one unigram; each word is scored in the longest state that is a
suffix of its history.

The tree is nowhere whole. Text is cut into blocks; words, and contexts with their next words, are told by 64-bit hashes of
their words. A block asks for the counts of its distinct hashes, sorted and packed, by ranges of hashes (parts of bounded
size), and gets back those that are frequent enough. One block that holds an entry describes it; levels are then worked out
as tables of entries, and asked for in the same way. Tokens never travel but with their block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Scratch, crc_mod, mix, table

#: Occurrences of a context with its next word that make an entry, words of a context, nats by which a state's predictions
#: beat those of its shorter state over the training text, and the discount.
SUPPORT, DEPTH, DIVERGENCE, DISCOUNT = 8, 3, 12.0, 0.75
#: Text bytes of a block, and tokens of the corpus for each part, whose hashes meet in one task. A block asks every part in a
#: row of its own, so rows grow with blocks times parts; LEAST_PARTS are for small corpora, with PART_LEAST tokens or more each.
BLOCK_BYTES, PART_KEYS = 8 << 20, 4 << 20
LEAST_PARTS, PART_LEAST = 64, 1 << 16
#: In how many passes parts are counted, and blocks meet their replies: a pass's shuffle files and input go before the next begins.
PASSES = 4
#: In how many rounds level 1's pairs, the most of all, are asked for, by ranges of parts: a round's asks go before the next
#: ones are made.
ROUNDS = 2
#: The end of a document among words, of which none holds white space.
END = b"\n"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


#: One of each a process, as making them takes longer than packing a short array.
PACKER, UNPACKER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(x: np.ndarray) -> bytes:
    """Numbers as bytes, all first bytes before all second ones and so on, which packs far better."""
    return PACKER.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(UNPACKER.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def parts_for(tokens: int, part_keys: int = PART_KEYS) -> int:
    """Into how many ranges of hashes the asks of a corpus of so many tokens fall."""
    return max(1, -(-tokens // part_keys), min(LEAST_PARTS, tokens // PART_LEAST))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As np.unique with places and inverse, of numbers from 0 on: each is sorted in one number with its place, if they fit."""
    n = len(x)
    bits = max(n - 1, 1).bit_length()
    if not n or int(x.max()) >> (64 - bits):
        return np.unique(x, return_index=True, return_inverse=True)
    both = np.sort((x.astype(np.uint64) << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
    at = (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    both >>= np.uint64(bits)
    new = np.ones(n, bool)
    new[1:] = both[1:] != both[:-1]
    of = np.empty(n, np.int64)
    of[at] = np.cumsum(new) - 1
    return both[new].astype(x.dtype), at[new], of


def join_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context followed by a word, of their hashes."""
    return mix(context * np.uint64(0x9E3779B97F4A7C15) + mix(word))


@contextmanager
def one_row_a_batch(spark: SparkSession):
    """Rows of several megabytes reach Python workers one by one."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: What a step gives: rows of state (body), of asks (part, keys; n: counts, or null where values are wanted), and of entries.
STEP = {"block": pa.int64(), "part": pa.int32(), "keys": pa.binary(), "n": pa.binary(), "body": pa.list_(pa.binary()), "ctx": pa.int64(), "times": pa.int64(), "short": pa.float64(), "of": pa.int64()}
STEP_DDL = "block long, part int, keys binary, n binary, body array<binary>, ctx long, times long, short double, of long"


def _rows(kind: pa.DataType, docs: list | None = None, **columns: list) -> pa.Table:
    """Rows of STEP and docs, from lists of some columns; the others are null."""
    n = max(map(len, columns.values()))
    cols = [pa.array(columns.get(c, [None] * n), t) for c, t in STEP.items()]
    return pa.table([*cols, pa.array([docs] * n, pa.list_(kind))], names=[*STEP, "docs"])


def _ask(block: int, keys: np.ndarray, n: np.ndarray | None, parts: int, kind: pa.DataType) -> pa.Table:
    """Rows that ask for sorted hashes, one for each part that they fall in."""
    at = part_of(keys, parts)
    cut = np.flatnonzero(np.diff(at, prepend=-1)).tolist()
    runs = list(zip(cut, [*cut[1:], len(keys)], strict=True)) if cut else []
    counts = [None if n is None else pack(n[s:e]) for s, e in runs]
    return _rows(kind, block=[block] * len(runs), part=at[cut].tolist(), keys=[pack_keys(keys[s:e]) for s, e in runs], n=counts)


REPLY = {"block": pa.int64(), "part": pa.int32(), "what": pa.int32(), "at": pa.binary(), "v": pa.binary(), "lead": pa.binary()}
REPLY_DDL = "block long, part int, what int, at binary, v binary, lead binary"
COUNTS, VALUES = 0, 1


def _replies(rows: list[tuple], what: int) -> pa.Table:
    block, part, at, v, lead = zip(*rows, strict=True) if rows else [()] * 5
    return pa.table([pa.array(c, t) for c, t in zip((block, part, [what] * len(block), at, v, lead), REPLY.values(), strict=True)], names=list(REPLY))


def _answers(replies: pa.Table, what: int, keys: np.ndarray, parts: int, *kinds) -> list[np.ndarray]:
    """Places among the sorted hashes that were asked for, and what was answered for each."""
    mine = replies.filter(pc.equal(replies.column("what"), what))
    first = np.searchsorted(part_of(keys, parts), np.arange(parts + 1)) if len(keys) else np.zeros(parts + 1, np.int64)
    got = [[np.zeros(0, np.int64)], *([np.zeros(0, k)] for k in kinds)]
    for part, at, v, lead in zip(*(mine.column(c).to_pylist() for c in ("part", "at", "v", "lead")), strict=True):
        got[0].append(np.cumsum(unpack(at, np.int32), dtype=np.int64) + first[part])
        for held, data, k in zip(got[1:], (v, lead), kinds, strict=False):
            held.append(unpack(data, k))
    order = np.argsort(np.concatenate(got[0]), kind="stable")
    return [np.concatenate(g)[order] for g in got]


def counted(asks: DataFrame, least: int) -> DataFrame:
    """Replies to asks for counts: of each block's hashes those with `least` or more in all blocks, how many, and whether this
    block is the first to hold it. With least 0 all are answered. Block -1 tells how many hashes of a part occur."""

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("block").to_numpy())))
        held = [unpack_keys(k) for k in t.column("keys").to_pylist()]
        _, first, of = np.unique(np.concatenate(held), return_index=True, return_inverse=True)
        total = np.bincount(of, np.concatenate([unpack(x, np.int32) for x in t.column("n").to_pylist()])).astype(np.int64)
        lead = np.zeros(len(of), np.uint8)
        lead[first] = 1
        each, out, s = total[of], [], 0
        for block, part, m in zip(t.column("block").to_pylist(), t.column("part").to_pylist(), map(len, held), strict=True):
            at = np.flatnonzero(each[s : s + m] >= least)
            if len(at):
                out.append((block, part, pack(np.diff(at, prepend=0).astype(np.int32)), pack(each[s : s + m][at]), pack(lead[s : s + m][at])))
            s += m
        none = pack(np.zeros(1, np.int32))
        return _replies([*out, (-1, t.column("part")[0].as_py(), none, pack(np.array([(total > 0).sum()])), none)], COUNTS)

    return asks.select("block", "part", "keys", "n").groupBy("part").applyInArrow(run, REPLY_DDL)


def answered(asks: DataFrame, known: DataFrame, parts: int, only: int | None = None) -> DataFrame:
    """Replies to asks for values, of a table (key, value) with each key once. only: the pass whose parts alone are asked."""
    mine = F.shiftright(F.shiftrightunsigned("key", 32) * parts, 32).cast("int")

    def run(t: pa.Table, known: pa.Table) -> pa.Table:
        keys, values, out = known.column("key").to_numpy().view(np.uint64), known.column("value").to_numpy(), []
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        for block, part, k in zip(*(t.column(c).to_pylist() for c in ("block", "part", "keys")), strict=True):
            want = unpack_keys(k)
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == want) if len(keys) else at[:0]
            if len(hit):
                out.append((block, part, pack(np.diff(hit, prepend=0).astype(np.int32)), pack(values[at[hit]]), None))
        return _replies(out, VALUES)

    known = known.select("key", "value", mine.alias("p"))
    known = known if only is None else known.where(F.col("p") % PASSES == only)
    return asks.select("block", "part", "keys").groupBy("part").cogroup(known.groupBy("p")).applyInArrow(run, REPLY_DDL)


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """One row per block: its documents; packed, whether each is learned from, how many tokens it has, the tokens as
    numbers, and of each number the word's hash and count in learned documents; and how many tokens are there and learned."""
    schema = docs.select(F.lit(0).cast("long").alias("block"), F.array("doc").alias("docs"), F.array(F.lit(None).cast("binary")).alias("body"), F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("learned")).schema
    lower = bytes(LOWER)

    def run(batches):
        block, numbers, size, kind = TaskContext.get().partitionId() << 32, _Numbers(), 0, None
        rows: list[tuple] = []

        def flush():
            nonlocal block, numbers, size, rows
            ids, learn = np.concatenate([r[2] for r in rows]), np.array([r[1] for r in rows], bool)
            sizes = np.array([len(r[2]) for r in rows], np.int32)
            order = np.argsort(-np.bincount(ids, minlength=len(numbers)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            counts = np.bincount(ids[np.repeat(learn, sizes)], minlength=len(numbers)).astype(np.int32)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
            body = [pack(learn.view(np.uint8)), pack(sizes), pack(rank[ids]), pack(hashes[order]), pack(counts[order])]
            out = pa.RecordBatch.from_arrays([pa.array([block]), pa.array([[r[0] for r in rows]], pa.list_(kind)), pa.array([body], pa.list_(pa.binary())), pa.array([len(ids)]), pa.array([int(counts.sum())])], names=schema.names)
            block, numbers, size, rows = block + 1, _Numbers(), 0, []
            return out

        for batch in batches:
            kind = batch.column("doc").type
            for doc, learn, raw in zip(batch.column("doc").to_pylist(), batch.column("learn").to_pylist(), batch.column("text"), strict=True):
                raw = (raw.as_py() or "").encode()
                words = raw.translate(lower).split()
                words.append(END)
                rows.append((doc, learn, np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))))
                size += len(raw) + 200
                if size >= block_bytes:
                    yield flush()
        if rows:
            yield flush()

    return docs.select("doc", "learn", "text").mapInArrow(run, schema)


class Level:
    """What a block knows at one level. Of its live tokens, those whose context is an entry of the level before: place,
    document, word (-1: makes no entry here), context, probability so far, and whether they are learned from. Of contexts hash
    and count, and of frequent words the hash."""

    FIELDS = {"place": np.int32, "doc": np.int32, "word": np.int32, "context": np.int32, "p": np.float64, "learn": np.uint8, "keys": np.uint64, "counts": np.int64, "words": np.uint64}

    def __init__(self, **arrays: np.ndarray):
        for name, kind in self.FIELDS.items():
            setattr(self, name, np.asarray(arrays[name], kind))

    @classmethod
    def first(cls, word: np.ndarray, learned: np.ndarray, counts: np.ndarray, words: np.ndarray, sizes: np.ndarray, whole: int) -> Level:
        """Level 1, of all tokens of documents of these sizes: contexts are the words before, or the end, and probabilities
        those of the unigram; rare words keep theirs apart, as only the weights that states leave to it go with them."""
        starts, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        end = np.flatnonzero(words == np.uint64(xxhash.xxh3_64_intdigest(END)))
        context = np.concatenate([[-1], word[:-1]]).astype(np.int32)
        context[starts] = end[0] if len(end) else -1
        at = np.flatnonzero(context >= 0)
        p = np.append((counts + 1) / whole, 1.0)[word[at]]  # -1 is the last
        return cls(place=at, doc=doc[at], word=word[at], context=context[at], p=p, learn=learned[doc[at]], keys=words, counts=counts, words=words)

    def pairs(self) -> tuple[np.ndarray, ...]:
        """(tokens whose word may make an entry, the place of each one's pair, and of each pair, in the order of hashes: hash,
        occurrences in learned documents, a token that holds it)."""
        on = np.flatnonzero(self.word >= 0)
        width = max(len(self.words), 1)
        pair, first, of = distinct(self.context[on].astype(np.int64) * width + self.word[on])
        n = np.bincount(of[self.learn[on] > 0], minlength=len(pair)).astype(np.int32)
        hashes = join_keys(self.keys[pair // width], self.words[pair % width])
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return on, rank[of], hashes[order], n[order], on[first][order]

    def asked(self, parts: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of one round's pairs, in order, and their occurrences in learned documents: as of pairs(), but only these are
        put in order."""
        on = np.flatnonzero(self.word >= 0)
        width = max(len(self.words), 1)
        pair, _, of = distinct(self.context[on].astype(np.int64) * width + self.word[on])
        n = np.bincount(of[self.learn[on] > 0], minlength=len(pair)).astype(np.int32)
        hashes = join_keys(self.keys[pair // width], self.words[pair % width])
        mine = np.flatnonzero(part_of(hashes, parts) * ROUNDS // parts == turn)
        mine = mine[np.argsort(hashes[mine])]
        return hashes[mine], n[mine]

    def entry(self, on: np.ndarray, pair: np.ndarray, at: np.ndarray, pairs: int) -> np.ndarray:
        """Which of the pairs at these places each token's pair is, or -1. on, pair: as of pairs(), of so many pairs."""
        held = np.full(pairs, -1, np.int32)
        held[at] = np.arange(len(at), dtype=np.int32)
        entry = np.full(len(self.word), -1, np.int32)
        entry[on] = held[pair]
        return entry

    def used(self) -> tuple[np.ndarray, np.ndarray]:
        """The contexts that tokens have, and their hashes, which ask for what weight they keep, in the order of those."""
        seen = np.zeros(len(self.keys), bool)
        seen[self.context] = True
        at = np.flatnonzero(seen)
        order = np.argsort(self.keys[at])
        return at[order], self.keys[at][order]

    def applied(self, entry: np.ndarray, counts: np.ndarray, at: np.ndarray, keep: np.ndarray, discount: float) -> np.ndarray:
        """The tokens' probabilities in this level's states. entry: the entry of each token, or -1; counts: of entries; at, keep:
        which of the used contexts are states, and what weight each keeps for its shorter state. What an entry adds in a state
        follows from its count and that of its context."""
        kept = np.full(len(self.keys), np.nan)
        kept[self.used()[0][at]] = keep
        weight = kept[self.context]
        on = np.flatnonzero(~np.isnan(weight))
        p = self.p.copy()
        p[on] *= weight[on]
        on = on[entry[on] >= 0]
        p[on] += np.maximum(counts[entry[on]] - discount, 0.0) / np.maximum(self.counts[self.context[on]], 1)
        return p

    def next(self, entry: np.ndarray, entries: np.ndarray, counts: np.ndarray, p: np.ndarray) -> Level:
        """The level of tokens behind one whose context and word are an entry, which is their context. A longer context with
        its word occurs no more often than the shorter one with that word: if this is no entry, neither is that."""
        at = np.flatnonzero((self.place[1:] == self.place[:-1] + 1) & (self.doc[1:] == self.doc[:-1]) & (entry[:-1] >= 0)) + 1
        word = np.where(entry[at] >= 0, self.word[at], -1)
        return Level(place=self.place[at], doc=self.doc[at], word=word, context=entry[at - 1], p=p[at], learn=self.learn[at], keys=entries, counts=counts, words=self.words)


#: Packed arrays of a block's documents: tokens, known tokens, score of the unigram, score of tokens that no level has.
HEAD = (np.int32, np.int64, np.float64, np.float64)


#: Packed arrays of which level 1 is made: of all tokens the word, of documents whether they are learned from, and of words
#: count and hash.
FIRST = (np.int32, np.uint8, np.int64, np.uint64)


class Block:
    """A block's state between steps: arrays by document, those of level 1, and of each level done which of its pairs are
    entries, with their counts, and, of all but the last, which of its contexts are states, with the weights they keep.
    Tokens, contexts and probabilities of longer levels follow from these, as pairs of a level are always in the same order:
    a state grows with the text, and hardly with how much of it is frequent."""

    def __init__(self, state: pa.Table, whole: int, discount: float = DISCOUNT):
        state = state.combine_chunks()
        self.block, self.body = state.column("block")[0].as_py(), state.column("body")[0].as_py()
        self.docs, self.kind = state.column("docs"), state.column("docs").type.value_type
        self.head = [unpack(b, t) for b, t in zip(self.body[: len(HEAD)], HEAD, strict=True)]
        n = len(HEAD) + 1 + len(FIRST)
        first = [unpack(b, t) for b, t in zip(self.body[len(HEAD) + 1 : n], FIRST, strict=True)]
        self.level, self.discount, self.done = Level.first(*first, self.head[0], whole), discount, int(self.body[len(HEAD)])
        self.place, self.doc, self.p = self.level.place, self.level.doc, self.level.p.copy()
        self.entry = self.entries = self.counts = None
        for k in range(self.done):
            if k:
                self._longer(np.cumsum(unpack(self.body[n], np.int32), dtype=np.int64), unpack(self.body[n + 1], np.float32))
                n += 2
            on, pair, keys, _, _ = self.level.pairs()
            at, self.counts = np.cumsum(unpack(self.body[n], np.int32), dtype=np.int64), unpack(self.body[n + 1], np.int64)
            self.entry, self.entries = self.level.entry(on, pair, at, len(keys)), keys[at]
            n += 2

    def _applied(self, at: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """Probabilities in the last level's states; those of all its tokens go into p."""
        p = self.level.applied(self.entry, self.counts, at, keep, self.discount)
        self.p[np.searchsorted(self.place, self.level.place)] = p
        return p

    def _longer(self, at: np.ndarray, keep: np.ndarray) -> None:
        self.level = self.level.next(self.entry, self.entries, self.counts, self._applied(at, keep))

    def _told(self, replies: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray]:
        at, keep = _answers(replies, VALUES, self.level.used()[1], parts, np.float64)
        return at, keep.astype(np.float32)

    def longer(self, replies: pa.Table, parts: int) -> None:
        """To the next level, by replies on the last one's contexts, which the state holds from now on."""
        at, keep = self._told(replies, parts)
        self.body = [*self.body, pack(np.diff(at, prepend=0).astype(np.int32)), pack(keep)]
        self._longer(at, keep)

    def scores(self, replies: pa.Table, parts: int) -> np.ndarray:
        """The scores of documents, after the last level."""
        if self.done:
            self._applied(*self._told(replies, parts))
        return self.head[3] + np.bincount(self.doc, np.log10(self.p), len(self.head[3]))

    def row(self, at: np.ndarray, counts: np.ndarray) -> pa.Table:
        """The state with the last level's entries, by their places among its pairs."""
        n = len(HEAD)
        body = [*self.body[:n], b"%d" % (self.done + 1), *self.body[n + 1 :], pack(np.diff(at, prepend=0).astype(np.int32)), pack(counts)]
        return _rows(self.kind, self.docs[0].as_py(), block=[self.block], body=[body])


def lm_score(docs: DataFrame, learn, id: str = "doc_id", text: str = "text", support: int = SUPPORT, depth: int = DEPTH, divergence: float = DIVERGENCE, discount: float = DISCOUNT, block_bytes: int = BLOCK_BYTES, part_keys: int = PART_KEYS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    learn: a Column, True for rows to learn from (null: no). Null texts are empty and hold the end alone. base_score
    is the add-one unigram's log10 probability, score the tree's. With nothing to learn from, both are log10(1). Words with
    equal 64-bit hashes count as one (of a billion distinct words, a chance of 3 % that any two do)."""
    scratch = Scratch(docs.sparkSession, "suffixtree")
    rows = docs.select(F.col(id).alias("doc"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text).alias("text"))
    made = _blocks(rows, block_bytes)
    # Blocks are numbered within their partitions: dealt in turn, passes have as many.
    turn = F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(PASSES)).cast("int")
    scratch.add(made.withColumn("turn", turn), "blocks", "turn")
    blocks = scratch.read("blocks", made.schema)
    tokens, total = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("learned"), F.lit(0))).first()
    parts = parts_for(tokens, part_keys)
    doc_type = rows.schema["doc"].dataType
    step = T.StructType([*T._parse_datatype_string(STEP_DDL).fields, T.StructField("docs", T.ArrayType(doc_type))])

    def ask_words(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body").to_pylist(), strict=True):
                keys = unpack(body[3], np.uint64)
                order = np.argsort(keys)
                yield from _ask(block, keys[order], unpack(body[4], np.int32)[order], parts, pa.int8()).select(["block", "part", "keys", "n"]).to_batches()

    def replied(name: str, replies: DataFrame) -> None:
        """Adds replies to a table by the pass in which their blocks are, or -1 for block -1."""
        scratch.add(replies.withColumn("turn", F.when(F.col("block") < 0, -1).otherwise(turn)), name, "turn")

    def replies(name: str, k: int) -> DataFrame:
        """Replies to blocks of a pass, in all rounds."""
        ddl = T._parse_datatype_string(REPLY_DDL)
        return scratch.read(f"{name}/turn={k}", ddl).union(scratch.read(f"{name}again/turn={k}", ddl))

    def occurring(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(unpack(v, np.int64)[0]) for v in batch.column("v").to_pylist()], pa.int64())], names=["n"])

    replied("words", counted(blocks.select("block", "body").mapInArrow(ask_words, "block long, part int, keys binary, n binary"), 0))
    kinds = replies("words", -1).select("v").mapInArrow(occurring, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    whole = total + kinds + 1

    def together(name: str, state: Callable[[int], DataFrame], drop: Callable[[int], str], told: str, f: Callable) -> None:
        """Each block's state with its replies, through f, in passes, as a table by kinds of rows and passes: a state is read
        again in its block's, an ask in its part's."""
        kind = F.when(F.col("body").isNotNull(), "state").when(F.col("n").isNotNull(), "counts").when(F.col("part").isNotNull(), "values").otherwise("entries")
        for k in range(PASSES):
            out = state(k).groupBy("block").cogroup(replies(told, k).groupBy("block")).applyInArrow(f, step)
            of = F.when(F.col("kind") == "state", F.lit(k)).when(F.col("part").isNotNull(), F.col("part") % PASSES).otherwise(0)
            scratch.add(out.withColumn("kind", kind).withColumn("turn", of), name, "kind", "turn")
            scratch.drop(drop(k), f"{told}/turn={k}", f"{told}again/turn={k}")

    def part(name: str, kind: str, k: int = 0) -> DataFrame:
        return scratch.read(f"{name}/kind={kind}/turn={k}", step)

    def begin(state: pa.Table, replies: pa.Table) -> pa.Table:
        """Counts of words are known: scores of the unigram, and level 1, whose contexts are the words before."""
        state = state.combine_chunks()
        body, kind = state.column("body")[0].as_py(), state.column("docs").type.value_type
        learned, sizes, ids, keys = (unpack(b, k) for b, k in zip(body, (np.uint8, np.int32, np.int32, np.uint64), strict=False))
        order = np.argsort(keys)
        at, n = _answers(replies, COUNTS, keys[order], parts, np.int64)
        c = np.zeros(len(keys), np.int64)
        c[order[at]] = n
        starts, log = np.cumsum(sizes) - sizes, np.log10((c + 1) / whole)
        often = np.flatnonzero(c >= support)
        number = np.full(len(keys), -1, np.int32)
        number[often] = np.arange(len(often), dtype=np.int32)
        word = number[ids]
        level = Level.first(word, learned, c[often], keys[often], sizes, whole)
        apart = word < 0  # and tokens without a context, whose scores are final, too
        rest = np.ones(len(ids), bool)
        rest[level.place] = False
        score = np.add.reduceat(np.where(apart | rest, log[ids], 0.0), starts)
        head = [sizes, np.add.reduceat((c[ids] > 0).astype(np.int64), starts), np.add.reduceat(log[ids], starts), score]
        block = state.column("block")[0].as_py()
        out = [_rows(kind, state.column("docs")[0].as_py(), block=[block], body=[[*map(pack, head), b"0", pack(word), pack(learned), pack(c[often]), pack(keys[often])]])]
        if depth:
            out.append(_ask(block, *level.asked(parts, 0), parts, kind))
        return pa.concat_tables(out)

    def grow(k: int) -> Callable:
        """Step k, from 1 on: entries of level k are known, and values of level k - 1."""

        def run(state: pa.Table, replies: pa.Table) -> pa.Table:
            b = Block(state, whole, discount)
            if k > 1:
                b.longer(replies, parts)
            level = b.level
            on, pair, keys, _, token = level.pairs()
            at, n, lead = _answers(replies, COUNTS, keys, parts, np.int64, np.uint8)
            mine = np.flatnonzero(lead)
            one = token[at][mine]
            out = [b.row(at, n), _ask(b.block, level.used()[1], None, parts, b.kind)]
            out.append(_rows(b.kind, ctx=level.keys[level.context[one]].view(np.int64).tolist(), times=n[mine].tolist(), short=level.p[one].tolist(), of=level.counts[level.context[one]].tolist()))
            if k < depth:
                _, _, hashes, m, _ = level.next(level.entry(on, pair, at, len(keys)), keys[at], n, level.p).pairs()
                out.append(_ask(b.block, hashes, m, parts, b.kind))
            return pa.concat_tables(out)

        return run

    def ask_again(turn: int) -> Callable:
        """Asks of level 1's later round, worked out from the states once more, one at a time."""

        def of(state: pa.RecordBatch) -> list[pa.RecordBatch]:
            b = Block(pa.Table.from_batches([state]), whole, discount)
            return _ask(b.block, *b.level.asked(parts, turn), parts, b.kind).select(["block", "part", "keys", "n"]).to_batches()

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                for i in range(len(batch)):
                    yield from of(batch.slice(i, 1))

        return run

    small = ("block", "docs", "body")
    ask = T._parse_datatype_string("block long, part int, keys binary, n binary")
    together("level0", lambda k: scratch.read(f"blocks/turn={k}", made.schema).select(*small), lambda k: f"blocks/turn={k}", "words", begin)
    scratch.drop("words")
    known = None
    for k in range(1, depth + 1):
        before, name = f"level{k - 1}", f"level{k}"
        for j in range(PASSES):
            answers = counted(part(before, "counts", j), support)
            if known is not None:
                answers = answers.unionByName(answered(part(before, "values", j), known, parts, j))
            replied(f"answers{k}", answers)
            scratch.drop(f"{before}/kind=counts/turn={j}", f"{before}/kind=values/turn={j}")
        for r in range(1, ROUNDS if k == 1 else 1):
            again = scratch.read(f"{before}/kind=state", step).select(*small).mapInArrow(ask_again(r), ask)
            with one_row_a_batch(docs.sparkSession):
                scratch.add(again.withColumn("turn", F.col("part") % PASSES), f"again{k}_{r}", "turn")
            for j in range(PASSES):
                replied(f"answers{k}again", counted(scratch.read(f"again{k}_{r}/turn={j}", ask), support))
                scratch.drop(f"again{k}_{r}/turn={j}")
        scratch.drop(f"known{k - 1}")
        together(name, lambda j, at=before: part(at, "state", j).select(*small), lambda j, at=before: f"{at}/kind=state/turn={j}", f"answers{k}", grow(k))
        known = scratch.put(_values(part(name, "entries"), divergence, discount), f"known{k}")
        scratch.drop(before, f"answers{k}", f"answers{k}again", f"{name}/kind=entries")
    out = T.StructType([T.StructField("doc_id", doc_type), *T._parse_datatype_string("n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])

    def end(state: pa.Table, replies: pa.Table) -> pa.Table:
        b = Block(state, whole, discount)
        sizes, n_known, base, _ = b.head
        return pa.table([b.docs.combine_chunks().values, pa.array(sizes.astype(np.int64)), pa.array(n_known), pa.array(np.full(len(sizes), total, np.int64)), pa.array(base), pa.array(b.scores(replies, parts))], names=out.names)

    name, told = f"level{depth}", f"answers{depth + 1}"
    for j in range(PASSES if depth else 0):
        replied(told, answered(part(name, "values", j), known, parts, j))
        scratch.drop(f"{name}/kind=values/turn={j}")
    for j in range(PASSES):
        scratch.add(part(name, "state", j).select(*small).groupBy("block").cogroup(replies(told, j).groupBy("block")).applyInArrow(end, out), "scores")
        scratch.drop(f"{name}/kind=state/turn={j}", f"{told}/turn={j}")
    scratch.drop(f"known{depth}")
    return scratch.read("scores", out)


def _values(entries: DataFrame, divergence: float, discount: float) -> DataFrame:
    """(key, value) of a level's states: the context, and what weight it keeps for the shorter state.

    entries: ctx, times, short (the word's probability in the shorter state) and of (occurrences of the context). A
    context is a state if its predictions beat the shorter state's by `divergence` nats over the training text, words
    without an entry included."""
    e = entries.select("ctx", F.col("times").cast("double").alias("n"), "short", F.greatest(F.col("of"), F.lit(1)).cast("double").alias("of"))
    e = e.withColumn("add", F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("of"))
    mass = e.groupBy("ctx").agg(F.greatest(1 - F.sum("add"), F.lit(1e-9)).alias("keep"), F.sum("n").alias("seen"))
    both = e.join(mass, "ctx").withColumn("gain", F.col("n") * F.ln((F.col("add") + F.col("keep") * F.col("short")) / F.col("short")))
    gain = both.groupBy("ctx").agg(F.sum("gain").alias("gain"), F.max("of").alias("of"), F.max("keep").alias("keep"), F.max("seen").alias("seen"))
    return gain.where(F.col("gain") + (F.col("of") - F.col("seen")) * F.ln("keep") >= divergence).select(F.col("ctx").alias("key"), F.col("keep").alias("value"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_suffix_tree: the contract's columns for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod("doc_id", 7) == 2
    found = lm_score(docs, ~held)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
