"""Packing by lexical retrieval.

Documents are tokenised once into a written table. Shards of it, of bounded size, each build a BM25 inverted index
over token ids, with document frequencies of the whole corpus. A window opens with a seed document; the index
returns the seed's best neighbours that are still unused, and they fill the window greedily. What doesn't fit of
the last one opens the next window. Only a shard's last window is padded.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, nullable, table

LENGTH, END = 1024, 0
#: Tokens of a shard, and a seed's highest-weighted terms that query the index.
SHARD_TOKENS, TERMS = 1_500_000, 12
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?:\s|$)")


class Ids(dict):
    """Token ids of a word with the space before it, as little-endian 16-bit bytes. Texts are cut at such spaces, where
    the tokenizer's own pattern always cuts too, so words can be looked up. Forgets all at a bound."""

    def __init__(self, vocabulary: str | None = None, most: int = 400_000):
        import public_tokenizers
        import tiktoken

        with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.most = most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = np.array(self.encode(f" {word}"), np.uint16).tobytes()
        if len(word) < 40:
            self[word] = out
        return out

    def plain(self, text: str) -> bytes:
        first, *words = _CUT.split(text) if _ODD.search(text) else text.split(" ")
        return np.array(self.encode(first), np.uint16).tobytes() + b"".join(map(self.__getitem__, words))

    def of(self, text: str) -> bytes:
        """The ids of a text; the name of the special token is that token, as in the tokenizers library."""
        if SPECIAL not in text:
            return self.plain(text)
        return np.array([SPECIAL_ID], np.uint16).tobytes().join(self.plain(t) if t else b"" for t in text.split(SPECIAL))


def tokenise(docs: DataFrame, scratch: Scratch, id: str, text: str, vocabulary: str | None) -> tuple[DataFrame, DataFrame]:
    """(doc, ids) with 16-bit ids and the end id for each row, and (token, df, n, tokens) of the corpus."""
    def run(batches):
        ids, df, n, size = Ids(vocabulary), np.zeros(1 << 16, np.int64), 0, 0
        end = np.array([END], np.uint16).tobytes()
        for batch in batches:
            column = batch.column(text)
            for i in range(0, len(column), 512):
                out = [ids.of(t or "") + end for t in column[i : i + 512].to_pylist()]
                for x in out:
                    df[np.unique(np.frombuffer(x, np.uint16))] += 1
                n, size = n + len(out), size + sum(map(len, out)) // 2
                yield pa.RecordBatch.from_arrays([batch.column(id)[i : i + 512], pa.array(out, pa.binary()), pa.nulls(len(out), pa.binary())], names=["doc", "ids", "df"])
        # The task's document frequencies ride along as one row.
        facts = np.concatenate([df, [n, size]]).tobytes()
        if n:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, batch.column(id).type), pa.nulls(1, pa.binary()), pa.array([facts], pa.binary())], names=["doc", "ids", "df"])

    schema = nullable(docs.select(F.col(id).alias("doc"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("df")))
    both = scratch.put(docs.select(id, text).mapInArrow(run, schema), "tokens")

    def add(batches):
        total = np.zeros((1 << 16) + 2, np.int64)
        for batch in batches:
            for x in batch.column("df"):
                total += np.frombuffer(x.as_py(), np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["token", "df"])

    facts = both.where("df is not null").select("df").mapInArrow(add, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))
    return both.where("ids is not null").select("doc", "ids"), facts


class Index:
    """BM25 over one shard. postings: documents and weights by term; a document's query is its TERMS strongest terms."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, terms: int, k1: float = 1.2, b: float = 0.75):
        sizes = np.array([len(d) for d in docs])
        owner = np.repeat(np.arange(len(docs)), sizes)
        key, tf = np.unique(owner << 16 | np.concatenate(docs).astype(np.int64), return_counts=True)
        doc, term = key >> 16, key & 0xFFFF
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[doc] / mean))
        order = np.lexsort((doc, -weight, doc))
        shared = np.bincount(term, minlength=1 << 16)[term[order]] > 1  # terms of one document find no neighbour
        rank = np.cumsum(shared) - 1
        first = np.searchsorted(doc[order], np.arange(len(docs)))
        before = np.concatenate([[0], np.cumsum(shared)])[first]
        pick = shared & (rank - before[doc[order]] < terms)
        self.queries = np.split(term[order][pick], np.searchsorted(doc[order][pick], np.arange(1, len(docs))))
        by_term = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[by_term], weight[by_term]
        self.at = np.searchsorted(term[by_term], np.arange((1 << 16) + 1))

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """Unused documents that share a term with the seed, best first, ties by place."""
        spans = [slice(self.at[t], self.at[t + 1]) for t in self.queries[seed].tolist()]
        if spans:
            docs, weights = np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans])
            free = ~used[docs]
            found, inverse = np.unique(docs[free], return_inverse=True)
            scores = np.bincount(inverse, weights[free], len(found))
            for d in found[np.lexsort((found, -scores))].tolist():
                if not used[d]:
                    yield d


def arrange(docs: list[np.ndarray], idf: np.ndarray, mean: float, length: int, terms: int = TERMS) -> list[int]:
    """The order in which a shard's documents go into its windows."""
    index, used, order = Index(docs, idf, mean, terms), np.zeros(len(docs), bool), []
    fill, seed, rest = 0, None, 0
    while rest < len(docs) or seed is not None:
        if seed is None:
            while rest < len(docs) and used[rest]:
                rest += 1
            if rest == len(docs):
                break
            seed = rest
            used[seed] = True
            order.append(seed)
            fill = (fill + len(docs[seed])) % length
        last = None
        if fill:
            for d in index.neighbours(seed, used):
                used[d] = True
                order.append(d)
                fill += len(docs[d])
                if fill >= length:
                    fill, last = fill % length, d
                    break
        # A neighbour that was cut opens the next window; else the next unused document does.
        seed = last if fill else None
    return order


def pieces(ids: list[bytes], idf: np.ndarray, mean: float, length: int, first_sequence: int, terms: int = TERMS) -> Iterator[tuple]:
    """(place, start, length, crc32, tokens, sequence, offset) of each piece of a shard's documents."""
    docs = [np.frombuffer(x, np.uint16) for x in ids]
    at = 0
    for d in arrange(docs, idf, mean, length, terms):
        wide, start = docs[d].astype("<u4"), 0
        while start < len(wide):
            n = min(len(wide) - start, length - at % length)
            yield d, start, n, zlib.crc32(wide[start : start + n].tobytes()), len(wide), first_sequence + at // length, at % length
            start, at = start + n, at + n


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, shard_tokens: int = SHARD_TOKENS, terms: int = TERMS, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece.

    A document's ids are its text's, then END; null and empty texts are END alone. Repeated rows are packed each.
    Sequences are gapless from offset 0 and hold `length` ids, but the last of each shard. An empty table gives no
    rows. Shards are runs of about shard_tokens of the written token table, whole documents each.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    tokens, facts = tokenise(docs, scratch, id, text, vocabulary)
    total = np.zeros((1 << 16) + 2, np.int64)
    for r in facts.collect():  # one row per token of the vocabulary at most
        total[r.token] = r.df
    df, n, size = total[: 1 << 16], max(int(total[1 << 16]), 1), int(total[(1 << 16) + 1])
    shared = spark.sparkContext.broadcast((np.log1p((n - df + 0.5) / (df + 0.5)), max(size / n, 1.0)))
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches):
        idf, mean = shared.value
        sequence = TaskContext.get().partitionId() << 40
        held: list[bytes] = []
        owners: list = []
        size = 0

        def flush():
            nonlocal sequence, size
            out = list(pieces(held, idf, mean, length, sequence, terms))
            sequence = out[-1][5] + 1
            columns = list(zip(*out, strict=True))
            who = pa.concat_arrays(owners).take(pa.array(columns[0]))
            held.clear(), owners.clear()
            size = 0
            return pa.RecordBatch.from_arrays([who, *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        for batch in batches:
            column, i = batch.column("ids"), 0
            for j in range(len(batch)):
                held.append(column[j].as_py())
                size += len(held[-1]) // 2
                if size >= shard_tokens:
                    owners.append(batch.column("doc")[i : j + 1])
                    i = j + 1
                    yield flush()
            if i < len(batch):
                owners.append(batch.column("doc")[i:])
        if held:
            yield flush()

    return tokens.mapInArrow(run, PIECES.format(id=docs.schema[id].dataType.simpleString()))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_packing: the contract's columns for every piece."""
    return pack(table(spark, sf_dir, "documents"))
