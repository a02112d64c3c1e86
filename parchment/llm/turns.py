"""Repair of conversation structure: the cheapest edits that make a conversation's roles follow a grammar.

Turns are kept, given another role, deleted or inserted, so that role initials read `(s?(ua)+)?`. Costs to go are worked
out backwards over turns and grammar states; a forward walk takes the ASCII-least edit among those that are tight, that is
whose cost and cost to go add up to the state's. A conversation's rows come to one task sorted, a batch at a time. What
stays in memory of one is a byte a row, and its turns up to CHUNK_BYTES; longer ones are written in chunks, which are
repaired in a second pass once all edits are known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, often_from, table

#: Bytes of text that a chunk of a conversation holds about, and its rows at most.
CHUNK_BYTES, CHUNK_ROWS = 4 << 20, 50_000
#: Costs of the edits, and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED_STAYS = 0, 1, 2, 5, 5
SPACES = " \t\n\x0b\x0c\r"
#: Row codes: role class by initial (s, u, a, other), and the first fault.
CLASSES = {"s": 0, "u": 1, "a": 2}
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Grammar states: nothing yet, after system, after user, after assistant. Each has one role that a rerole or insert can give.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE_OF = ("user", "user", "assistant", "user")
NEXT = (USER, USER, ASSISTANT, USER)
#: State after keeping a row of a class in a state, or none.
KEPT = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
EDITS = "DIKR"


def text_of(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone): rows damaged by the crc32 of `conv:turn` modulo 20. 0 marks the row as gone, 1 empties
    its text, 2 takes .!? out of it, 3 repeats the row, 4 makes its role user. A null counts as one space."""
    kind = F.crc32(F.concat(text_of(conv), F.lit(":"), text_of(turn)).cast("binary")) % 20
    out = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), text_of(role).alias("role"), text_of(text).alias("text"), kind.alias("kind"))
    out = out.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv", "turn", "role", "text", (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("_")).drop("_")


def flagged(rows: DataFrame) -> DataFrame:
    """rows with later: whether a row of the same conversation, role and text has an earlier turn.

    First turns are minima that each task works out before the shuffle. Keys of very many rows are met by broadcast, and
    their rows then dealt by place; all others bring few rows to a task.
    """
    keys = [F.col("conv").isNull().alias("k0"), F.xxhash64("conv").alias("k1"), F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("k2")]
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    rows = rows.select("*", *keys)
    first = rows.where("not gone").groupBy("conv", "k0", "k1", "k2").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("conv")
    most = often_from(rows.count())
    hot = F.broadcast(first.where(F.col("n") > most).select("k0", "k1", "k2", F.col("first").alias("hot")))
    rows = rows.join(hot, ["k0", "k1", "k2"], "left")
    rows = rows.withColumn("k2", F.when(F.col("hot").isNull(), F.col("k2")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))))
    rows = rows.join(first.where(F.col("n") <= most).drop("n"), ["k0", "k1", "k2"], "left")
    return rows.select("conv", "turn", "role", "text", "gone", F.coalesce(order > F.coalesce("hot", "first"), F.lit(False)).alias("later"))


def plan(codes: bytes) -> tuple[int, str]:
    """(cost, edits) of a conversation's row codes: the cheapest edits, of these the ASCII-least."""
    inf = 1 << 62
    # Of each place, two bits a state: which edit the walk takes there.
    tight = bytearray(len(codes) + 1)
    cost = [0, inf, inf, 0]
    for i in range(len(codes), -1, -1):
        if i == len(codes):
            best, letters = cost, [None] * 4
        else:
            kind, fault = codes[i] & 3, codes[i] >> 2
            stays = TRUNCATED_STAYS if fault == TRUNCATED else 0
            best, letters = [DELETE + c for c in cost], [0] * 4
            if fault not in (BLANK, DUPLICATE):
                for q in range(4):
                    to = KEPT[q][kind]
                    if to is not None and KEEP + stays + cost[to] < best[q]:
                        best[q], letters[q] = KEEP + stays + cost[to], 2
                    if REROLE + stays + cost[NEXT[q]] < best[q]:
                        best[q], letters[q] = REROLE + stays + cost[NEXT[q]], 3
        # Inserts move between states of one place: two in a row suffice, as they lead round user and assistant.
        full = best[:]
        for q in (USER, ASSISTANT, START, SYSTEM):
            full[q] = min(best[q], INSERT + min(best[NEXT[q]], INSERT + best[NEXT[NEXT[q]]]))
        for q in range(4):
            if full[q] < best[q] or (letters[q] is not None and letters[q] > 1 and full[q] == INSERT + full[NEXT[q]]):
                letters[q] = 1
        tight[i] = sum((x or 0) << 2 * q for q, x in enumerate(letters))
        cost = full
    out, i, q = [], 0, START
    while i < len(codes) or q not in (START, ASSISTANT):
        edit = tight[i] >> 2 * q & 3
        out.append(EDITS[edit])
        if edit == 1:
            q = NEXT[q]
        else:
            if edit:
                q = KEPT[q][codes[i] & 3] if edit == 2 else NEXT[q]
            i += 1
    return cost[START], "".join(out)


class Walk:
    """Applies a conversation's edits to its turns, which come in order in any portions."""

    def __init__(self, edits: str):
        self.edits, self.at, self.state = edits, 0, START

    def _inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            yield "I", ROLE_OF[self.state], ""
            self.state, self.at = NEXT[self.state], self.at + 1

    def turns(self, rows: list[tuple[str, str]], last: bool) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the repaired turns."""
        for role, text in rows:
            yield from self._inserts()
            edit = self.edits[self.at]
            self.at += 1
            if edit == "K":
                yield edit, role, text
                self.state = KEPT[self.state][CLASSES[role[0]]]
            elif edit == "R":
                yield edit, ROLE_OF[self.state], text
                self.state = NEXT[self.state]
        if last:
            yield from self._inserts()


class Conversation:
    """Counts and row codes of a conversation whose rows come in order."""

    def __init__(self):
        self.codes, self.turns = bytearray(), []
        self.held = self.chunks = self.illegal = self.distinct = 0
        self.faults, self.low, self.high, self.before = [0] * 4, None, None, None

    def add(self, turn: int | None, role: str, text: str, later: bool) -> None:
        kind = CLASSES.get(role[:1], 3)
        end = text.rstrip(SPACES)[-1:]
        if not end:
            fault = BLANK
        elif later or self.before == (turn, role, text):
            fault = DUPLICATE
        else:
            fault = SOUND if end in ".!?" else TRUNCATED
        if self.codes and (self.codes[-1] & 3, kind) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.distinct = turn, self.distinct + 1
        self.faults[fault] += 1
        self.before = (turn, role, text)
        self.codes.append(kind | fault << 2)
        self.turns.append((role, text))
        self.held += len(role) + len(text)

    def facts(self) -> dict:
        cost, edits = plan(bytes(self.codes))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATED], "illegal": self.illegal, "cost": cost, "audit": edits}


FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = "conv {id}, chunk long, last boolean, " + FACTS + ", turns array<struct<edit:string,role:string,text:string>>"


def _emit(rows: list[dict], conv: pa.DataType) -> pa.RecordBatch:
    turn = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
    fields = [("conv", conv), ("chunk", pa.int64()), ("last", pa.bool_()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("turns", turn)]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


def _structs(turns) -> list[dict]:
    return [{"edit": e, "role": r, "text": t} for e, r, t in turns]


def _read(batches: Iterator[pa.RecordBatch], chunk_bytes: int, chunk_rows: int) -> Iterator[pa.RecordBatch]:
    """Whole conversations of up to a chunk, repaired; of longer ones, their facts (chunk -1) after their chunks as they are."""
    key, now, out, size, kind = None, None, [], 0, None

    def end() -> dict:
        if not now.chunks:
            facts = now.facts()
            return {"conv": key[0], "chunk": 0, "last": True, **facts, "turns": _structs(Walk(facts["audit"]).turns(now.turns, True))}
        return {"conv": key[0], "chunk": -1, **now.facts()}

    def spill(last: bool) -> dict:
        row = {"conv": key[0], "chunk": now.chunks, "last": last, "turns": _structs(("", r, t) for r, t in now.turns)}
        now.chunks, now.turns, now.held = now.chunks + 1, [], 0
        return row

    for batch in batches:
        kind = batch.schema.field("conv").type
        for i in range(0, len(batch), 1024):
            part = batch.slice(i, 1024)
            for conv, turn, role, text, gone, later in zip(*(part.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "gone", "later")), strict=True):
                if key != (conv,):
                    if key:
                        if now.chunks:
                            out.append(spill(True))
                        out.append(end())
                    key, now = (conv,), Conversation()
                if not gone:
                    if now.turns and (now.held + len(text) > chunk_bytes or len(now.turns) >= chunk_rows):
                        out.append(spill(False))
                        yield _emit(out, kind)
                        out, size = [], 0
                    now.add(turn, role, text, later)
                    size += len(role) + len(text)
                if size > chunk_bytes and out:
                    yield _emit(out, kind)
                    out, size = [], now.held
    if key:
        if now.chunks:
            out.append(spill(True))
        out.append(end())
        yield _emit(out, kind)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs chunks of long conversations, which come by conversation and chunk after their facts."""
    walk = facts = None
    for batch in batches:
        for i in range(len(batch)):
            (row,) = batch.slice(i, 1).to_pylist()
            if row["chunk"] < 0:
                walk, facts = Walk(row["audit"]), row
                continue
            row["turns"] = _structs(walk.turns([(t["role"], t["text"]) for t in row["turns"]], row["last"]))
            if row["chunk"] == 0:
                row = facts | {"chunk": 0, "last": row["last"], "turns": row["turns"]}
            yield _emit([row], batch.schema.field("conv").type)


def repair(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """rows (conv, turn, role, text, gone) to (conv, chunk, last, gaps, blank, duplicate, truncated, illegal, cost, audit, turns).

    One row per conversation, chunk 0, with the edits of all its rows (audit) and its repaired turns; one of over a chunk
    comes in several, of which chunk 0 has the facts. Rows count by turn, nulls first; of one turn by role, then text, so
    that equal rows are adjacent. A null conversation is one of its own. Rows that are gone count for nothing, but that
    the conversation is there. Null turns make no gaps. An empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession, "turns")
    schema = REPAIRED.format(id=rows.schema["conv"].dataType.simpleString())
    by = ["conv", F.asc_nulls_first("turn"), "role", "text"]
    ordered = flagged(rows).repartition("conv").sortWithinPartitions(*by)
    first = scratch.put(ordered.mapInArrow(lambda b: _read(b, chunk_bytes, chunk_rows), schema), "read")
    long = first.where("chunk < 0 or audit is null")
    done = first.where("chunk = 0 and audit is not null")
    if long.isEmpty():
        return done
    return done.unionByName(long.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(_walk, schema))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each long conversation, whose chunks come in order, one at a time."""
    h, began = None, False
    for batch in batches:
        for i in range(len(batch)):
            part = batch.slice(i, 1)
            (row,) = part.to_pylist()
            if row["chunk"] == 0:
                h, began, kept = hashlib.sha256(), False, part.drop_columns(["chunk", "last", "turns"])
            for t in row["turns"]:
                h.update(("\n" * began + f"{t['role']}:{t['text']}").encode())
                began = True
            if row["last"]:
                yield kept.append_column("repaired_sha256", pa.array([h.hexdigest()]))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, facts, repaired_sha256) of repair()'s rows: the hash of `role:text` of all repaired turns, newline-joined."""
    names = [c.split()[0] for c in FACTS.split(", ")]
    whole = F.concat_ws("\n", F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])))
    short = repaired.where("chunk = 0 and last").select("conv", *names, F.sha2(whole, 256).alias("repaired_sha256"))
    schema = f"conv {repaired.schema['conv'].dataType.simpleString()}, {FACTS}, repaired_sha256 string"
    long = repaired.where("not (chunk = 0 and last)").repartition("conv").sortWithinPartitions("conv", "chunk")
    return short.unionByName(long.mapInArrow(_hashed, schema))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12_turns: the contract's columns for every conversation."""
    scratch = Scratch(spark, "repaired")
    repaired = scratch.put(repair(damaged(table(spark, sf_dir, "conversations"))), "repaired")
    return digests(repaired).withColumnRenamed("conv", "conv_id")


#: Letters, roles and following states of the grammar: see ROLE_OF, NEXT and KEPT.
OP12_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda crc, x: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda y, k: xor(y >> 1, 3988292384 * (y & 1)), xor(crc, x)), CAST(4294967295 AS BIGINT))) % 20 AS kind FROM conversations),
r AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE kind <> 0),
g AS (SELECT conv_id, turn, role, text, row_number() OVER w AS i FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT conv_id, turn, role, text, i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
      WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM g),
o AS MATERIALIZED (SELECT conv_id, i, role, text, left(role, 1) AS kind, fault IN (1, 2) AS goes, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS st FROM f),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated,
    count_if(i > 1 AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
back AS (SELECT conv_id, n + 1 AS i, 0 AS c0, 10 AS c1, 5 AS c2, 0 AS c3, '' AS t0, 'I' AS t1, 'I' AS t2, '' AS t3 FROM facts
  UNION ALL SELECT conv_id, i, f0, f1, f2, f3,
    CASE WHEN f0 = 2 + c0 THEN 'D' WHEN f0 = 5 + f2 THEN 'I' WHEN f0 = k0 THEN 'K' ELSE 'R' END,
    CASE WHEN f1 = 2 + c1 THEN 'D' WHEN f1 = 5 + f2 THEN 'I' WHEN f1 = k1 THEN 'K' ELSE 'R' END,
    CASE WHEN f2 = 2 + c2 THEN 'D' WHEN f2 = 5 + f3 THEN 'I' WHEN f2 = k2 THEN 'K' ELSE 'R' END,
    CASE WHEN f3 = 2 + c3 THEN 'D' WHEN f3 = 5 + f2 THEN 'I' WHEN f3 = k3 THEN 'K' ELSE 'R' END
  FROM (SELECT *, least(b0, 5 + b2, 10 + b3) AS f0, least(b1, 5 + b2, 10 + b3) AS f1, least(b2, 5 + b3, 10 + b2) AS f2, least(b3, 5 + b2, 10 + b3) AS f3 FROM (SELECT *, least(2 + c0, k0, r0) AS b0, least(2 + c1, k1, r1) AS b1, least(2 + c2, k2, r2) AS b2, least(2 + c3, k3, r3) AS b3 FROM (SELECT o.*, b.c0, b.c1, b.c2, b.c3,
      CASE WHEN NOT goes THEN CASE kind WHEN 's' THEN st + b.c1 WHEN 'u' THEN st + b.c2 END END AS k0, CASE WHEN NOT goes THEN 1 + st + b.c2 END AS r0,
      CASE WHEN NOT goes THEN CASE WHEN kind = 'u' THEN st + b.c2 END END AS k1, CASE WHEN NOT goes THEN 1 + st + b.c2 END AS r1,
      CASE WHEN NOT goes THEN CASE WHEN kind = 'a' THEN st + b.c3 END END AS k2, CASE WHEN NOT goes THEN 1 + st + b.c3 END AS r2,
      CASE WHEN NOT goes THEN CASE WHEN kind = 'u' THEN st + b.c2 END END AS k3, CASE WHEN NOT goes THEN 1 + st + b.c2 END AS r3
      FROM back b JOIN o ON o.conv_id IS NOT DISTINCT FROM b.conv_id AND o.i = b.i - 1)))),
states AS MATERIALIZED (SELECT b.*, role, text, kind FROM back b LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM b.conv_id AND o.i = b.i),
walk AS (SELECT conv_id, CAST(1 AS BIGINT) AS i, 0 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS repaired, false AS at_end FROM facts
  UNION ALL SELECT conv_id, CASE WHEN e IN ('I', '') THEN i ELSE i + 1 END, CASE WHEN e IN ('D', '') THEN q WHEN e = 'K' AND kind = 's' THEN 1 WHEN q = 2 THEN 3 ELSE 2 END, audit || e,
    CASE WHEN e IN ('D', '') THEN repaired WHEN e = 'K' THEN list_append(repaired, role || ':' || text)
      ELSE list_append(repaired, CASE WHEN q = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END) END, e = ''
  FROM (SELECT w.*, s.role, s.text, s.kind, CASE w.q WHEN 0 THEN t0 WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE t3 END AS e
    FROM walk w JOIN states s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i WHERE NOT at_end)),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.c0, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(repaired, chr(10)), '')) AS repaired_sha256
FROM every e LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN (SELECT * FROM back WHERE i = 1) b ON b.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN (SELECT * FROM walk WHERE at_end) w ON w.conv_id IS NOT DISTINCT FROM e.conv_id
"""
