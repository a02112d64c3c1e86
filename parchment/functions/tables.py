"""Model replies to structure, and structural similarity: plain Python functions and the Arrow UDFs around them.

Spark has no tree or markup operations, so these run in Arrow batches. Each returns nulls for null input and never
raises on malformed text.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Sequence
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .distance import edit_distance
from .text import canonical, canonical_text, each

FIELDS = T.MapType(T.StringType(), T.StringType())
GRID = T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))


class _Tables(HTMLParser):
    """Tables as rows of (text, colspan, rowspan); open ones end with the text."""

    def __init__(self):
        super().__init__()
        self.tables: list[list[list[list]]] = []
        self.cell: list | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.cell = None
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
            self.cell = None
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            a = {k: v for k, v in attrs}
            span = lambda k: int(a[k]) if str(a.get(k) or "").isdigit() else 1
            self.cell = ["", span("colspan"), span("rowspan")]
            self.tables[-1][-1].append(self.cell)
        elif tag == "br" and self.cell is not None:
            self.cell[0] += " "

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0] += data


def spanned_tables(text: str) -> list[list[list[tuple[str, int, int]]]]:
    p = _Tables()
    p.feed(text or "")
    p.close()
    return [[[(c[0].strip(), c[1], c[2]) for c in row] for row in t] for t in p.tables]


def html_tables(text: str) -> list[list[list[str]]]:
    return [[[c[0] for c in row] for row in t] for t in spanned_tables(text)]


def _is_rule(line: str) -> bool:
    """A line that begins as the rule of a pipe table: a bar or none, a colon or none, three dashes."""
    return line.lstrip().removeprefix("|").lstrip().removeprefix(":").startswith("---")


def _cells(line: str) -> list[str]:
    """The cells of a pipe table's line, without the empty ones outside its outer bars."""
    cells = [c.strip() for c in line.split("|")]
    return cells[not cells[0] : len(cells) - (len(cells) > 1 and not cells[-1])]


def pipe_tables(text: str) -> list[list[list[str]]]:
    """Runs of two lines or more with bars, one of them a rule, without the rules; a rule alone is no table."""
    out, run = [], []
    for line in [*(text or "").splitlines(), ""]:
        if "|" in line:
            run.append(line)
            continue
        if len(run) >= 2 and any(map(_is_rule, run)):
            out.append([_cells(x) for x in run if not _is_rule(x)])
        run = []
    return out


def to_html(rows: Sequence[Sequence[str]]) -> str:
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in rows) + "</table>"


_OTSL = re.compile(r"<(fcel|ecel|lcel|ucel|xcel|nl)>")


def otsl_html(text: str) -> str:
    """A table of cell tokens: fcel a filled cell, ecel an empty one, lcel, ucel and xcel continue the cell to the
    left, above, or both; nl ends a row."""
    grid: list[list[tuple[str, str]]] = [[]]
    parts = _OTSL.split(text or "")
    for kind, body in zip(parts[1::2], parts[2::2], strict=True):
        if kind == "nl":
            grid.append([])
        else:
            grid[-1].append((kind, body.strip()))
    grid = [r for r in grid if r]
    kind = lambda r, c: grid[r][c][0] if r < len(grid) and c < len(grid[r]) else ""
    rows = []
    for r, row in enumerate(grid):
        cells = []
        for c, (k, body) in enumerate(row):
            if k not in ("fcel", "ecel"):
                continue
            wide, tall = 1, 1
            while kind(r, c + wide) in ("lcel", "xcel"):
                wide += 1
            while kind(r + tall, c) in ("ucel", "xcel"):
                tall += 1
            spans = (f' colspan="{wide}"' if wide > 1 else "") + (f' rowspan="{tall}"' if tall > 1 else "")
            cells.append(f"<td{spans}>{escape(body, quote=False) if k == 'fcel' else ''}</td>")
        rows.append(f"<tr>{''.join(cells)}</tr>")
    return f"<table>{''.join(rows)}</table>"


def flatten(value, key: str = "") -> dict[str, str | None]:
    """Scalars of nested JSON by dotted keys, list places as [i]."""
    if isinstance(value, dict):
        return {k: v for name, x in value.items() for k, v in flatten(x, f"{key}.{name}" if key else str(name)).items()}
    if isinstance(value, list):
        return {k: v for i, x in enumerate(value) for k, v in flatten(x, f"{key}[{i}]").items()}
    return {key: value if value is None or isinstance(value, str) else json.dumps(value)}


_FENCE = re.compile(r"^\s*```(?:json)?\s*|\s*```\s*$", re.I)


def _load(x: str):
    """Flat fields of JSON text that may have commas before its closing brackets; None if it is no JSON."""
    for y in (x, re.sub(r",\s*(?=[}\]])", "", x)):
        try:
            return flatten(json.loads(y))
        except ValueError:
            continue
    return None


def _skip(text: str, i: int) -> int:
    while i < len(text) and text[i].isspace():
        i += 1
    return i


def _number_end(text: str, i: int) -> int:
    """Where the digits and commas from i on, and decimals behind them, end; i if there are none."""
    j = i + (text[i : i + 1] == "-")
    if not text[j : j + 1].isdigit():
        return i
    while j < len(text) and (text[j].isdigit() or text[j] == ","):
        j += 1
    k = j + 1
    while text[j : j + 1] == "." and k < len(text) and text[k].isdigit():
        k += 1
    return k if k > j + 1 else j


def _members(text: str):
    """(key, value start, value end) of each key with a colon behind it, by scanning strings from left to right."""
    i = text.find('"')
    while i >= 0:
        try:
            key, j = json.decoder.scanstring(text, i + 1)
        except ValueError:
            i = text.find('"', i + 1)
            continue
        k = _skip(text, j)
        if text[k : k + 1] == ":":
            k = _skip(text, k + 1)
            end = k
            if text[k : k + 1] == '"':
                try:
                    end = json.decoder.scanstring(text, k + 1)[1]
                except ValueError:
                    end = k
            elif literal := next((w for w in ("true", "false", "null") if text.startswith(w, k)), ""):
                end = k + len(literal)
            else:
                end = _number_end(text, k)
            yield key, k, end
            j = max(end, k)
        i = text.find('"', j)


def _quote_grouped(text: str) -> str:
    """Bare numbers of a member, with thousands between commas, as strings."""
    out, at = [], 0
    for _, s, e in _members(text):
        number = text[s:e].rstrip(",")
        e = s + len(number)
        first, *groups = number.split(".")[0].lstrip("-").split(",")
        if groups and 1 <= len(first) <= 3 and all(len(g) == 3 for g in groups) and first.isdigit() and (text[_skip(text, e) :][:1] or " ") in ",}]":
            out += [text[at:s], '"', number, '"']
            at = e
    return "".join([*out, text[at:]])


def json_fields(text: str) -> tuple[dict[str, str | None], str | None]:
    """Flat fields of a reply, and how it had to be repaired: numbers with separators quoted, else whole pairs kept."""
    text = _FENCE.sub("", (text or "").strip())

    def whole(t: str):
        spans = [t, *(t[t.find(a) : t.rfind(b) + 1] for a, b in ("{}", "[]") if 0 <= t.find(a) < t.rfind(b))]
        return next((got for s in spans if s and (got := _load(s)) is not None), None)

    if (got := whole(text)) is not None:
        return got, None
    if (quoted := _quote_grouped(text)) != text and (got := whole(quoted)) is not None:
        return got, "quoted bare numbers"
    pairs: dict[str, str | None] = {}
    for key, s, e in _members(text):
        if e > s:
            token = text[s:e]
            pairs.setdefault(key, json.loads(token, strict=False) if token[0] == '"' else None if token == "null" else token)
    return pairs, f"salvaged {len(pairs)} fields from invalid JSON" if pairs else "invalid JSON"


def tree_distance(a: tuple, b: tuple, rename) -> float:
    """Zhang and Shasha's edit distance of ordered trees (label, children); inserts and deletes cost 1."""

    def order(t):
        labels, left, roots = [], [], {}

        def walk(n):
            first = None
            for c in n[1]:
                f = walk(c)
                first = f if first is None else first
            labels.append(n[0])
            left.append(len(labels) - 1 if first is None else first)
            roots[left[-1]] = len(labels) - 1
            return left[-1]

        walk(t)
        return labels, left, sorted(roots.values())

    (la, fa, ka), (lb, fb, kb) = order(a), order(b)
    d = [[0.0] * len(lb) for _ in la]
    for i in ka:
        for j in kb:
            ai, bj = fa[i], fb[j]
            f = [[0.0] * (j - bj + 2) for _ in range(i - ai + 2)]
            for x in range(1, i - ai + 2):
                f[x][0] = f[x - 1][0] + 1
            for y in range(1, j - bj + 2):
                f[0][y] = f[0][y - 1] + 1
            for x in range(1, i - ai + 2):
                for y in range(1, j - bj + 2):
                    p, q = ai + x - 1, bj + y - 1
                    if fa[p] == ai and fb[q] == bj:
                        f[x][y] = min(f[x - 1][y] + 1, f[x][y - 1] + 1, f[x - 1][y - 1] + rename(la[p], lb[q]))
                        d[p][q] = f[x][y]
                    else:
                        f[x][y] = min(f[x - 1][y] + 1, f[x][y - 1] + 1, f[fa[p] - ai][fb[q] - bj] + d[p][q])
    return d[-1][-1]


VOID = frozenset(("br", "img", "hr", "input", "col", "wbr"))
#: Tags that an opening tag closes first, up to the table around them.
CLOSES = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), **dict.fromkeys(("thead", "tbody", "tfoot"), ("td", "th", "tr", "thead", "tbody", "tfoot"))}


class _Markup(HTMLParser):
    """Elements as [tag, attributes, children], where children are elements and strings."""

    def __init__(self):
        super().__init__()
        self.root: list = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        while self.open[-1][0] in CLOSES.get(tag, ()):
            self.open.pop()
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag in [n[0] for n in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.open[-1][2].append(data)


def _first(node: list, tag: str) -> list | None:
    if node[0] == tag:
        return node
    return next((got for c in node[2] if not isinstance(c, str) and (got := _first(c, tag))), None)


def _hoisted(node: list, tags) -> list:
    """The element with those of the tags replaced by their children."""
    out: list = []
    for c in node[2]:
        c = c if isinstance(c, str) else _hoisted(c, tags)
        out.extend(c[2] if not isinstance(c, str) and c[0] in tags else [c])
    return [node[0], node[1], out]


def _tokens(node: list) -> list[str]:
    """What a cell holds: each character, and each tag inside as one token."""
    out: list[str] = []
    for c in node[2]:
        out.extend(c if isinstance(c, str) else [f"<{c[0]}>", *_tokens(c), f"</{c[0]}>"])
    return out


def _elements(node: list) -> int:
    return sum(1 + _elements(c) for c in node[2] if not isinstance(c, str))


def _tree(node: list, content: bool) -> tuple:
    """(label, children): the label of a cell holds its spans and tokens, cells have no children."""
    if node[0] == "td":
        span = lambda k: int(v) if (v := str(node[1].get(k) or "1").strip()).isdigit() else 1
        return ("td", span("colspan"), span("rowspan"), tuple(_tokens(node)) if content else ()), []
    return (node[0], None, None, ()), [_tree(c, content) for c in node[2] if not isinstance(c, str)]


#: Wrappers of rows, which don't count where only the cells matter.
WRAPPERS = ("thead", "tbody", "tfoot")


def table_similarity(pred: str, truth: str, ignore: Sequence[str] = (), structure_only: bool = False) -> float:
    """1 - the edit distance of the first tables' trees by the larger number of elements below the table (those inside
    cells included); 0 if either text has no table. Renaming a cell costs the normalised edit distance of its tokens, or 1
    where spans differ; elements other than td are compared by name alone."""
    found = []
    for html in (pred, truth):
        p = _Markup()
        p.feed((html or "").replace("\n", ""))
        p.close()
        found.append(_first(p.root, "table"))
    if not found[0] or not found[1]:
        return 0.0
    a, b = (_hoisted(t, ignore) if ignore else t for t in found)
    x, y = _tree(a, not structure_only), _tree(b, not structure_only)
    nodes = max(_elements(a), _elements(b))
    if x == y:
        return 1.0 if nodes else 0.0

    def rename(p, q):
        if p[:3] != q[:3]:
            return 1.0
        return edit_distance(p[3], q[3]) / max(len(p[3]), len(q[3])) if p[0] == "td" and (p[3] or q[3]) else 0.0

    return 1 - tree_distance(x, y, rename) / nodes if nodes else 0.0


def first_table(text: str) -> str | None:
    """The first table of a text that is closed, as it stands."""
    m = re.search(r"(?is)<table\b.*?</table\s*>", text or "")
    return m and m[0]


def teds(pred: str, truth: str, structure_only: bool = False) -> float:
    """table_similarity() of canonical texts with header cells as cells and without wrappers of rows. A prediction whose
    table isn't closed has none; a truth without one is taken as rows."""
    p, t = first_table(pred), first_table(truth) or truth or ""
    if p is None:
        return 0.0
    plain = lambda x: re.sub(r"(?i)<(/?)th\b", r"<\1td", canonical(x))
    return table_similarity(plain(p), plain(t if "<table" in t else f"<table>{t}</table>"), WRAPPERS, structure_only)


#: Marks that language models leave in their output.
MARKS = ("<bos>", "<eos>", "<pad>", "<unk>")


def pre_clean(text: str) -> str:
    """Text without models' marks, word-piece signs, spaces that split commands and braces, line ends, stars and
    underscores."""
    for mark in MARKS:
        text = text.replace(mark, "")
    text = re.sub(r"\s##(?=\S)|(?<=\\)\s", "", text)
    text = re.sub(r"\s\*\s\*\s", "**", text)
    text = re.sub(r"(?<=\{)\s|\s{1,2}(?=\})", "", text)
    text = re.sub(r"(?<=\\begin)\s|(?<=\\end)\s", "", text)
    return text.replace("\\end{table}", "\\end{table} \n\n").translate(str.maketrans("\n*_", "   "))


def heading_tree(text: str) -> tuple[tuple, int]:
    """Cleaned lines below the headings they stand under; a heading's name that came before, or none at all, leads back
    to where it first stood."""
    root: tuple = ("ROOT", [("TITLE", [])])
    at = root[1][0]
    named = {"": at}
    for line in map(pre_clean, (text or "").split("\n")):
        if line.startswith("#"):
            node = (line.replace("#", ""), [])
            root[1].append(node)
            at = named.setdefault(node[0], node)
        else:
            at[1].append((line, []))
    return root, 2 + len((text or "").split("\n"))


def document_similarity(pred: str, truth: str) -> float:
    """Tree similarity of two marked-up documents; labels differ only where one is blank."""
    (a, na), (b, nb) = heading_tree(pred), heading_tree(truth)
    return 1 - tree_distance(a, b, lambda x, y: float(not x.split() or not y.split())) / max(na, nb)


def bleu(pred: Sequence[str], truth: Sequence[str]) -> float:
    """BLEU of up to four words with a brevity penalty; 0 if any order has no match."""
    logs = 0.0
    for n in range(1, 5):
        p, t = (Counter(zip(*(s[i:] for i in range(n)), strict=False)) for s in (pred, truth))
        hits = sum((p & t).values())
        if not hits:
            return 0.0
        logs += math.log(hits / max(1, sum(p.values()))) / 4
    return math.exp(logs + min(0.0, 1 - len(truth) / len(pred)))


def overlap_f(pred: Sequence[str], truth: Sequence[str]) -> float:
    p, t = set(pred), set(truth)
    hit = len(p & t)
    return 2 * hit / (len(p) + len(t)) if p or t else 0.0


def meteor(pred: Sequence[str], truth: Sequence[str]) -> float:
    """Alignment score of lower-cased words: each of the prediction's, from its end, takes the last one left of the truth's.
    Equal words only; stems and synonyms, which a dictionary would give, have no part."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(truth):
        places.setdefault(w.lower(), []).append(i)
    pairs = [(i, left.pop()) for i in range(len(pred) - 1, -1, -1) if (left := places.get(pred[i].lower()))][::-1]
    if not pairs:
        return 0.0
    chunks = 1 + sum((b[0] - a[0], b[1] - a[1]) != (1, 1) for a, b in zip(pairs, pairs[1:], strict=False))
    p, r = len(pairs) / len(pred), len(pairs) / len(truth)
    return p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 * (chunks / len(pairs)) ** 3)


def words_of(pred: str, truth: str) -> tuple[list[str], list[str]]:
    """Tokens of both texts: words between spaces; where either has Thai or Chinese letters, their runs by letter and
    everything else as words, in place of dictionary-based words."""
    far = re.compile("[\u0e00-\u0e7f\u4e00-\u9fa5]")
    if not far.search(pred + truth):
        return pred.split(), truth.split()
    cut = re.compile("[\u0e00-\u0e7f\u4e00-\u9fa5]|[^\\s\u0e00-\u0e7f\u4e00-\u9fa5]+")
    return cut.findall(pred), cut.findall(truth)


def text_similarity(pred: str, truth: str) -> float:
    """Mean of BLEU, METEOR on equal words, word overlap F and edit similarity. Not comparable with one that has a
    dictionary of synonyms, or of Thai words."""
    longest = max(len(pred), len(truth))
    edit = 1 - edit_distance(pred, truth) / longest if longest else 1.0
    p, t = words_of(pred, truth)
    return ((bleu(p, t) if p and t else 0.0) + meteor(p, t) + overlap_f(p, t) + edit) / 4


def entries(fields: dict[str, str | None] | None) -> list[tuple[str, str | None]] | None:
    """A map as Arrow takes it."""
    return None if fields is None else list(fields.items())


def _udf2(f):
    @F.arrow_udf(T.DoubleType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return each(f, pa.float64(), a, b)

    return run


def _udf1(f, kind: T.DataType):
    @F.arrow_udf(kind)
    def run(a: pa.Array) -> pa.Array:
        return each(f, to_arrow_type(kind), a)

    return run


teds_udf, document_similarity_udf, text_similarity_udf = _udf2(teds), _udf2(document_similarity), _udf2(text_similarity)
html_tables_udf, pipe_tables_udf, otsl_udf = _udf1(html_tables, GRID), _udf1(pipe_tables, GRID), _udf1(otsl_html, T.StringType())
json_fields_udf = _udf1(lambda x: entries(json_fields(x)[0]), FIELDS)

# Header words of ledger columns, on lower-cased canonical text.
COLUMN_WORDS = {
    "date": ("date", "วันที่", "วันทำรายการ"), "time": ("time", "เวลา"), "description": ("descriptions", "description", "particulars", "รายการ", "รายละเอียด"),
    "withdrawal": ("withdrawal", "debit", "ถอน", "รายการถอน", "เดบิต"), "deposit": ("deposit", "credit", "ฝาก", "รายการฝาก", "เครดิต"),
    "amount": ("amount", "จำนวนเงิน"), "balance": ("balance", "outstanding", "คงเหลือ", "ยอดคงเหลือ"), "channel": ("channel", "ช่องทาง"), "cheque": ("chq", "cheque", "เช็ค"),
}


def column_role(c: Column) -> Column:
    """The role of a header cell: of the word that stands first, the longer one at the same place; a cell with both
    money directions is withdrawal_deposit; null without any."""
    t = F.lower(canonical_text(c))
    hits = [F.when(F.instr(t, w) > 0, F.struct(F.instr(t, w).alias("at"), F.lit(-len(w)).alias("n"), F.lit(role).alias("role"))) for role, words in COLUMN_WORDS.items() for w in words]
    found = F.array_compact(F.array(*hits))
    both = F.exists(found, lambda h: h.role == "withdrawal") & F.exists(found, lambda h: h.role == "deposit")
    return F.when(both, "withdrawal_deposit").otherwise(F.array_min(found).role)


def header_score(roles: Column) -> Column:
    """How many of date, money and balance an array of roles covers."""
    money = F.arrays_overlap(roles, F.array(*map(F.lit, ("withdrawal", "deposit", "amount", "withdrawal_deposit"))))
    return F.array_contains(roles, "date").cast("int") + F.coalesce(money, F.lit(False)).cast("int") + F.array_contains(roles, "balance").cast("int")
