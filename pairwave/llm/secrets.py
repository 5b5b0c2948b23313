"""Secret scans by a trigram inverted index (operator 10).

A Boolean query over trigrams is derived from each rule's regular expression (read with Python's own parser): a match
contains them for certain. For each batch of texts an inverted index of those trigrams is built with numpy, postings
are intersected and united as the query says, and only candidates are verified with the rule itself, over the whole
text. A rule from which no trigram follows (such as runs of hex digits) scans every text.

Null text is the empty text: no spans. An empty table gives no rows. Spans are in code points, the end exclusive; of one start the kinds go as listed; equal
texts give equal spans; extra columns are ignored, and repeated rows are scanned each. A very long text is indexed in
windows and verified as a whole; every pattern takes time in proportion to the text, whatever it holds.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as sc  # Python's own parser: no public name gives an expression's tree (tested with 3.11 to 3.13)
import re._parser as sre
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import rows, trim

#: A query is None (everything), a trigram, or ("and" | "or", queries).
Query = None | bytes | tuple
#: Bytes of text whose trigrams are looked up at once.
WINDOW = 1 << 20
#: Alternatives that the exact strings of an expression are kept for.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = 0
    keep: Callable[[re.Match], bool] = field(default=lambda m: True, compare=False)
    #: The same kept matches by an expression that does less work.
    fast: str | None = None


#: The base kinds, in the order of their names in reports.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: m.end(2) - m.start(2) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", re.A, lambda m: m.end() - m.start() >= 20),
    Rule("hex", r"[0-9a-f]+", re.A, lambda m: m.end() - m.start() >= 24, r"(?<![0-9a-f])[0-9a-f]{24,}"),
)
#: Kinds that the index makes cheap to add.
MORE = (
    # Header lines, then up to the END line; without one, runs of base64 as long as keys have.
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----\s*+(?>[A-Za-z][A-Za-z0-9-]*:(?:(?!-----)[^\r\n])*+[\r\n]\s*)*+(?:[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----|(?:\s*+[A-Za-z0-9+/]{16,}+={0,2})++(?:\s+[A-Za-z0-9+/]++={1,2})?)", re.A),
    # From the start of a run only: else each eyJ in a long run would be tried up to its end.
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", re.A),
    Rule("url_login", r"://[^\s:@/]*:[^\s:@/]{3,}@[A-Za-z0-9.-]+", re.A),
)
RULES = BASE + MORE


def both(op: str, parts: list[Query]) -> Query:
    """parts joined by "and" or "or"; None is the query that all texts answer."""
    if op == "or" and any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    if not parts:
        return None
    if op == "or":  # an alternative that asks for all that another asks for adds nothing
        asks = {p: {p} if isinstance(p, bytes) else set(p[1]) for p in parts if isinstance(p, bytes) or p[0] == "and"}
        parts = [p for p in parts if p not in asks or not any(asks[q] < asks[p] for q in asks)]
    return parts[0] if len(parts) == 1 else (op, tuple(parts))


def trigrams(text: bytes) -> Query:
    return both("and", [text[i : i + 3] for i in range(len(text) - 2)])


@dataclass
class _Info:
    """What matches of an expression hold: all their texts if few (strings), and a query that holds in any case."""

    strings: frozenset[bytes] | None
    query: Query

    def closed(self) -> Query:
        if self.strings is None:
            return self.query
        return both("and", [self.query, both("or", [trigrams(s) for s in sorted(self.strings)])])


def _literal(code: int) -> frozenset[bytes]:
    return frozenset([chr(code).lower().encode()])


def _info(items) -> _Info:
    """Of a sequence: adjacent exact strings are joined; where they end, their trigrams are added to the query."""
    known, queries = frozenset([b""]), []
    exact = True
    for op, value in items:
        part = _one(op, value)
        if part.strings is not None and len(known) * len(part.strings) <= MAX_STRINGS:
            known = frozenset(a + b for a in known for b in part.strings)
            queries.append(part.query)
            continue
        queries += [both("or", [trigrams(s) for s in sorted(known)]), part.closed()]
        known, exact = frozenset([b""]), False
    if not exact:
        queries.append(both("or", [trigrams(s) for s in sorted(known)]))
    return _Info(known if exact else None, both("and", queries))


def _one(op, value) -> _Info:
    if op is sc.LITERAL:
        return _Info(_literal(value), None)
    if op is sc.IN:
        if len(value) <= 4 and all(o is sc.LITERAL for o, _ in value):
            return _Info(frozenset().union(*(_literal(v) for _, v in value)), None)
        return _Info(None, None)
    if op is sc.SUBPATTERN:
        return _info(value[3])
    if op is sc.BRANCH:
        parts = [_info(x) for x in value[1]]
        if all(p.strings is not None for p in parts) and sum(len(p.strings) for p in parts) <= MAX_STRINGS:
            return _Info(frozenset().union(*(p.strings for p in parts)), None)
        return _Info(None, both("or", [p.closed() for p in parts]))
    if op in (sc.MAX_REPEAT, sc.MIN_REPEAT):
        low, high, inner = value
        one = _info(inner)
        if low == high == 1:
            return one
        if low == 0 and high == 1 and one.strings is not None:
            return _Info(one.strings | {b""}, None)
        return _Info(None, one.closed() if low else None)
    if op is sc.AT:
        return _Info(frozenset([b""]), None)
    return _Info(None, None)


def trigram_query(rule: Rule) -> Query:
    """What the lower-cased UTF-8 bytes of any text with a match hold."""
    return _info(sre.parse(rule.pattern, rule.flags)).closed()


def mentioned(query: Query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(mentioned(q) for q in query[1]))


class TrigramScanner:
    """Finds the spans of rules in texts, a batch at a time."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.compiled = [re.compile(r.fast or r.pattern, r.flags) for r in rules]
        self.queries = [trigram_query(r) for r in rules]
        self.grams = sorted(set().union(*map(mentioned, self.queries)))
        self.number = np.zeros(1 << 24, np.uint8 if len(self.grams) < 255 else np.uint16)
        for i, g in enumerate(self.grams):
            self.number[g[0] << 16 | g[1] << 8 | g[2]] = i + 1
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def postings(self, raw: np.ndarray, begins: np.ndarray) -> dict[bytes, np.ndarray]:
        """Texts of the batch that hold each trigram, ascending. begins: where each text starts in raw."""
        parts = [np.zeros(0, np.int64)]
        for first in range(0, len(raw) - 2, WINDOW):
            low = self.fold[raw[first : first + WINDOW + 2]].astype(np.int32)
            found = self.number[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            at = np.flatnonzero(found)
            owner = np.searchsorted(begins, at + first, "right") - 1
            parts.append(np.unique(found[at].astype(np.int64) * len(begins) + owner))
        keys = np.unique(np.concatenate(parts))
        gram, text = keys // len(begins), keys % len(begins)
        cuts = np.searchsorted(gram, np.arange(1, len(self.grams) + 2))
        return {g: text[cuts[i] : cuts[i + 1]] for i, g in enumerate(self.grams)}

    def candidates(self, query: Query, postings: dict[bytes, np.ndarray]) -> np.ndarray:
        if isinstance(query, bytes):
            return postings[query]
        op, parts = query
        sets = sorted((self.candidates(q, postings) for q in parts), key=len)
        out = sets[0]
        for s in sets[1:]:
            out = np.intersect1d(out, s, True) if op == "and" else np.union1d(out, s)
        return out

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """Of each text (rule number, start, end), by start, then rule."""
        if not texts:
            return []
        texts = [t or "" for t in texts]
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        # Three zero bytes between texts: no trigram of a rule crosses from one to the next.
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        begins = np.cumsum([0, *(len(c) + 3 for c in coded[:-1])])
        postings = self.postings(np.frombuffer(b"\0\0\0".join(coded), np.uint8), begins)
        for k, (rule, query) in enumerate(zip(self.rules, self.queries, strict=True)):
            for i in range(len(texts)) if query is None else self.candidates(query, postings).tolist():
                text = texts[i]
                out[i] += [(k, m.start(), m.end()) for m in self.compiled[k].finditer(text) if rule.keep(m)]
        for spans in out:
            spans.sort(key=lambda s: (s[1], s[0]))
        return out


_scanner: TrigramScanner | None = None


def scanner() -> TrigramScanner:
    """One for each worker process."""
    global _scanner
    _scanner = _scanner or TrigramScanner()
    return _scanner


def shown(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for k, a, b in spans)


def scan_frame(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end), in order of start, then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for doc_id, text in rows(batches):
            found = [[{"kind": RULES[k].kind, "start": a, "end": b} for k, a, b in spans] for spans in scanner().scan(text)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each secret replaced by <kind>; overlapping spans by the kind of the first."""
    out, at = [], 0
    for k, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{RULES[k].kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with secrets replaced by their kinds in brackets; all other columns and texts stay as they are. Null stays null."""
    columns, place = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(place).to_pylist()
                new = [t if not s else masked(t, s) for t, s in zip(texts, scanner().scan(texts), strict=True)]
                arrays = [pa.array(new, pa.string()) if i == place else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=columns)
            trim()

    return docs.mapInArrow(run, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text in rows(batches):
            found = scanner().scan(text)
            base = [[s for s in spans if s[0] < len(BASE)] for spans in found]
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in range(len(BASE))]
            sums = pa.array([hashlib.sha256(shown(s).encode()).hexdigest() for s in base])
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), *counts, sums, pa.array([shown(s) for s in found])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
