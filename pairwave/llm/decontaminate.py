"""Benchmark decontamination: windows of benchmark words found in documents (operator 12).

A word is a run of digits, letters and characters from U+0080 on; A-Z count as a-z. A window is `window` consecutive words
of an item; an item of fewer words, but not none, is one window. A document's word is hit if it lies in any occurrence of any window.

A hash set of all windows is broadcast and every place of every text is looked up in it with numpy; what has a
window's hash is compared with the window's own bytes. The set is broadcast only if the benchmark has at most SET_WINDOWS windows and
SET_BYTES bytes of them. Beyond that a bit map of fixed size is broadcast, the places that pass it are shuffled by their words and
joined with the windows; results are the same.

Null and empty texts have no words: zeros, no items. Items without words have no windows. Rows of one item_id are one
item; null item_ids are one item whose id is the empty string. Repeated rows give repeated rows. Texts of any length are read in parts that look
`window` - 1 words ahead. Extra columns are kept by `hits`, `remove_spans` and `remove_documents`; those named like results are replaced.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import fresh, trim, written

WINDOW = 10
#: Windows of a benchmark, and their bytes, that a broadcast set may hold; bits of the map that is broadcast beyond.
SET_WINDOWS, SET_BYTES, MAP_BITS = 1 << 20, 64 << 20, 1 << 26
#: Bytes of text handled at once, and of a text that is read in parts; bytes hashed at once.
CHUNK_BYTES, BLOCK = 1 << 20, 1 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
_STEP = 0x9E3779B97F4A7C15

#: What `hits` adds: words, hit words, sorted ids of the items found, and byte ranges of runs of hit words.
ADDED = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-cased bytes start and end."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _WORD[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


_powers: list[np.ndarray] = []


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from sums of bytes times powers; a word longer than a block is hashed alone."""
    if not _powers:
        for base in (_STEP, pow(_STEP, -1, 1 << 64)):
            step = np.full(BLOCK, base, np.uint64)
            step[0] = 1
            _powers.append(np.multiply.accumulate(step))
    power, inverse = _powers
    out, data, at = np.empty(len(starts), np.uint64), np.frombuffer(raw, np.uint8), 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        high = int(ends[to - 1])
        if high - low > BLOCK:
            out[at] = int.from_bytes(hashlib.blake2b(raw[low:high], digest_size=8).digest(), "little")
        else:
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * power[: high - low], out=sums[1:])
            out[at:to] = (sums[ends[at:to] - low] - sums[starts[at:to] - low]) * inverse[starts[at:to] - low]
        at = to
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def window_hashes(of_words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` words, by its first word."""
    n, total, factor = len(of_words) - size + 1, None, 1
    for j in range(size):
        term = of_words[j : j + n] * np.uint64(factor)
        total = term if total is None else total + term
        factor = factor * _STEP % (1 << 64)
    total ^= total >> np.uint64(29)
    total *= np.uint64(0x94D049BB133111EB)
    return total ^ (total >> np.uint64(32))


class WindowSet:
    """Windows sorted by hash, with the items that have them; sent to every worker."""

    def __init__(self, rows: list[tuple[bytes, str]]):
        owners: dict[bytes, set[str]] = {}
        for window, item in rows:
            owners.setdefault(window, set()).add(item)
        hashes, sizes = np.empty(len(owners), np.uint64), np.empty(len(owners), np.int64)
        for k, window in enumerate(owners):
            starts, ends = words(window)
            sizes[k] = len(starts)
            hashes[k] = window_hashes(word_hashes(window, starts, ends), len(starts))[0]
        order, known = np.argsort(hashes), list(owners)
        self.hashes, self.sizes = hashes[order], sizes[order]
        self.windows = [known[k] for k in order.tolist()]
        self.items = [tuple(sorted(owners[w])) for w in self.windows]
        self.lengths = np.unique(sizes).tolist()
        bits = min(26, max(16, (16 * len(known)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.near = np.zeros(1 << bits, bool)
        self.near[self.hashes >> self.shift] = True

    def places(self, of_words: np.ndarray, room: np.ndarray, length: int) -> np.ndarray:
        """First words of runs that may be a window of `length` words. room: words of the text from each word on."""
        if len(of_words) < length:
            return np.zeros(0, np.int64)
        found = window_hashes(of_words, length)
        at = np.flatnonzero(self.near[found >> self.shift] & (room[: len(found)] >= length))
        low = np.searchsorted(self.hashes, found[at], "left")
        hit = self.hashes[np.minimum(low, len(self.hashes) - 1)] == found[at]
        return np.stack([at[hit], low[hit]])

    def found(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, room: np.ndarray) -> list[tuple[int, int, int]]:
        """First word, number of words and window of all occurrences, verified by their bytes."""
        if not len(self.hashes) or not len(starts):
            return []
        of_words, out, joined = word_hashes(raw, starts, ends), [], None
        for length in self.lengths:
            place = self.places(of_words, room, length)
            if not place.size:
                continue
            if joined is None:
                joined, begin, finish = one_blank(raw, starts, ends)
            for i, k in zip(*place.tolist(), strict=True):
                text = joined[begin[i] : finish[i + length - 1]]
                h = self.hashes[k]
                while k < len(self.hashes) and self.hashes[k] == h:
                    if self.windows[k] == text:
                        out.append((i, length, k))
                        break
                    k += 1
        return out


class BitMap:
    """Hashes of windows as bits: finds the places whose words may be a window of a benchmark of any size."""

    def __init__(self, bits: np.ndarray, lengths: list[int]):
        self.bits, self.lengths = bits, lengths

    @staticmethod
    def place(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - (MAP_BITS.bit_length() - 1))).astype(np.int64)

    def found(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, room: np.ndarray) -> list[tuple[int, int, bytes]]:
        if not len(starts):
            return []
        of_words, out = word_hashes(raw, starts, ends), []
        joined, begin, finish = one_blank(raw, starts, ends)
        for length in (k for k in self.lengths if k <= len(of_words)):
            at = self.place(window_hashes(of_words, length))
            hit = np.flatnonzero((self.bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool) & (room[: len(at)] >= length))
            out += [(i, length, joined[begin[i] : finish[i + length - 1]]) for i in hit.tolist()]
        return out


def one_blank(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of raw with one blank after each, and where they start and end there."""
    data = np.frombuffer(raw, np.uint8)
    keep = np.zeros(len(raw) + 1, bool)
    keep[: len(raw)] = _WORD[data]
    keep[ends] = True  # the byte after a word
    out = np.append(data, np.uint8(32))
    out[ends] = 32
    finish = np.cumsum(ends - starts + 1) - 1
    return out[keep].tobytes(), finish - (ends - starts), finish


def parts(raw: bytes, window: int) -> Iterator[tuple[int, int, int]]:
    """Where each part of a text starts and ends, and the end of what a window that starts in it may reach."""
    ahead = re.compile(rb"(?:[^0-9a-z\x80-\xff]*[0-9a-z\x80-\xff]+){0,%d}" % (window - 1))
    at = 0
    while len(raw) - at > 2 * CHUNK_BYTES and (gap := _GAP.search(raw, at + CHUNK_BYTES)):
        yield at, gap.start(), ahead.match(raw, gap.start()).end()
        at = gap.start()
    yield at, len(raw), len(raw)


def occurrences(texts: list[bytes], finder: WindowSet | BitMap, window: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, list]]:
    """Of parts of texts, in order: number of the text, words before the part, own words, byte ranges of its words, and what the finder has found there."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > 2 * CHUNK_BYTES:
            before, low = 0, texts[at].translate(_LOWER)
            for begin, end, reach in parts(low, window):
                piece = low[begin:reach]
                starts, ends = words(piece)
                own = int(np.searchsorted(starts, end - begin))
                room = len(starts) - np.arange(len(starts))
                room[own:] = 0
                yield at, before, own, starts + begin, ends + begin, finder.found(piece, starts, ends, room)
                before += own
            at += 1
            continue
        to, size = at, 0
        while to < len(texts) and len(texts[to]) <= 2 * CHUNK_BYTES and (to == at or size + len(texts[to]) < CHUNK_BYTES):
            size += len(texts[to]) + 1
            to += 1
        raw = b"\n".join(texts[at:to]).translate(_LOWER)
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts[at:to])])
        starts, ends = words(raw)
        cuts = np.searchsorted(starts, offsets)
        room = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(len(starts))
        found = finder.found(raw, starts, ends, room)
        by_text: dict[int, list] = {}
        for hit, t in zip(found, (np.searchsorted(cuts, [f[0] for f in found], "right") - 1).tolist(), strict=True):
            by_text.setdefault(t, []).append((hit[0] - int(cuts[t]), *hit[1:]))
        for t in range(to - at):
            own = slice(int(cuts[t]), int(cuts[t + 1]))
            yield at + t, 0, own.stop - own.start, starts[own] - offsets[t], ends[own] - offsets[t], by_text.get(t, [])
        at = to


def merged(ranges: list[tuple[int, int, int, int]]) -> tuple[int, list[tuple[int, int]]]:
    """Hit words, and byte ranges of runs of them, from (first word, word after the last, first byte, byte after the last) of occurrences."""
    runs: list[list[int]] = []
    for first, after, start, end in sorted(ranges):
        if runs and first <= runs[-1][1]:
            if after > runs[-1][1]:
                runs[-1][1], runs[-1][3] = after, end
        else:
            runs.append([first, after, start, end])
    return sum(r[1] - r[0] for r in runs), [(r[2], r[3]) for r in runs]


def item_windows(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """item (string), window (its words joined by blanks, binary), size (words): every window of every item, repeated as there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low = (raw or b"").translate(_LOWER)
                starts, ends = words(low)
                joined, begin, finish = one_blank(low, starts, ends)
                size = min(window, len(starts))
                for at in range(0, max(0, len(starts) - size + 1) if size else 0, 4096):
                    upto = min(at + 4096, len(starts) - size + 1)
                    out = [joined[begin[i] : finish[i + size - 1]] for i in range(at, upto)]
                    yield pa.RecordBatch.from_arrays([pa.array([name or ""] * len(out)), pa.array(out, pa.binary()), pa.array([size] * len(out), pa.int32())], ["item", "window", "size"])

    return benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "item string, window binary, size int")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """docs with the columns of ADDED: number of words, hit words, ids of items with occurring windows, byte ranges of hit words."""
    windows = item_windows(benchmark, window)
    size = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    if size[0] > SET_WINDOWS or size[1] > SET_BYTES:
        return _hits_by_join(docs, windows.distinct(), window, text)
    known = WindowSet([(bytes(r.window), r.item) for r in windows.distinct().collect()])
    sent = docs.sparkSession.sparkContext.broadcast(known)
    keep, frame = _with_bytes(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            texts = [t or b"" for t in batch.column(batch.num_columns - 1).to_pylist()]
            n_words, ranges, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
            for t, before, own, starts, ends, found in occurrences(texts, known, window):
                n_words[t] += own
                for first, length, k in found:
                    ranges[t].append((before + first, before + first + length, int(starts[first]), int(ends[first + length - 1])))
                for k in {f[2] for f in found}:
                    items[t].update(known.items[k])
            n_hit, spans = zip(*map(merged, ranges), strict=True) if texts else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), _ranges(spans)], [*keep, "n_words", "n_hit", "items", "spans"])
            trim()

    return frame.mapInArrow(run, _schema(docs, keep, ADDED))


def _with_bytes(docs: DataFrame, text: str) -> tuple[list[str], DataFrame]:
    keep = [c for c in docs.columns if c.lower() not in ("n_words", "n_hit", "items", "spans")]
    return keep, docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias(fresh(docs, "_bytes")))


def _schema(docs: DataFrame, keep: list[str], added: str) -> T.StructType:
    return T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep] + T._parse_datatype_string(added).fields)


def _ranges(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


def _hits_by_join(docs: DataFrame, windows: DataFrame, window: int, text: str) -> DataFrame:
    """The same for a benchmark of any size: only a bit map of MAP_BITS bits is broadcast."""
    spark = docs.sparkSession
    windows = written(windows, "windows")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [window_hashes(word_hashes(w, *words(w)), n)[0] for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(BitMap.place(np.array(found, np.uint64)))], ["place"])

    bits = np.zeros(MAP_BITS >> 6, np.uint64)
    at = windows.select("window", "size").mapInArrow(places, "place long")
    for r in at.groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("bits")).toLocalIterator():
        bits[r.at] = np.uint64(r.bits & 0xFFFFFFFFFFFFFFFF)
    sent = spark.sparkContext.broadcast(BitMap(bits, sorted(r.size_ for r in windows.select(F.col("size").alias("size_")).distinct().collect())))
    keep, frame = _with_bytes(docs, text)
    schema = _schema(docs, keep, "_row string, n_words long, first long, after long, start long, end long, window binary")
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(batch.num_columns - 1).to_pylist()]
            rows, n_words = [uuid.uuid4().hex for _ in texts], [0] * len(texts)
            void = [pa.nulls(0, f.type) for f in batch.schema][:-1]
            for t, before, own, starts, ends, found in occurrences(texts, sent.value, window):
                n_words[t] += own
                if found:
                    first = np.array([f[0] for f in found])
                    after = first + [f[1] for f in found]
                    none = [pa.nulls(len(found), v.type) for v in void]
                    yield pa.RecordBatch.from_arrays([*none, pa.array([rows[t]] * len(found)), pa.nulls(len(found), pa.int64()), pa.array(before + first), pa.array(before + after), pa.array(starts[first]), pa.array(ends[after - 1]), pa.array([f[2] for f in found], pa.binary())], names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows), pa.array(n_words, pa.int64()), *(pa.nulls(len(texts), pa.int64()) for _ in range(4)), pa.nulls(len(texts), pa.binary())], names)

    all_rows = written(frame.mapInArrow(run, schema), "places")
    # Where many documents have one passage, its window is the key of many places but of one row here: the join can be split.
    owners = windows.groupBy("window").agg(F.collect_set("item").alias("items"))
    found = all_rows.where("window IS NOT NULL").select("_row", "first", "after", "start", "end", "window").join(owners, "window")
    by_item = found.select("_row", F.explode("items").alias("item")).distinct().groupBy("_row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    by_range = found.groupBy("_row").agg(F.collect_set(F.struct("first", "after", "start", "end")).alias("ranges"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [merged([(x["first"], x["after"], x["start"], x["end"]) for x in r]) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.int64()), _ranges([g[1] for g in got])], ["_row", "n_hit", "spans"])

    spans = by_range.mapInArrow(runs, "_row string, n_hit long, spans array<struct<start:long,end:long>>")
    out = all_rows.where("n_words IS NOT NULL").drop("first", "after", "start", "end", "window").join(by_item, "_row", "left").join(spans, "_row", "left")
    return out.select(*[F.col(f"`{c}`") for c in keep], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The documents of which no word is hit, with docs' columns."""
    mark = fresh(docs, "_row_of_docs")
    return hits(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(mark), F.col(f"`{text}`").alias("text")), benchmark, window).where("n_hit = 0").select(f"{mark}.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """All documents, their runs of hit words taken out of the text; the rest of the text stays as it is."""
    mark = fresh(docs, "_row_of_docs")
    found = hits(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias(mark) if len(docs.columns) > 1 else F.lit(0).alias(mark), F.col(f"`{text}`").alias("text")), benchmark, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, at = [], 0
                for s in spans:
                    kept.append(raw[at : s["start"]])
                    at = s["end"]
                out.append(None if raw is None else b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [mark, "text"])

    kept = found.select(mark, "text", "spans")
    out = kept.mapInArrow(cut, T.StructType([kept.schema[mark], T.StructField("text", T.StringType())]))
    return out.select(*[F.col("text").alias(c) if c == text else F.col(f"{mark}.`{c}`") for c in docs.columns])


def digest(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: of what `hits` finds."""
    found = hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
