"""Alignment of two tokenizers' tokens by a dangling-suffix transducer (operator 13).

The transducer's state is which side leads and the bytes by which it leads; the other side's next token moves it, and
transitions are remembered by state and token. A group of tokens closes where nothing is left over. Byte offsets where tokens of both
sides end are the same, so groups are the finest parts of a text that both tokenizers respect.

Texts are cut where both tokenizers always cut: the first by its pre-tokenizer's classes of ASCII characters, the second
because none of its pieces has the two bytes next to each other. Distinct segments are aligned once and looked up by
their bytes. A first pass stores for each document its linked pairs of ids and how often they occur; corpus-wide
counts come from that table, and a second pass looks them up. The most frequent pairs, FREQUENT at most, and the highest count of each id
(as many as the vocabulary has) are broadcast; other pairs are joined by a shuffle.

Null and empty texts, and texts that a side's tokens don't spell, have no tokens: zeros and ''. Strings of special tokens are
plain text. Repeated rows are documents of their own. Texts beyond 500 kB are handled in parts, a document's pairs are stored in rows of at most ROW_PAIRS,
links are counted by distinct ids, so that groups of any length fit. Extra columns are kept by `align` only.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_alphabet
from .encoding import CALL_PIECES, CHUNK_BYTES, MemoEncoder, PieceTable
from .frames import extended, fresh, trim, written

#: Pairs that are broadcast at most, pairs in a row of the table of links, pairs that a task counts at once.
FREQUENT, ROW_PAIRS, COUNTED = 1 << 21, 1 << 20, 1 << 22
#: Transitions that are remembered, and pairs of a group up to which they are listed one by one.
TRANSITIONS, LISTED = 1 << 20, 64

_ASCII = np.arange(128)
_LETTER = ((_ASCII >= 65) & (_ASCII < 91)) | ((_ASCII >= 97) & (_ASCII < 123))
_DIGIT = (_ASCII >= 48) & (_ASCII < 58)
_MARK = (_ASCII > 32) & (_ASCII < 127) & ~_LETTER & ~_DIGIT


class Transducer:
    """States 0, 1, ...: the leading side (0: none, 1: first, 2: second) and its bytes that the other hasn't matched."""

    def __init__(self, first: list[bytes], second: list[bytes]):
        self.bytes = (first, second)
        self.clear()

    def clear(self) -> None:
        self.leads, self.rest = [0], [b""]
        self.number = {(0, b""): 0}
        self.moves: tuple[dict[int, int], dict[int, int]] = ({}, {})

    def _learn(self, state: int, side: int, token: int) -> int:
        """The state after a token of `side`, which is behind or, in state 0, goes first; -1 where the bytes differ."""
        rest, new = self.rest[state], self.bytes[side][token]
        if new.startswith(rest):
            over = (side + 1, new[len(rest) :])
        elif rest.startswith(new):
            over = (2 - side, rest[len(new) :])
        else:
            over = None
        if over is None:
            to = -1
        else:
            if not over[1]:
                over = (0, b"")
            to = self.number.setdefault(over, len(self.leads))
            if to == len(self.leads):
                self.leads.append(over[0])
                self.rest.append(over[1])
        self.moves[side][state << 32 | token] = to
        return to

    def groups(self, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]] | None:
        """The groups of two token lists; None if they spell different bytes."""
        if len(self.moves[0]) + len(self.moves[1]) > TRANSITIONS:
            self.clear()
        leads, (by_a, by_b) = self.leads, self.moves
        out, state, i, j, from_a, from_b, na, nb = [], 0, 0, 0, 0, 0, len(a), len(b)
        while i < na or j < nb:
            if leads[state] == 1:
                if j == nb:
                    return None
                token, j = b[j], j + 1
                to = by_b.get(state << 32 | token)
                state = self._learn(state, 1, token) if to is None else to
            else:
                if i == na:
                    return None
                token, i = a[i], i + 1
                to = by_a.get(state << 32 | token)
                state = self._learn(state, 0, token) if to is None else to
            if state < 0:
                return None
            if state == 0:
                out.append((a[from_a:i], b[from_b:j]))
                from_a, from_b = i, j
        return None if state else out


class SegmentTable(PieceTable):
    """Of each segment its pairs and their numbers (pair << 32 | number), the groups as text, and counts: tokens of both sides, groups, links; -1 if a side doesn't spell it."""

    def clear(self) -> None:
        super().clear()
        self.groups: list[bytes] = []
        self.counts = np.zeros((1 << 16, 4), np.int64)

    def describe(self, groups: list[bytes], counts: np.ndarray) -> None:
        self.counts = self._grown_rows(self.counts, len(self.groups) + len(groups))
        self.counts[len(self.groups) : len(self.groups) + len(groups)] = counts
        self.groups += groups

    @staticmethod
    def _grown_rows(array: np.ndarray, need: int) -> np.ndarray:
        while need > len(array):
            array = np.concatenate([array, np.zeros_like(array)])
        return array


class Aligner(MemoEncoder):
    """Aligns a byte-level BPE (a tokenizers file) with a sentencepiece model that adds a blank before a text."""

    def __init__(self, first: str, second: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.apart = None
        super().__init__(first)
        if self.mode != "bytes":
            raise ValueError("the first tokenizer must be a byte-level BPE without normaliser")
        self.plain = Tokenizer.from_file(first)
        self.plain.encode_special_tokens = True
        self.plain.no_truncation()
        self.plain.no_padding()
        self.sp = SentencePieceProcessor(model_file=second)
        plain_bytes = {c: b for b, c in enumerate(byte_alphabet())}
        names = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        of_a = [n.encode() if n in self.specials else bytes(plain_bytes[c] for c in n) for n in names]
        n = self.sp.get_piece_size()
        of_b = [bytes([int(self.sp.id_to_piece(i)[1:-1], 16)]) if self.sp.is_byte(i) else self.sp.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.width = n
        if len(of_a) * n > 1 << 32:
            raise ValueError("pairs of ids must fit into 32 bits")
        self.spell = of_a, of_b
        self.numbers = [str(i) for i in range(max(len(of_a), n))]
        self.walk = Transducer(of_a, of_b)
        self.line = self.sp.piece_to_id("<0x0A>")
        usual = [of_b[i] for i in range(n) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))]
        touching = np.zeros((256, 256), bool)
        for piece in usual:
            if len(piece) > 1:
                raw = np.frombuffer(piece, np.uint8)
                touching[raw[:-1], raw[1:]] = True
        if any(b"\n" in p for p in usual) or not self.sp.is_byte(self.line):
            raise ValueError("the second tokenizer must not merge line feeds")
        kinds = [_LETTER, _DIGIT, _MARK]
        self.apart = np.zeros((256, 256), bool)
        for x in kinds:
            for y in kinds:
                if x is not y:
                    self.apart[:128, :128] |= np.outer(x, y)
        self.apart[ord("'")] = False  # it may take the letters after it
        visible = np.zeros(256, bool)
        visible[33:127] = True
        self.visible = visible
        self.apart[visible, 10] = self.apart[10, visible] = True
        self.apart &= ~touching
        self.before_blank = ~touching[:, 32]
        # Bytes that begin a character beyond ASCII which isn't white space.
        self.begins = visible.copy()
        self.begins[[*range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True
        self.table = SegmentTable(np.dtype(np.uint64))

    def _cuts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where segments start and end: together they are the whole of raw."""
        if self.apart is None:  # while the base class looks at the file
            return super()._cuts(raw, offsets)
        n = len(raw)
        cut = np.zeros(n + 1, bool)
        if n > 2:
            cut[1:n] = self.apart[raw[:-1], raw[1:]]
            # A line feed stands alone, or isn't cut off at all: white space beside it belongs to one run.
            lines = np.flatnonzero(raw == 10)
            inner = lines[(lines > 0) & (lines < n - 1)]
            alone = inner[self.visible[raw[inner - 1]] & self.visible[raw[inner + 1]]]
            cut[lines] = False
            cut[lines + 1] = False
            cut[alone] = cut[alone + 1] = True
            blank = np.flatnonzero((raw[1:-1] == 32) & self.begins[raw[2:]] & self.before_blank[raw[:-2]]) + 1
            last = raw[blank - 1]
            lead2, lead3 = raw[np.maximum(blank - 2, 0)], raw[np.maximum(blank - 3, 0)]
            wide = (last >= 0x80) & (last < 0xC0) & (((lead2 >= 0xC3) & (lead2 < 0xE0)) | ((lead3 >= 0xE4) & (lead3 < 0xF0)))
            cut[blank[self.visible[last] | wide]] = True
        cut[offsets] = True
        cut[n] = False
        starts = np.flatnonzero(cut)
        return starts, np.append(starts[1:], n)[: len(starts)]

    def _first(self, segments: list[str]) -> list[list[int]]:
        if any(s in x for x in segments for s in self.specials):
            return [x.ids for x in self.plain.encode_batch(segments, add_special_tokens=False)]
        ids = self.tok.encode_batch_fast([self.sep.join(segments)], add_special_tokens=False)[0].ids
        return _split(ids, self.sep_id)

    def _second(self, segments: list[str]) -> list[list[int]]:
        """Ids without the blank that the model adds: a line feed is put before each segment, which no merge crosses."""
        if any("\n" in x for x in segments):
            return [x[2:] for x in self.sp.encode(["\n" + x for x in segments], num_threads=1)]
        return _split(self.sp.encode("\n" + "\n".join(segments), num_threads=1)[2:], self.line)

    def _learn(self, raw: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, clash: bool = False) -> None:
        for at in range(0, len(keys), CALL_PIECES):
            part = slice(at, at + CALL_PIECES)
            spelled = [raw[a:b].tobytes() for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]
            texts = [s.decode("utf-8", "surrogatepass") for s in spelled]
            odd = [i for i, t in enumerate(texts) if "\n" in t or any(s in t for s in self.specials)]
            usual = sorted({*range(len(texts))} - {*odd})
            ids: list = [None] * len(texts)
            for chosen in (usual, odd):
                if chosen:
                    some = [texts[i] for i in chosen]
                    for i, a, b in zip(chosen, self._first(some), self._second(some), strict=True):
                        ids[i] = (a, b)
            links, sizes, groups, counts = [], [], [], []
            for segment, (a, b) in zip(spelled, ids, strict=True):
                pairs, text, count = self._aligned(segment, a, b)
                links += pairs
                sizes.append(len(pairs))
                groups.append(text)
                counts.append(count)
            self.table.add(keys[part], raw, starts[part], ends[part], np.array(links, np.uint64), np.array(sizes, np.int32), clash)
            self.table.describe(groups, np.array(counts, np.int64).reshape(-1, 4))

    def _aligned(self, segment: bytes, a: list[int], b: list[int]) -> tuple[list[int], bytes, tuple[int, int, int, int]]:
        of_a, of_b = self.spell
        found = None
        if b"".join([of_a[i] for i in a]) == segment and b"".join([of_b[i] for i in b]) == segment:
            found = self.walk.groups(a, b)
        if found is None:
            return [], b"", (-1, 0, 0, 0)
        pairs, text, links, name, width = [], [], 0, self.numbers, self.width
        for x, y in found:
            links += len(x) * len(y)
            if len(x) * len(y) <= LISTED:
                pairs += [(i * width + j) << 32 | 1 for i in x for j in y]
            else:
                for i, p in Counter(x).items():
                    for j, q in Counter(y).items():
                        many, left = divmod(p * q, 0xFFFFFFFF)
                        pairs += [(i * width + j) << 32 | k for k in [0xFFFFFFFF] * many + [left] * (left > 0)]
            text.append(";" + ",".join([name[i] for i in x]) + "|" + ",".join([name[j] for j in y]))
        return pairs, "".join(text).encode(), (len(a), len(b), len(found), links)

    def align_column(self, column: pa.Array) -> Iterator[tuple[int, bool, np.ndarray, bytes, np.ndarray, np.ndarray]]:
        """Of parts of texts, in order: number of the text, whether it is spelled by both sides, its four counts, groups as text (each after a semicolon), linked pairs in order, their numbers."""
        column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        if not len(column):
            return
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        offsets, first = self._parts(raw, ends)
        of_text = np.searchsorted(first, np.arange(len(offsets) - 1), "right") - 1
        at, parts = 0, len(offsets) - 1
        while at < parts:
            to = min(parts, max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1))
            for k, found in enumerate(self._part_of(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])):
                yield int(of_text[at + k]), *found
            at = to

    def _part_of(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
        n = len(offsets) - 1
        starts, ends = self._cuts(raw, offsets) if len(raw) else (np.zeros(0, np.int64),) * 2
        entry = self._entries(raw, starts, ends) if len(starts) else np.zeros(0, np.int64)
        table = self.table
        owner = np.searchsorted(offsets, starts, "right") - 1
        cuts = np.searchsorted(owner, np.arange(n + 1))
        counts = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(table.counts[entry], 0)])
        bad = np.bincount(owner, table.counts[entry, 0] < 0, n) > 0
        distinct, often = np.unique(owner.astype(np.int64) << 32 | entry, return_counts=True)
        which = distinct & 0xFFFFFFFF
        size = table.sizes[which].astype(np.int64)
        links = table.ids[np.repeat(table.starts[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        key = np.repeat(distinct >> 32, size) << 32 | (links >> np.uint64(32)).astype(np.int64)
        number = (links & np.uint64(0xFFFFFFFF)).astype(np.int64) * np.repeat(often, size)
        key, number = _summed(key, number)
        bounds = np.searchsorted(key, np.arange(n + 1, dtype=np.int64) << 32).tolist()
        numbers, cuts = entry.tolist(), cuts.tolist()
        for k in range(n):
            own = slice(bounds[k], bounds[k + 1])
            yield not bad[k], counts[cuts[k + 1]] - counts[cuts[k]], b"".join([table.groups[e] for e in numbers[cuts[k] : cuts[k + 1]]]), (key[own] & 0xFFFFFFFF).astype(np.uint32), number[own]


def _split(ids: list[int], mark: int) -> list[list[int]]:
    """The lists between marks."""
    out, at = [], 0
    array = np.array(ids, np.int64)
    for end in [*np.flatnonzero(array == mark).tolist(), len(ids)]:
        out.append(ids[at:end])
        at = end + 1
    return out


def _summed(key: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their numbers."""
    if not len(key):
        return key, number
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(number[order], first)


@functools.lru_cache(maxsize=1)
def aligner(first: str, second: str) -> Aligner:
    """One for each worker process and pair of files."""
    return Aligner(first, second)


def _stream(text: str):
    """The bytes that both sides spell: a blank and the text; null for texts without tokens."""
    return F.when(F.length(F.col(f"`{text}`")) > 0, F.concat(F.lit(" "), F.col(f"`{text}`")))


def align(docs: DataFrame, first: str, second: str, text: str = "text") -> DataFrame:
    """docs with a column groups: array of struct(a: ids of the first tokenizer, b: ids of the second), replacing one of that name."""
    keep = [c for c in docs.columns if c.lower() != "groups"]
    schema = extended(docs.select(*[F.col(f"`{c}`") for c in keep]).schema, groups=T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(first, second)
        for batch in batches:
            good, groups = [True] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            for t, ok, _, found, _, _ in by.align_column(batch.column(batch.num_columns - 1)):
                good[t] &= ok
                groups[t].append(found)
            out = [b"".join(x)[1:].decode() if ok else "" for x, ok in zip(groups, good, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], [*keep, "groups"])
            trim()

    frame = docs.select(*[F.col(f"`{c}`") for c in keep], _stream(text).alias(fresh(docs, "_stream"))).mapInArrow(run, schema)
    ids = lambda x, k: F.split(F.split(x, r"\|")[k], ",").cast("array<int>")
    groups = F.transform(F.split("groups", ";"), lambda x: F.struct(ids(x, 0).alias("a"), ids(x, 1).alias("b")))
    return frame.withColumn("groups", F.when(F.col("groups") == "", F.array().cast(groups_type())).otherwise(groups))


def groups_type() -> str:
    return "array<struct<a:array<int>,b:array<int>>>"


#: A row for each document, and more for one of very many pairs; those have no doc_id and no counts.
LINKS = "row string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, numbers binary"


def links(docs: DataFrame, first: str, second: str, row_pairs: int = ROW_PAIRS) -> DataFrame:
    """LINKS of every document: pairs (little-endian unsigned 32 bits, in order) and their numbers (bytes, or 64 bits each where one is above 255)."""
    names = [x.split(" ")[0] for x in LINKS.split(", ")]
    types = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary()]

    def rows_of(doc: int | None, ok: bool, counts: np.ndarray, digest: str, pairs: list, numbers: list) -> Iterator[tuple]:
        row = uuid.uuid4().hex
        if not ok:
            counts, digest, pairs, numbers = np.zeros(4, np.int64), "", [], []
        pair = np.concatenate([np.zeros(0, np.uint32), *pairs])
        number = np.concatenate([np.zeros(0, np.int64), *numbers])
        if len(pairs) > 1:
            pair, number = _summed(pair, number)
        for at in range(0, max(1, len(pair)), row_pairs):
            some, often = pair[at : at + row_pairs], number[at : at + row_pairs]
            kept = often.astype(np.uint8) if not len(often) or often.max() < 256 else often
            yield (row, *(None if at else x for x in (doc, *counts.tolist(), digest)), some.tobytes(), kept.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(first, second)
        for batch in batches:
            out, size = [], 0
            ids, now = batch.column(0).to_pylist(), None
            for t, ok, counts, groups, pairs, numbers in (*by.align_column(batch.column(1)), (batch.num_rows, True, None, b"", None, None)):
                if now is not None and now[0] != t:
                    doc, good, total, digest, all_pairs, all_numbers = now
                    made = [*rows_of(ids[doc], good, total, digest.hexdigest() if total[0] else "", all_pairs, all_numbers)]
                    out += made
                    size += sum(len(m[7]) for m in made)
                    now = None
                if t == batch.num_rows or size > CHUNK_BYTES << 3:
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names)
                    out, size = [], 0
                if t == batch.num_rows:
                    break
                if now is None:
                    now = (t, ok, counts, hashlib.sha256(groups[1:]), [pairs], [numbers])
                else:
                    now[3].update(groups)
                    now[4].append(pairs)
                    now[5].append(numbers)
                    now = (t, now[1] and ok, now[2] + counts, *now[3:])
            trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _stream("text").alias("stream")).mapInArrow(run, LINKS)


def _pairs_of(pairs: bytes, numbers: bytes) -> tuple[np.ndarray, np.ndarray]:
    pair = np.frombuffer(pairs, "<u4")
    return pair, np.frombuffer(numbers, np.uint8 if len(numbers) == len(pair) else np.int64).astype(np.int64)


def pair_counts(table: DataFrame) -> DataFrame:
    """pair, n: how many documents hold each linked pair. Tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, held, size = np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for pairs in batch.column(0).to_pylist():
                held.append(np.frombuffer(pairs, "<u4"))
                size += len(held[-1])
                if size > COUNTED:
                    more, often = np.unique(np.concatenate(held), return_counts=True)
                    key, number = _summed(np.concatenate([key, more]), np.concatenate([number, often]))
                    held, size = [], 0
                    if len(key) > COUNTED:
                        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(number)], ["pair", "n"])
                        key, number = key[:0], number[:0]
        if held:
            more, often = np.unique(np.concatenate(held), return_counts=True)
            key, number = _summed(np.concatenate([key, more]), np.concatenate([number, often]))
        for at in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(key[at : at + (1 << 16)].astype(np.int64)), pa.array(number[at : at + (1 << 16)])], ["pair", "n"])
        trim()

    return table.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def digest(docs: DataFrame, first: str, second: str, frequent: int = FREQUENT, row_pairs: int = ROW_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    from sentencepiece import SentencePieceProcessor

    spark = docs.sparkSession
    width = SentencePieceProcessor(model_file=second).get_piece_size()
    table = written(links(docs, first, second, row_pairs), "links")
    counts = written(pair_counts(table), "pairs")
    best = counts.groupBy(F.floor(F.col("pair") / width).alias("a")).agg(F.max("n").alias("best"))  # a row for each id at most
    highest = np.zeros(0, np.int64)
    for r in best.collect():
        if r.a >= len(highest):
            highest = np.append(highest, np.zeros(r.a + 1, np.int64))
        highest[r.a] = r.best
    # The least number of binary digits of a count from which on at most `frequent` pairs are left.
    digits = F.length(F.bin("n"))
    least, upto = 65, 0
    for r in counts.groupBy(digits.alias("digits")).agg(F.count("*").alias("n")).orderBy(F.desc("digits")).collect():
        upto += r.n
        if upto > frequent:
            break
        least = r.digits
    known = counts.where(digits >= least).toArrow()
    pair, n = known.column("pair").to_numpy(), known.column("n").to_numpy()
    order = np.argsort(pair)
    sent = spark.sparkContext.broadcast((pair[order].astype(np.uint32), n[order], highest))
    rest = upto > frequent
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, highest = sent.value
        for batch in batches:
            n_best, count_sum = [], []
            for pairs, numbers in zip(batch.column(7).to_pylist(), batch.column(8).to_pylist(), strict=True):
                p, often = _pairs_of(pairs, numbers)
                at = np.minimum(np.searchsorted(pair, p), max(0, len(pair) - 1))
                of = np.where(pair[at] == p, n[at], 0) if len(pair) else np.zeros(len(p), np.int64)
                n_best.append(int(often[(of > 0) & (of == highest[p // width])].sum()))
                count_sum.append(int((often * of).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], names)
            trim()

    rows = table.mapInArrow(looked_up, "row string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    if rest:

        def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, _, _ = sent.value
            for batch in batches:
                rows_, pairs_, numbers_ = [], [], []
                for row, pairs, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    p, often = _pairs_of(pairs, numbers)
                    new = pair[np.minimum(np.searchsorted(pair, p), len(pair) - 1)] != p if len(pair) else np.ones(len(p), bool)
                    rows_.append((row, int(new.sum())))
                    pairs_.append(p[new].astype(np.int64))
                    numbers_.append(often[new])
                names_ = np.repeat(np.array([r for r, _ in rows_], object), [n for _, n in rows_])
                yield pa.RecordBatch.from_arrays([pa.array(names_, pa.string()), pa.array(np.concatenate([np.zeros(0, np.int64), *pairs_])), pa.array(np.concatenate([np.zeros(0, np.int64), *numbers_]))], ["row", "pair", "number"])

        few = counts.where(digits < least).join(F.broadcast(best), F.floor(F.col("pair") / width) == F.col("a")).select("pair", "n", (F.col("n") == F.col("best")).alias("is_best"))
        met = table.select("row", "pairs", "numbers").mapInArrow(rare, "row string, pair long, number long").join(few, "pair")
        found = met.groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("number")).otherwise(0)).alias("n_best"), F.sum(F.col("number") * F.col("n")).alias("count_sum"))
        rows = rows.unionByName(found, allowMissingColumns=True)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[total(c) for c in names[2:6]], total("n_best"), total("count_sum"), F.max("groups_sha256").alias("groups_sha256")).drop("row")
