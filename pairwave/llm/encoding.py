"""Exact, fast use of the tokenizers library: distinct pieces of text are encoded once and looked up with numpy.

A piece's ids never depend on its neighbours where a text is cut only at places that the tokenizer's own
pre-tokenizer always cuts: around white space, and between a Latin letter and a punctuation mark. Pieces are cut from
a column's bytes, hashed, looked up all at once and compared byte for byte; the library encodes those not seen before.
Texts of some 500 kB or more are handled in parts, cut at single blanks between visible ASCII characters, so memory is bounded by the
ids and not by a text's pieces. Parts for which the cuts aren't certain (strings of special tokens, unusual white space)
are encoded whole, as is a part beyond 1 MB without such a blank.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa

#: White space other than blank, tab, line feed and carriage return, by any of the definitions in use.
UNUSUAL_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]")
#: Pieces, or bytes of pieces, beyond which a PieceTable is cleared before the next chunk, and the bits of its slots' numbers at first.
TABLE_PIECES, TABLE_BYTES, TABLE_BITS = 600_000, 32 << 20, 21
#: Pieces encoded by one library call, and bytes of text handled at once. A longer text is cut into parts of that size.
CALL_PIECES, CHUNK_BYTES = 2_000, 1 << 18
#: Bytes beyond which a part without a place to cut it is encoded whole.
LONG_PART = 1 << 20

_SPACE, _LETTER, _PUNCT = (np.zeros(256, bool) for _ in range(3))
_SPACE[[*b" \t\n\r"]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT[[*b".,!?;:&$%*#"]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = True


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64 for i < n."""
    r = 0x9E3779B97F4A7C15
    out = []
    for base in (r, pow(r, -1, 1 << 64)):
        step = np.full(n, base, np.uint64)
        step[0] = 1
        out.append(np.multiply.accumulate(step))
    return out[0], out[1]


def gap(raw: np.ndarray, low: int, high: int) -> int | None:
    """The first blank at low or later, before high, between two visible ASCII characters: every tokenizer here cuts a text there, whatever lies around."""
    for at in range(max(low, 1), high - 1, 1 << 16):
        to = min(at + (1 << 16), high - 1)
        found = np.flatnonzero((raw[at:to] == 32) & _VISIBLE[raw[at - 1 : to - 1]] & _VISIBLE[raw[at + 1 : to + 1]])
        if len(found):
            return at + int(found[0])
    return None


class PieceTable:
    """A hash table from pieces of text to their ids, in arrays, looked up for many pieces at once.

    A 64-bit key finds the entry, whose bytes must then be the piece's own. Of different pieces with one key the first has the
    slot, the others are kept in a dict. It doubles its slots when more than half of them would be taken: a chunk has any number of pieces.
    """

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << TABLE_BITS, np.uint64)
        self.entry = np.zeros(1 << TABLE_BITS, np.int32)
        self.count = 0
        self.starts = np.zeros(1 << 16, np.int32)
        self.sizes = np.zeros(1 << 16, np.int32)  # -1: a part with this piece is encoded whole
        self.ids = np.zeros(1 << 18, self.dtype)
        self.used = 0
        self.begins = np.zeros(1 << 16, np.int32)
        self.lengths = np.zeros(1 << 16, np.int32)
        self.bytes = np.zeros(1 << 20, np.uint8)
        self.filled = 0
        self.clashes: dict[bytes, int] = {}

    def full(self) -> bool:
        return self.count > TABLE_PIECES or self.filled > TABLE_BYTES

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Entries of keys; -1 for those that aren't there. A key is never 0."""
        mask = np.uint64(len(self.keys) - 1)
        slot = keys & mask
        seen = self.keys[slot]
        out = np.where(seen == keys, self.entry[slot], -1)
        left = np.flatnonzero((seen != keys) & (seen != 0))
        while len(left):
            slot[left] = (slot[left] + np.uint64(1)) & mask
            seen = self.keys[slot[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.entry[slot[left[hit]]]
            left = left[~hit & (seen != 0)]
        return out

    def _same(self, entry: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the bytes of entries are those of raw from starts to ends."""
        ok = self.lengths[entry] == ends - starts
        at = np.flatnonzero(ok)
        if len(at):
            size = (ends - starts)[at]
            cuts = np.cumsum(size) - size
            mine = np.arange(int(size.sum()))
            theirs = mine + np.repeat(self.begins[entry[at]] - cuts, size)
            mine += np.repeat(starts[at] - cuts, size)
            ok[at] = np.logical_and.reduceat(raw[mine] == self.bytes[theirs], cuts)
        return ok

    def find(self, keys: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Entries of the pieces of raw from starts to ends; -1 for those that aren't there."""
        out = self.slots(keys)
        hit = np.flatnonzero(out >= 0)
        for i in hit[~self._same(out[hit], raw, starts[hit], ends[hit])].tolist():
            out[i] = self.clashes.get(raw[starts[i] : ends[i]].tobytes(), -1)
        return out

    @staticmethod
    def _grown(array: np.ndarray, need: int) -> np.ndarray:
        while need > len(array):
            array = np.append(array, np.zeros_like(array))
        return array

    def add(self, keys: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, sizes: np.ndarray, clash: bool = False) -> None:
        """New, distinct pieces with their ids one after the other. Their keys are new and distinct too, or all taken (clash)."""
        need, room, upto = self.count + len(keys), self.used + len(ids), self.filled + int((ends - starts).sum())
        self.starts, self.sizes, self.begins, self.lengths = (self._grown(a, need) for a in (self.starts, self.sizes, self.begins, self.lengths))
        self.ids, self.bytes = self._grown(self.ids, room), self._grown(self.bytes, upto)
        new, length = slice(self.count, need), np.maximum(sizes, 0)
        self.starts[new] = self.used + np.cumsum(length) - length
        self.sizes[new] = sizes
        self.ids[self.used : room] = ids
        self.lengths[new] = ends - starts
        self.begins[new] = self.filled + np.cumsum(ends - starts) - (ends - starts)
        self.bytes[self.filled : upto] = raw[np.repeat(starts + self.filled - self.begins[new], ends - starts) + np.arange(upto - self.filled)]
        if clash:
            for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                self.clashes[raw[a:b].tobytes()] = self.count + k
        else:
            if 2 * need > len(self.keys):
                taken = np.flatnonzero(self.keys)
                old, entry = self.keys[taken], self.entry[taken]
                self.keys = np.zeros(1 << (2 * need - 1).bit_length(), np.uint64)
                self.entry = np.zeros(len(self.keys), np.int32)
                self._place(old, entry)
            self._place(keys, np.arange(self.count, need))
        self.count, self.used, self.filled = need, room, upto

    def _place(self, keys: np.ndarray, entry: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        slot, left = keys & mask, np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]] = keys[won]
            self.entry[slot[won]] = entry[won]
            left = np.setdiff1d(left, won, True)
            slot[left] = (slot[left] + np.uint64(1)) & mask


class MemoEncoder:
    """Encodes like Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, without truncation or padding.

    A subclass may encode pieces and texts by other means (`_pieces`, `_odd`, `_whole`).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        plain = [(t["content"], t["id"]) for t in kind["added_tokens"] if t["special"] and not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"])]
        self.specials = [t["content"] for t in kind["added_tokens"]]
        self.sep, self.sep_id = plain[-1] if plain else (None, None)
        self.mode = self._mode(kind) if self.sep and len(plain) == len(self.specials) else None
        if self.mode and any(len(self._cuts(np.frombuffer(s.encode(), np.uint8), np.array([0, len(s.encode())]))[0]) > 1 for s in self.specials):
            self.mode = None
        self.table = PieceTable(self.dtype)

    @staticmethod
    def _mode(kind: dict) -> str | None:
        """Which cuts keep the ids; None where that isn't known."""
        pre, norm = kind.get("pre_tokenizer") or {}, kind.get("normalizer") or {}
        if kind.get("post_processor"):
            return None
        if not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "bytes"
        parts = [p.get("type") for p in pre.get("pretokenizers", [])]
        steps = [p.get("type") for p in norm.get("normalizers", [])]
        if parts == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["behavior"] == "Removed" and set(steps) <= {"NFC", "Replace", "Lowercase"}:
            return "words"
        return None

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype)

    def _cuts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start and end. Words: white space is in none. Bytes: a blank before a word is the word's, other white space stands alone, but a run up to its last."""
        n = len(raw)
        space = np.zeros(n + 1, bool)
        space[:n] = _SPACE[raw]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.ones(n + 1, bool)  # whether the byte before is white space or of another text
        before[1:] = space[:n]
        letter = np.zeros(n + 1, bool)
        letter[1:] = _LETTER[raw]
        high = np.flatnonzero(raw[1:] >= 128)
        letter[high + 2] = (raw[high] == 0xC3) & (raw[high + 1] != 0x97) & (raw[high + 1] != 0xB7)
        cut = edge.copy()
        cut[:n] |= letter[:n] & _PUNCT[raw]
        if self.mode == "words":
            cut |= space != before
            starts = np.flatnonzero(cut[:n] & ~space[:n])
            ends = np.flatnonzero(cut[1:] & ~space[:n]) + 1
            return starts, ends
        last = space[:n] & ~space[1:] & ~edge[1:]
        cut[:n] |= space[:n] & (~before[:n] | last)
        cut[1:] |= last & (raw != 32)
        cut[n] = False
        starts = np.flatnonzero(cut)
        return starts, np.append(starts[1:], n)

    def _odd(self, pieces: list[str]) -> list[bool] | None:
        """Which pieces can't be encoded alone; None: none of them."""
        text = "\n".join(pieces)
        if not UNUSUAL_SPACE.search(text) and not any(s in text for s in self.specials):
            return None
        return [bool(UNUSUAL_SPACE.search(p)) or any(s in p for s in self.specials) for p in pieces]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and how many each has."""
        ids = np.array(self.tok.encode_batch_fast([self.sep.join(pieces)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.append(np.flatnonzero(ids == self.sep_id), len(ids))
        return ids[ids != self.sep_id], np.diff(ends, prepend=-1) - 1

    def _learn(self, raw: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, clash: bool = False) -> None:
        pieces = [raw[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        if odd := self._odd(pieces):
            alone = ~np.array(odd)
            self.table.add(keys[~alone], raw, starts[~alone], ends[~alone], np.zeros(0, self.dtype), np.full(int((~alone).sum()), -1, np.int32), clash)
            keys, starts, ends, pieces = keys[alone], starts[alone], ends[alone], [p for p, o in zip(pieces, odd, strict=True) if not o]
        for at in range(0, len(pieces), CALL_PIECES):
            part = slice(at, at + CALL_PIECES)
            ids, sizes = self._pieces(pieces[part])
            self.table.add(keys[part], raw, starts[part], ends[part], ids, sizes.astype(np.int32), clash)

    def _entries(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table's entries of all pieces; new ones are learned first."""
        power, inverse = _powers(max(3 * CHUNK_BYTES, len(raw)))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
        keys = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        keys = (keys ^ (keys >> np.uint64(32))) | np.uint64(1) << np.uint64(63)
        table = self.table
        if table.full():
            table.clear()
        entry = table.find(keys, raw, starts, ends)
        new = np.flatnonzero(entry < 0)
        if len(new):
            _, first = np.unique(keys[new], return_index=True)
            pick = new[first]
            pick = pick[table.slots(keys[pick]) < 0]
            self._learn(raw, keys[pick], starts[pick], ends[pick])
            entry[new] = table.find(keys[new], raw, starts[new], ends[new])
        left = np.flatnonzero(entry < 0)
        if len(left):
            pick = np.array(sorted({raw[starts[i] : ends[i]].tobytes(): i for i in left.tolist()}.values()))
            self._learn(raw, keys[pick], starts[pick], ends[pick], True)
            entry[left] = table.find(keys[left], raw, starts[left], ends[left])
        return entry

    def _chunk(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that lie one after the other in raw, and how many each has."""
        parts = len(offsets) - 1
        whole = lambda i: self._whole(raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "surrogatepass"))
        if self.mode is None or len(raw) > LONG_PART:
            got = [whole(i) for i in range(parts)]
            return np.concatenate([np.zeros(0, self.dtype), *got]), np.array([len(p) for p in got], np.int64)
        starts, ends = self._cuts(raw, offsets)
        entry, table = self._entries(raw, starts, ends), self.table
        size = table.sizes[entry].astype(np.int64)
        owner = np.searchsorted(offsets, starts, "right") - 1
        odd = np.unique(owner[size < 0])
        size = np.maximum(size, 0)
        total = int(size.sum())
        ids = table.ids[np.repeat(table.starts[entry] - (np.cumsum(size) - size), size) + np.arange(total)]
        counts = np.bincount(owner, size, parts).astype(np.int64)
        if len(odd):
            cut = np.split(ids, np.cumsum(counts)[:-1])
            for i in odd.tolist():
                cut[i] = whole(i)
                counts[i] = len(cut[i])
            ids = np.concatenate(cut)
        return ids, counts

    def _parts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of parts, and the place of each text's first part: texts beyond two chunks are cut where the ids stay the same."""
        cuts: list[int] = []
        for i in np.flatnonzero(np.diff(offsets) > 2 * CHUNK_BYTES).tolist() if self.mode else ():
            at, end = int(offsets[i]), int(offsets[i + 1])
            while end - at > 2 * CHUNK_BYTES and (at := gap(raw, at + CHUNK_BYTES, end)) is not None:
                cuts.append(at)
        if not cuts:
            return offsets, np.arange(len(offsets) - 1)
        inner = np.array(cuts, np.int64)
        # A cut lies inside one text, so it comes after as many texts' starts as its place says.
        first = np.arange(len(offsets) - 1) + np.searchsorted(inner, offsets[:-1])
        return np.insert(offsets, np.searchsorted(offsets, inner), inner), first

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column, one after the other, and how many each has; null is the empty text."""
        column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        if not len(column):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        offsets, first = self._parts(raw, offsets)
        ids, counts, at, parts = [], [], 0, len(offsets) - 1
        while at < parts:
            to = min(parts, max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1))
            got = self._chunk(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            ids.append(got[0]), counts.append(got[1])
            at = to
        return np.concatenate(ids), np.add.reduceat(np.concatenate(counts), first)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, counts = self.encode_column(pa.array(texts, pa.large_string()))
        return np.split(ids, np.cumsum(counts)[:-1]) if texts else []


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and counts with one more id at the end of each text."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> MemoEncoder:
    """One encoder for each worker process and file."""
    return MemoEncoder(path)
