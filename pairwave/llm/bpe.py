"""BPE encoding by speculation and verification, and decoding (operator 7).

Greedy longest-match proposes tokens for a word; the proposal is the BPE result if and only if every proposed token
encodes to itself and every adjacent pair stays apart when merged alone. Both are tested for all words of a batch at
once with numpy; only words that fail are merged exactly, in order of merge rank. Results are remembered for distinct
pieces (text between white space).

The normaliser and word pattern are those of the tokenizer's file: where a piece has only letters below U+0250 the
word pattern runs here, else the library's own normaliser and pre-tokenizer cut it. Merging, the model itself, is
always done here.

Null text is the empty text: no ids, decoded "". Extra columns are ignored; rows may repeat. Very long texts are encoded and
hashed in parts, very long words are merged with a heap.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encoding import UNUSUAL_SPACE, MemoEncoder
from .frames import extended, fresh, trim

#: Ranks above every merge's.
NEVER = 1 << 40
#: Symbols from which a word is merged with a heap of its pairs.
LONG_WORD = 64
#: Ids whose strings are joined at once.
JOIN_IDS = 1 << 18


@functools.cache
def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable in Latin-1, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Vocabulary and merges as arrays: for each token its two parts and its merge's rank; for a pair its merge."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocab.values()) + 1
        self.tokens = [""] * size
        for token, i in vocab.items():
            self.tokens[i] = token
        self.vocab = vocab
        # The most characters of a token that begins with two given ones, without the mark of a word's end.
        self.reach: dict[str, int] = {}
        for token in vocab:
            bare = token.removesuffix(END)
            self.reach[bare[:2]] = max(self.reach.get(bare[:2], 0), len(bare))
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)  # of the merge that makes a token; -1: a single symbol
        self.size = size
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        keys = np.empty(len(merges), np.int64)
        for r, (a, b) in enumerate(merges):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.pairs[x, y] = (r, made)
            keys[r] = x * size + y
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = x, y, r
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], order.astype(np.int64)
        self.sound: dict[int, bool] = {}

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair; NEVER where there is none."""
        want = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.key_rank[at], NEVER)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE of each pair's joined symbols gives the same pair again.

        Both tokens are unbuilt merge by merge, the later merge first. At each step the two parts that touch must not
        have a merge that comes before the merge that took one of them away: left to right order decides equal ranks,
        so the left token's merge wins over an equal one.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        # The time at which the touching parts a and b are gone, because one was merged into its token; doubled, with a tie bit.
        limit = np.full(len(a), 2 * NEVER)
        while len(live):
            meets = 2 * self.merge_rank(a, b)
            bad = meets < limit
            ok[live[bad]] = False
            ra, rb = 2 * self.rank[a], 2 * self.rank[b]
            done = bad | ((ra < 0) & (rb < 0))
            keep = ~done
            live, a, b, ra, rb = live[keep], a[keep], b[keep], ra[keep], rb[keep]
            # The later of both merges is undone. A merge inside the left token at the same rank happens before the pair's.
            from_left = ra >= rb
            limit = np.where(from_left, ra, rb + 1)
            a, b = np.where(from_left, self.right[a], a), np.where(from_left, b, self.left[b])
        return ok

    def merged(self, word: list[str]) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equal ones."""
        if len(word) > LONG_WORD:
            return self._merged_long([self.vocab[s] for s in word])
        ids, none = [self.vocab[s] for s in word], (NEVER, -1)
        find = self.pairs.get
        steps = [find(p, none) for p in zip(ids, ids[1:])]
        while steps:
            best = min(steps)
            if best is none:
                break
            i = steps.index(best)
            ids[i : i + 2] = [best[1]]
            del steps[i]
            if i:
                steps[i - 1] = find((ids[i - 1], ids[i]), none)
            if i < len(steps):
                steps[i] = find((ids[i], ids[i + 1]), none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same for any number of symbols in n log n steps: a heap of pairs, and links to the neighbours that are left."""
        n, find = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(hit[0], i, ids[i], ids[i + 1], hit[1]) for i in range(n - 1) if (hit := find((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            k = after[i]
            if ids[i] != a or k >= n or ids[k] != b:
                continue  # one of both was merged since
            ids[i], ids[k] = made, -1
            after[i] = after[k]
            if after[i] < n:
                before[after[i]] = i
                if hit := find((made, ids[after[i]])):
                    heapq.heappush(heap, (hit[0], i, made, ids[after[i]], hit[1]))
            if (h := before[i]) >= 0 and (hit := find((ids[h], made))):
                heapq.heappush(heap, (hit[0], h, ids[h], made, hit[1]))
        return [i for i in ids if i >= 0]

    def is_sound(self, token: int) -> bool:
        """Whether a token's own symbols merge to that token."""
        if (known := self.sound.get(token)) is None:
            known = self.sound[token] = self.merged(symbols(self.tokens[token])) == [token]
        return known

    def propose(self, word: str) -> list[int]:
        """Greedy longest match over the vocabulary; only the last token carries the mark of the word's end."""
        vocab, reach, out, at, n = self.vocab, self.reach, [], 0, len(word)
        while at < n:
            last = min(n, at + reach.get(word[at : at + 2], 1))
            for end in range(last, at, -1):
                if (i := vocab.get(word[at:end] if end < n else word[at:] + END)) is not None:
                    break
            else:
                return []
            out.append(i)
            at = end
        return out


END = "</w>"


def symbols(word: str) -> list[str]:
    """The symbols that merging starts from; the mark of a word's end belongs to its last symbol."""
    if word.endswith(END) and len(word) > len(END):  # no token has these characters as symbols of their own beside the mark
        return [*word[: -len(END) - 1], word[-len(END) - 1 :]]
    return list(word)


class SpeculativeBpe(MemoEncoder):
    """Encoder and decoder for a tokenizer file with a word pattern, byte alphabet and end-of-word mark."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        model, pre = kind["model"], kind["pre_tokenizer"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or self.mode != "words":
            raise ValueError("this encoder needs a word-split, byte-level BPE with end-of-word marks")
        self.merges = MergeTable(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.words = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in kind["added_tokens"]}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.names = {**dict(enumerate(self.merges.tokens)), **{i: s for s, i in self.special.items()}}
        # Of each id: its digits and a blank, its string and a blank.
        size = max(self.names) + 1
        self.digits = ByteStrings([b"%d " % i for i in range(size)])
        self.strings = ByteStrings([(self.names[i] + " ").encode() if i in self.names else b"" for i in range(size)])
        self.translate = {b: c for b, c in enumerate(byte_alphabet()) if chr(b) != c}
        self.failed = 0

    def word_strings(self, piece: str) -> list[str]:
        """The words of a piece in the byte alphabet, without the mark of their end."""
        if piece.isascii() and piece.isalpha():
            return [piece.lower()]
        if max(piece) < "ɐ" and not UNUSUAL_SPACE.search(piece):
            found = self.words.findall(unicodedata.normalize("NFC", piece).lower())
            return found if piece.isascii() and piece.isprintable() else [w.encode().decode("latin-1").translate(self.translate) for w in found]
        normal = self.tok.normalizer.normalize_str(piece)
        return [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(normal)]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words: speculate, verify all adjacent pairs of all words at once, merge what fails."""
        table = self.merges
        guess = [table.propose(w) for w in words]
        lengths = np.array([len(g) for g in guess], np.int64)
        flat = np.array([i for g in guess for i in g], np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        good = lengths > 0
        if len(flat):
            unsound = np.array([i for i in np.unique(flat).tolist() if not table.is_sound(i)], np.int64)
            good[owner[np.isin(flat, unsound)]] = False
            pair = np.flatnonzero(owner[1:] == owner[:-1])
            both, back = np.unique(flat[pair] * table.size + flat[pair + 1], return_inverse=True)
            good[owner[pair[~table.apart(both // table.size, both % table.size)[back]]]] = False
        for k in np.flatnonzero(~good).tolist():
            w = words[k]
            guess[k] = table.merged([*w[:-1], w[-1] + END])
        self.failed += int((~good).sum())
        return guess

    def _odd(self, pieces: list[str]) -> None:
        """Every piece can be encoded alone here."""

    def _whole(self, text: str) -> np.ndarray:
        return self._pieces([p for p in regex.split("[ \t\n\r]+", text) if p])[0]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut: list[list] = []
        special = any(s in "\n".join(pieces) for s in self.special)
        for piece in pieces:
            if special and any(s in piece for s in self.special):
                cut.append([w for p in self.cut_special.split(piece) if p for w in ([self.special[p]] if p in self.special else self.word_strings(p))])
            else:
                cut.append(self.word_strings(piece))
        words = list({w for ws in cut for w in ws if isinstance(w, str)})
        known = dict(zip(words, self.encode_words(words), strict=True))
        ids = [[i for w in ws for i in (known[w] if isinstance(w, str) else (w,))] for ws in cut]
        return np.array([i for x in ids for i in x], self.dtype), np.array([len(x) for x in ids], np.int64)

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by blanks: the tokenizer's file names no decoder. Ids that it lacks are left out."""
        names = self.names
        return " ".join([names[i] for i in ids if i in names])


class ByteStrings:
    """Byte strings by number, joined for arrays of numbers."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def sha256(self, numbers: np.ndarray, counts: np.ndarray) -> list[str]:
        """SHA-256 of the strings of counts numbers each, without the last byte; many numbers are joined in parts."""
        out, at, ends = [], 0, np.cumsum(counts)
        while at < len(counts):
            begin = int(ends[at] - counts[at])
            to = max(at + 1, int(np.searchsorted(ends, begin + JOIN_IDS, "right")))
            if to > at + 1 or counts[at] <= JOIN_IDS:
                out += [hashlib.sha256(x).hexdigest() for x in self.join(numbers[begin : ends[to - 1]], counts[at:to])]
            else:
                sum_, last = hashlib.sha256(), int(ends[at])
                for k in range(begin, last, JOIN_IDS):
                    part = numbers[k : min(k + JOIN_IDS, last)]
                    sum_.update(self.join(part, np.array([len(part)]), k + JOIN_IDS >= last)[0])
                out.append(sum_.hexdigest())
            at = to
        return out

    def join(self, numbers: np.ndarray, counts: np.ndarray, cut: bool = True) -> list[memoryview]:
        """The strings of numbers one after the other, in parts of counts numbers each, each without its last byte if cut."""
        size = self.sizes[numbers]
        ends = np.cumsum(size)
        place = np.repeat(self.starts[numbers] - (ends - size), size)
        place += np.arange(len(place))
        raw = memoryview(self.data[place].tobytes())
        cuts = np.append(0, ends)[np.append(0, np.cumsum(counts))].tolist()
        return [raw[a : max(a, b - cut)] for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(maxsize=2)
def speculative(path: str) -> SpeculativeBpe:
    return SpeculativeBpe(path)


def encode_frame(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """docs with a column ids (array of int), replacing one of that name."""
    keep = [c for c in docs.columns if c != "ids"]
    schema = extended(docs.select(*[F.col(f"`{c}`") for c in keep]).schema, ids=T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = speculative(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, counts = enc.encode_column(part.column(part.num_columns - 1))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*keep, "ids"])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(fresh(docs, "_text"))).mapInArrow(run, schema)


def decode_frame(frame: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """frame with a column decoded (string; null ids give ""), replacing one of that name."""
    keep = [c for c in frame.columns if c != "decoded"]
    schema = extended(frame.select(*[F.col(f"`{c}`") for c in keep]).schema, decoded=T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = speculative(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [dec.decode(x or ()) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.string())], names=[*keep, "decoded"])

    return frame.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias(fresh(frame, "_ids"))).mapInArrow(run, schema)


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: of what encode and decode give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = speculative(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, counts = enc.encode_column(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), pa.array(enc.digits.sha256(ids, counts)), pa.array(enc.strings.sha256(ids, counts))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
