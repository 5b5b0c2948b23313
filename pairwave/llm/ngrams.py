"""Word n-gram Jaccard join by MinHash banding (operator 6).

1. Equal texts are one text class, named by its least doc_id. 2. Each text gets a MinHash signature of its word
n-grams; band and row counts follow from the wanted recall at the threshold. 3. Text classes are shuffled on (band,
band hash). A pair belongs to the first band in which it agrees, so it is looked at once. Buckets are cut into
blocks of BLOCK texts and pairs of blocks, so that no task holds a large group. 4. Only texts with such a pair get their full
n-gram sets, sent to the blocks that need them, and every pair is verified there on these sets. A block returns for
each text its number of links and the least text that it is connected with, not the pairs. 5. Links are summed,
and classes are the connected components (large-star and small-star steps, written to the shared folder each time).

Words are lower-cased and cut at white space; a text of fewer than n words has one n-gram, all its words. Null text is
the empty text. Texts without words are copies of equal texts only. Null doc_ids count below all others. Texts are told
apart by their hashes, whatever their ids: rows with the same doc_id, or with none, have links of their own where their texts
differ, and a repeated row is one text. An empty table gives no rows; extra columns are ignored. Ties go to the least doc_id, then to the least text hash.
Very long texts are cut and hashed in parts; a bucket's blocks hold a bounded number of texts and of n-grams.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import forget, fresh, hashed_words, rows, stored, written

N, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Texts in a block of a bucket, and n-grams that their full sets should have together.
BLOCK, BLOCK_GRAMS = 512, 4 << 20
#: Bytes of the needed-texts table up to which it is broadcast; beyond, it is shuffled.
BROADCAST_BYTES = 32 << 20
#: Bytes of n-gram sets after which a batch goes on.
FLUSH_BYTES = 4 << 20
#: N-grams hashed at once.
PART = 1 << 20
#: Copies from which a text's rows are joined by broadcast: as many such texts as there are rows, over this number, at most.
HOT_COPIES = 100_000
#: Dropped rows (an id and a text hash, 24 bytes each) up to which they are broadcast to the filter; beyond, they are shuffled.
DROPPED_ROWS = 600_000
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
#: Words whose hashes a worker remembers.
WORD_MEMO = 120_000
_UNIT = ["band", "hash", "lo", "hi"]


@functools.cache
def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 128) -> tuple[int, int]:
    """Bands and rows: the most rows, so the fewest false candidates, that reach the recall at the threshold with `most` hashes."""
    for r in range(most, 0, -1):
        b = 1
        while b * r <= most:
            if 1 - (1 - threshold**r) ** b >= recall:
                return b, r
            b += 1
    raise ValueError("this recall needs more hashes")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) << np.uint64(1) | np.uint64(1)


_words: dict[str, int] = {}


def shingles(texts: list[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams, text after text (with repetitions), and how many each text has."""
    words, lengths = hashed_words(texts, _words, WORD_MEMO, xxhash.xxh3_64_intdigest)
    counts = np.where(lengths >= n, lengths - n + 1, np.minimum(lengths, 1))
    factor = _odd(5, n)
    windows = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n if len(windows) else 0):
        windows += words[k : k + len(windows)] * factor[k]
    begins = np.cumsum(lengths) - lengths
    long = lengths >= n
    if len(texts) == 1 and long[0]:
        return mix(windows), counts
    take = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    out = np.empty(len(take), np.uint64)
    is_long = np.repeat(long, counts)
    out[is_long] = windows[take[is_long]]
    for i in np.flatnonzero((lengths > 0) & ~long).tolist():
        ws = words[begins[i] : begins[i] + lengths[i]]
        out[counts[:i].sum()] = (ws * factor[: len(ws)]).sum() + np.uint64(len(ws))
    return mix(out), counts


def signatures(grams: np.ndarray, counts: np.ndarray, bands: int, width: int) -> np.ndarray:
    """Band hashes (texts x bands, int64); texts without n-grams get zeros."""
    out = np.zeros((len(counts), bands), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out.view(np.int64)
    starts = (np.cumsum(counts) - counts)[full]
    a, b, c = _odd(7, bands * width), _odd(11, bands * width), _odd(13, width)
    least = np.full((bands * width, len(full)), np.iinfo(np.uint64).max, np.uint64)
    # A few texts at a time, so that their n-grams stay in the processor's cache; a very long one in parts.
    at = 0
    while at < len(full):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + 30_000)))
        end = int(starts[to]) if to < len(full) else len(grams)
        for begin in range(int(starts[at]), end, PART if to == at + 1 else end):
            part = grams[begin : min(end, begin + PART) if to == at + 1 else end]
            own = starts[at:to] - starts[at]
            for k in range(bands * width):
                found = np.minimum.reduceat(part * a[k] + b[k] >> np.uint64(32), own)
                np.minimum(least[k, at:to], found, out=least[k, at:to])
        at = to
    for k in range(bands):
        out[full, k] = mix(sum(least[k * width + j] * c[j] for j in range(width)) + np.uint64(k))
    return out.view(np.int64)


def known_id() -> Column:
    """doc_id as a number, NO_ID for none."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def key_of_text() -> Column:
    """128 bits of the text's SHA-256; null is the empty text."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)), 1, 16)


def node_of(id_: Column, key: Column) -> Column:
    """24 bytes that name a text under an id, in the order of ids, then of text keys."""
    return F.concat(F.unhex(F.lpad(F.hex(id_.bitwiseXOR(F.lit(NO_ID))), 16, "0")), key)


def id_of(node: str) -> Column:
    """The id in a node; null for NO_ID."""
    number = F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(NO_ID))
    return F.nullif(number, F.lit(NO_ID))


def text_signatures(docs: DataFrame, n: int, bands: int, width: int) -> DataFrame:
    """id, text_key (128-bit hash of the text), bands (8 bytes each; empty without words), grams (how many n-grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, texts in rows(batches, 256):
            grams, counts = shingles(texts, n)
            signed = signatures(grams, counts, bands, width)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array([s.tobytes() if c else b"" for s, c in zip(signed, counts.tolist(), strict=True)], pa.binary()), pa.array(counts)], ["id", "text_key", "bands", "grams"])

    return docs.select(known_id().alias("id"), key_of_text().alias("text_key"), "text").mapInArrow(run, "id long, text_key binary, bands binary, grams long")


def text_classes(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """text_key, first (its least id), copies for each text; rep (its node), bands, grams, own (rows with that id and text) for each text with words."""
    # Counted before anything is joined: rows of one id and text are one row from here on. Their signatures are equal.
    own = written(signed.groupBy("id", "text_key").agg(F.count("*").alias("own"), F.first("bands").alias("bands"), F.first("grams").alias("grams")), "texts-by-id")
    classes = written(own.groupBy("text_key").agg(F.min("id").alias("first"), F.sum("own").alias("copies")), "text-classes")
    # Joined on the id as well, so copies of one text under many ids aren't one task.
    own = own.where(F.length("bands") > 0).withColumnRenamed("text_key", "_key")
    reps = classes.join(own, (F.col("text_key") == F.col("_key")) & (F.col("first") == F.col("id")))
    return classes, reps.select(node_of(F.col("first"), F.col("text_key")).alias("rep"), "bands", "grams", "own")


def by_unit(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of rows with the same first four values, as (those values, the other columns)."""
    key, held = None, [[] for _ in range(columns)]
    for part in rows(batches, 4096):
        keys = list(zip(*part[:4], strict=True))
        at = 0
        while at < len(keys):
            to = at + 1
            while to < len(keys) and keys[to] == keys[at]:
                to += 1
            if keys[at] != key:
                if key is not None:
                    yield key, held
                key, held = keys[at], [[] for _ in range(columns)]
            for have, column in zip(held, part[4:], strict=True):
                have += column[at:to]
            at = to
    if key is not None:
        yield key, held


def own_pairs(band: int, signed: np.ndarray, side: np.ndarray | None) -> np.ndarray:
    """Which pairs (a matrix above its diagonal) agree in no band before `band`; side: only pairs between the two sides."""
    n = len(signed)
    mine = np.triu(np.ones((n, n), bool), 1) if side is None else side[:, None] < side[None, :]
    for b in range(band):
        mine &= signed[:, b][:, None] != signed[:, b][None, :]
    return mine


def _sides(lo: int, hi: int, blocks: list[int]) -> np.ndarray | None:
    return None if lo == hi else (np.array(blocks) == hi).astype(np.int8)


def candidate_units(reps: DataFrame) -> DataFrame:
    """band, hash, lo, hi, block, rep, bands: the texts of each pair of blocks of each bucket with two texts at least."""
    places = F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("bands") / 8).cast("int") - 1), lambda k: F.substring(F.col("bands"), (k * 8 + 1).cast("int"), F.lit(8))))
    single = reps.select(places.alias("band", "hash"), "rep", "bands", "grams")
    full = single.groupBy("band", "hash").agg(F.count("*").alias("n"), F.sum("grams").alias("all")).where("n > 1")
    # Texts of a block are chosen by hash, so their n-grams are near BLOCK_GRAMS together, or those of one text.
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all") / BLOCK_GRAMS)).cast("int")
    member = single.join(full, ["band", "hash"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return member.select("band", "hash", "block", "rep", "bands", other.alias("o")).select("band", "hash", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"), "block", "rep", "bands")


def needs(units: DataFrame) -> DataFrame:
    """units' rows whose text has a pair that belongs to the unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [*_UNIT, "block", "rep", "bands"])

        for key, (block, rep, signed) in by_unit(batches, 3):
            if len(rep) < 2:
                continue
            if len(rep) == 2 and key[2] == key[3]:
                size = 8 * key[0]
                a, b = signed[0][:size], signed[1][:size]
                keep = [0, 1] if not any(a[i : i + 8] == b[i : i + 8] for i in range(0, size, 8)) else []
            else:
                mine = own_pairs(key[0], np.frombuffer(b"".join(signed), np.int64).reshape(len(rep), -1), _sides(key[2], key[3], block))
                keep = np.flatnonzero(mine.any(0) | mine.any(1)).tolist()
            out += [(*key, block[i], rep[i], signed[i]) for i in keep]
            if len(out) >= 4096:
                yield batch()
                out = []
        if out:
            yield batch()

    dealt = units.repartition(*_UNIT).sortWithinPartitions(*_UNIT)
    return dealt.select(*_UNIT, "block", "rep", "bands").mapInArrow(run, "band int, hash binary, lo int, hi int, block int, rep binary, bands binary")


def with_sets(docs: DataFrame, needed: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """needed's rows with grams, the sorted set of the text's n-gram hashes (8 bytes each)."""
    units = needed.groupBy("rep", "bands").agg(F.collect_list(F.struct(*_UNIT, "block")).alias("units"))
    repeated = reps.where("own > 1").select(F.col("rep").alias("_rep"), "own")
    units = written(units.join(repeated, F.col("rep") == F.col("_rep"), "left").drop("_rep"), "needed-texts")
    size = units.agg(F.sum(F.lit(64) + F.length("rep") + F.length("bands") + 64 * F.size("units"))).first()[0] or 0
    side = F.broadcast(units) if size <= BROADCAST_BYTES else units
    joined = docs.select(node_of(known_id(), key_of_text()).alias("node"), "text").join(side, F.col("node") == F.col("rep")).select("rep", "bands", "units", "text", "own")
    if not units.where("own is not null").isEmpty():
        # Of a repeated row one goes on; only such rows are shuffled for it.
        joined = joined.where("own is null").union(joined.where("own is not null").dropDuplicates(["rep"]))
    joined = joined.drop("own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def batch() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [*_UNIT, "block", "rep", "bands", "grams"])

        for rep, signed, where, texts in rows(batches, 64):
            grams, counts = shingles(texts, n)
            ends = np.cumsum(counts)
            for r, s, units_, c, e in zip(rep, signed, where, counts.tolist(), ends.tolist(), strict=True):
                found = np.unique(grams[e - c : e]).tobytes()
                for u in units_:
                    out.append((u["band"], u["hash"], u["lo"], u["hi"], u["block"], r, s, found))
                    size += len(found) + len(s)
                    if size > FLUSH_BYTES:
                        yield batch()
                        out, size = [], 0
        if out:
            yield batch()

    return joined.mapInArrow(run, "band int, hash binary, lo int, hi int, block int, rep binary, bands binary, grams binary")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over slices of the n-grams."""
    n = len(sets)
    grams, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    shared = np.zeros((n, n), np.float32)
    step = max(256, 4_000_000 // n)
    for at in range(0, len(grams), step):
        a, b = np.searchsorted(place, [at, at + step])
        part = np.zeros((n, min(step, len(grams) - at)), np.float32)
        part[owner[a:b], place[a:b] - at] = 1
        shared += part @ part.T
    return shared.astype(np.int64)


def linked(mine: np.ndarray, sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Pairs (rows of two places) among `mine` with a Jaccard similarity of at least the threshold, and that similarity."""
    size = np.array([len(s) for s in sets])
    a, b = np.nonzero(mine & (np.minimum.outer(size, size) >= threshold * np.maximum.outer(size, size)))
    if not len(a):
        return np.zeros((0, 3))
    if len(a) > 2 * len(sets):
        common = overlaps(sets)[a, b]
    else:
        common = np.array([np.intersect1d(sets[i], sets[j], True).size for i, j in zip(a.tolist(), b.tolist(), strict=True)])
    score = common / (size[a] + size[b] - common)
    good = score >= threshold
    return np.stack([a[good], b[good], score[good]], 1)


def roots(n: int, pairs: np.ndarray, names: list[bytes]) -> list[bytes]:
    """For each place the least name of those that it is connected with."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs[:, :2].astype(np.int64).tolist():
        a, b = find(a), find(b)
        if a != b:
            if names[a] < names[b]:
                a, b = b, a
            parent[a] = b
    return [names[find(x)] for x in range(n)]


def verified(rows_: DataFrame, threshold: float, pairs: bool = False) -> DataFrame:
    """rep, links, root for each text with links in a unit; with pairs: rep, other, jaccard for each link between texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (block, rep, signed, grams) in by_unit(batches, 4):
            if len(rep) < 2:
                continue
            mine = own_pairs(key[0], np.frombuffer(b"".join(signed), np.int64).reshape(len(rep), -1), _sides(key[2], key[3], block))
            found = linked(mine, [np.frombuffer(g, np.uint64) for g in grams], threshold)
            if not len(found):
                continue
            if pairs:
                ends = [[rep[int(i)] for i in found[:, k]] for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in zip(*ends, strict=True)], pa.binary()), pa.array([max(x) for x in zip(*ends, strict=True)], pa.binary()), pa.array(found[:, 2])], ["rep", "other", "jaccard"])
                continue
            links = np.bincount(found[:, :2].astype(np.int64).ravel(), minlength=len(rep))
            root = roots(len(rep), found, rep)
            keep = np.flatnonzero(links).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([rep[i] for i in keep], pa.binary()), pa.array(links[keep]), pa.array([root[i] for i in keep], pa.binary())], ["rep", "links", "root"])

    dealt = rows_.repartition(*_UNIT).sortWithinPartitions(*_UNIT)
    return dealt.select(*_UNIT, "block", "rep", "bands", "grams").mapInArrow(run, "rep binary, other binary, jaccard double" if pairs else "rep binary, links long, root binary")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of edges (node, root)."""
    edges, path = stored(edges.where("node <> root").select(F.greatest("node", "root").alias("u"), F.least("node", "root").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
        seen = tuple(state)
        for large in (True, False):
            # Large star: a node's larger neighbours go to its least neighbour. Small star: its smaller ones and itself do.
            near = edges.union(edges.select("v", "u")).toDF("u", "v") if large else edges
            least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("m", "u").alias("m"))
            joined = near.join(least, F.col("u") == F.col("_u"))
            if large:
                edges = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:
                edges = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            edges = edges.where("u <> v").distinct()
        before = path
        edges, path = stored(edges, "edges")
        # Nothing reads the round before any more.
        forget(edges.sparkSession, [before])


def _prepared(docs: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    bands, width = bands_for(threshold, recall)
    signed = written(text_signatures(docs, n, bands, width), "signatures")
    classes, reps = text_classes(signed)
    reps = written(reps, "text-reps")
    needed = written(needs(candidate_units(reps)), "needed")
    return signed, classes, with_sets(docs, needed, reps, n)


def jaccard_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id_a, doc_id_b, jaccard: every link between two different texts, once, by their least doc_ids."""
    found = verified(_prepared(docs, n, threshold, recall)[2], threshold, True)
    return found.select(id_of("rep").alias("doc_id_a"), id_of("other").alias("doc_id_b"), "jaccard")


def _linked(docs: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """id, text_key for each row; _key, first, copies, links, class (the least node of its texts) for each text."""
    signed, classes, rows_ = _prepared(docs, n, threshold, recall)
    found = written(verified(rows_, threshold), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links")).select(F.col("rep").alias("_rep"), "links")
    parts = components(found.select(F.col("rep").alias("node"), "root")).select("node", F.col("root").alias("class"))
    named = classes.withColumn("rep", node_of(F.col("first"), F.col("text_key")))
    texts = named.join(links, F.col("rep") == F.col("_rep"), "left").join(parts, F.col("rep") == F.col("node"), "left")
    texts = written(texts.select(F.col("text_key").alias("_key"), "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class", "rep").alias("class")), "text-links")
    return signed.select("id", "text_key"), texts


def _by_text(signed: DataFrame, texts: DataFrame) -> DataFrame:
    """signed's rows with their text's columns. Texts with very many copies are broadcast, so that no task gets all rows of one text."""
    same = F.col("text_key") == F.col("_key")
    hot = texts.where(F.col("copies") >= HOT_COPIES)
    many = hot.count()
    if not 0 < many <= DROPPED_ROWS:
        return signed.join(texts, same)
    often = F.broadcast(hot)
    seldom = signed.join(F.broadcast(hot.select("_key")), same, "left_anti")
    return signed.join(often, same).unionByName(seldom.join(texts.where(F.col("copies") < HOT_COPIES), same))


def jaccard_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, text_id, n_copies, one row for each row of docs.

    class_id: the least doc_id of all documents that links or equal texts connect; n_links: other texts linked with this one; text_id:
    the least doc_id with the same text; n_copies: rows with the same text, this one included.
    """
    signed, texts = _linked(docs, n, threshold, recall)
    own = _by_text(signed, texts.withColumn("class_id", id_of("class")))
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return own.select(known("id").alias("doc_id"), "class_id", F.col("links").alias("n_links"), known("first").alias("text_id"), F.col("copies").alias("n_copies"))


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs without the documents that resemble one with a smaller doc_id, directly or by others; all columns stay.

    Of each group of texts that links connect, one row stays: the least doc_id's, of its texts the one with the least hash. Rows
    with different texts that aren't connected all stay, whatever their doc_ids.
    """
    signed, texts = _linked(docs, n, threshold, recall)
    own = node_of(F.col("id"), F.col("text_key"))
    classes = written(_by_text(signed, texts).select(own.alias("_node"), (own == F.col("class")).alias("_first")), "classes")
    gone, node = fresh(docs, "_dropped"), node_of(known_id(), key_of_text())
    dropped = written(classes.where("not _first").select(F.col("_node").alias(gone)).distinct(), "dropped")
    side = F.broadcast(dropped) if dropped.count() <= DROPPED_ROWS else dropped
    out = docs.join(side, node == F.col(gone), "left_anti")
    repeated = written(classes.where("_first").groupBy(F.col("_node").alias(gone)).count().where("count > 1").select(gone), "repeated")
    if repeated.isEmpty():
        return out
    # Of rows with one id and text, the one whose columns have the least hash: whatever the order, the same row stays.
    side = F.broadcast(repeated) if repeated.count() <= DROPPED_ROWS else repeated
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    chosen = out.join(side, node == F.col(gone)).groupBy(gone).agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row"))
    return out.join(side, node == F.col(gone), "left_anti").union(chosen.select("_row.*"))
