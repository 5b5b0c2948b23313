"""Best-fit packing of token pieces with swap-based local search (operator 9).

Documents become pieces of at most `capacity` tokens. Full pieces are sequences of their own. The others are packed by
their lengths alone: fewer than `capacity` lengths exist, however many pieces, so the counts by length are gathered,
and bins with equal contents are handled as one class with a multiplicity. Best fit decreasing makes the first
packing. Of very many pieces half are packed first and that packing is taken twice (`plan`). The local search then empties the emptiest bins: it moves a piece, or exchanges one or two pieces for one or two
of any other underfull bin, whatever fills that bin most. Each such step raises the sum of squared fills. Where none is left, an
equal exchange with a full bin swaps one or two pieces for more and smaller ones, which leaves the fills as they are and gives the next
step more to choose from. Squares rise, or stay while the underfull bins' pieces become more, so the search ends by
itself: when the lower bound ceil(total / capacity) is reached or no bin can be emptied any more.

A piece's place follows from its rank among the pieces of its length: its number in the task that cut it, plus the
counts of the tasks before. No sort and no window over pieces is needed, and a length held by a third of all pieces
isn't one task.

Null text is the empty text: one piece with the end id. An empty table gives no rows. Repeated rows are pieces
of their own. Extra columns are ignored. Very long texts are encoded in parts. The number of sequences doesn't depend on
the order of rows.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .encoding import encoder, with_end
from .frames import trim, written

#: Ranks of one length that share a row of the table of places.
BUCKET = 256
#: Rows of a small side (at most some 50 bytes each) up to which it is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 300_000
#: Pieces of a bin up to which choices of three of them are listed for equal exchanges.
TRIPLES = 12
#: Pieces beyond which a packing of half of them is taken twice.
WHOLE = 20_000
#: Choices of pieces at least from which those of classes without bins are taken out.
OFFERS = 4096

Bin = tuple[int, ...]


def piece_lengths(total: int, capacity: int) -> list[int]:
    """Cuts of a document of `total` tokens: whole if it fits, else the first piece takes the rest and the others are full."""
    first = total % capacity or min(total, capacity)
    return [first, *[capacity] * ((total - first) // capacity)]


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, own: the pieces of each document, the task that cut it, and its number among that task's pieces of its length.

    To be written before it is used: another run of a task may get its rows in another order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part_id, so_far = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, counts = with_end(*enc.encode_column(part.column(1)), end_id)
                many = -(-counts // capacity)
                first = counts - (many - 1) * capacity
                doc = np.repeat(np.arange(len(counts)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                length = np.where(piece == 0, first[doc], capacity)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                begin = (np.cumsum(counts) - counts)[doc] + start
                crc = [zlib.crc32(ids[a : a + n].astype("<u4")) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                found = np.bincount(length, minlength=capacity + 1)
                own = np.empty(len(doc), np.int64)
                own[order] = np.arange(len(doc)) - np.repeat(np.cumsum(found) - found, found) + so_far[length[order]]
                so_far += found
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part_id, np.int32)), pa.array(own)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "own"],
                )
            trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, own long")


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Counter:
    """Bins (falling lengths) with multiplicities. Equal bins are filled together: the longest pieces first, each into the fullest bins that hold it."""
    by_room: list[Counter] = [Counter() for _ in range(capacity + 1)]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        room = length
        while left and room <= capacity:
            if not by_room[room]:
                room += 1
                continue
            content, many = by_room[room].popitem()
            used = min(left, many)
            if many > used:
                by_room[room][content] += many - used
            by_room[room - length][(*content, length)] += used
            left -= used
            room = max(length, min(room, room - length)) if room - length >= length else room
        if left:
            each = capacity // length
            if left >= each:
                by_room[capacity - each * length][(length,) * each] += left // each
            if left % each:
                by_room[capacity - left % each * length][(length,) * (left % each)] += 1
    return sum(by_room, Counter())


def _without(content: Bin, *items: int) -> Bin:
    rest = list(content)
    for x in items:
        rest.remove(x)
    return tuple(rest)


def _with(content: Bin, *items: int) -> Bin:
    return tuple(sorted((*content, *items), reverse=True))


def choices(content: Bin) -> list[Bin]:
    """One or two pieces of a bin, each choice of lengths once."""
    return [(x,) for x in sorted(set(content))] + sorted(set(itertools.combinations(content, 2)))


class Search:
    """Classes of bins with equal contents, and arrays of what each underfull class could give: nothing, one piece or two."""

    def __init__(self, bins: Counter, capacity: int):
        self.capacity = capacity
        self.contents: list[Bin] = []
        self.number: dict[Bin, int] = {}
        self.many = np.zeros(1 << 10, np.int64)
        self.fill = np.zeros(1 << 10, np.int64)
        self.offers = np.zeros((3, 1 << 14), np.int64)  # class, sum of the pieces, the first of them
        # Rows of offers, those from which on rows of classes without bins are taken out, and the classes that have rows.
        self.offered, self.crowded, self.listed = 0, OFFERS, set()
        # Of each sum, the full classes with more than one piece of that sum, and these pieces.
        self.equal: dict[int, dict[int, Bin]] = {}
        self.bins = sum(bins.values())
        self.least = -(-sum(sum(c) * n for c, n in bins.items()) // capacity)
        self.heap: list[tuple[int, Bin]] = []
        for content, n in bins.items():
            self._change(content, n)

    def _change(self, content: Bin, n: int) -> None:
        """n more (or fewer) bins with this content."""
        if not content:
            return
        new = content not in self.number
        if new:
            k = self.number[content] = len(self.contents)
            self.contents.append(content)
            if k >= len(self.many):
                self.many, self.fill = np.append(self.many, np.zeros_like(self.many)), np.append(self.fill, np.zeros_like(self.fill))
            self.fill[k] = sum(content)
        k = self.number[content]
        underfull = self.fill[k] < self.capacity
        if underfull and n > 0 and k not in self.listed:
            self.listed.add(k)
            gifts = [(k, 0, 0), *((k, sum(c), c[0]) for c in choices(content))]
            while self.offered + len(gifts) > self.offers.shape[1]:
                self.offers = np.append(self.offers, np.zeros_like(self.offers), 1)
            self.offers[:, self.offered : self.offered + len(gifts)] = np.array(gifts).T
            self.offered += len(gifts)
        if not underfull and n > 0 and self.many[k] <= 0:
            for size in (2, 3) if len(content) <= TRIPLES else (2,):
                for pieces in set(itertools.combinations(content, size)) if len(content) > size else ():
                    self.equal.setdefault(sum(pieces), {})[k] = pieces
        if underfull and n > 0:
            heapq.heappush(self.heap, (int(self.fill[k]), content))
        self.many[k] += n
        if self.offered > self.crowded:
            self._compact()

    def _compact(self) -> None:
        """Takes out what classes without bins could give: else each step would look at all classes that there ever were."""
        rows = self.offers[:, : self.offered]
        rows = rows[:, self.many[rows[0]] > 0]
        self.offered, self.crowded = rows.shape[1], max(OFFERS, 2 * rows.shape[1])
        self.offers[:, : self.offered] = rows
        self.listed = set(rows[0].tolist())

    def improve(self, small: Bin) -> tuple[Bin, Bin, Bin] | None:
        """The exchange with another underfull bin that fills it most: its content, what it gets, what it gives."""
        k, fill = self.number[small], sum(small)
        owner, take, first = self.offers[:, : self.offered]
        alive = self.many[owner] > (owner == k)
        owner, take, first = owner[alive], take[alive], first[alive]
        room, least = self.capacity - self.fill[owner], np.maximum(0, fill - self.fill[owner])
        most, found = 0, None
        for give in sorted(choices(small), key=sum, reverse=True):
            if sum(give) <= most:
                break
            gain = sum(give) - take
            gain[(gain > room) | (gain <= least)] = 0
            j = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[j] > most:
                most, found = int(gain[j]), (self.contents[owner[j]], give, tuple(x for x in (int(first[j]), int(take[j] - first[j])) if x))
        return found

    def split(self, small: Bin) -> tuple[Bin, Bin, Bin] | None:
        """An equal exchange with a full bin that gives more pieces than it takes; those whose largest is least."""
        for give in sorted(choices(small), key=lambda c: (-len(c), -sum(c))):
            have, best = self.equal.get(sum(give), {}), None
            for k in [k for k in have if self.many[k] <= 0]:
                del have[k]
            for k, pieces in have.items():
                if len(pieces) > len(give) and (best is None or pieces[0] < best[1][0]):
                    best = (k, pieces)
            if best:
                return self.contents[best[0]], give, best[1]
        return None

    def run(self) -> Counter:
        stuck, emptied = [], False
        while self.bins > self.least:
            while self.heap and self.many[self.number[self.heap[0][1]]] <= 0:
                heapq.heappop(self.heap)
            if not self.heap:
                if not emptied:
                    break
                # What was stuck may move since other bins changed.
                self.heap, stuck, emptied = stuck, [], False
                heapq.heapify(self.heap)
                continue
            small = self.heap[0][1]
            step = self.improve(small) or self.split(small)
            if step is None:
                stuck.append(heapq.heappop(self.heap))
                continue
            other, give, take = step
            k, j = self.number[small], self.number[other]
            many = int(self.many[k]) // 2 if k == j else int(min(self.many[k], self.many[j]))
            rest = _with(_without(small, *give), *take)
            if not rest:
                self.bins, emptied = self.bins - many, True
            for content, n in ((small, -many), (other, -many), (rest, many), (_with(_without(other, *take), *give), many)):
                self._change(content, n)
        return Counter({c: int(self.many[k]) for c, k in self.number.items() if self.many[k] > 0})


def local_search(bins: Counter, capacity: int) -> Counter:
    """Bins after the search; changes are made to as many bins of both classes as the smaller class has."""
    return Search(bins, capacity).run()


def plan(counts: dict[int, int], capacity: int) -> Counter:
    """Bins of all pieces: beyond WHOLE of them, twice those of half of each length; bins that aren't full and odd pieces are packed anew.

    So a search begins with few bins that aren't full, and its steps grow with the logarithm of the numbers of pieces.
    """
    bins = best_fit_decreasing(counts, capacity)
    if sum(counts.values()) > WHOLE:
        full, rest = Counter(), Counter({length: n % 2 for length, n in counts.items() if n % 2})
        for content, n in plan({length: n // 2 for length, n in counts.items() if n > 1}, capacity).items():
            if sum(content) == capacity:
                full[content] = 2 * n
                continue
            for length in content:
                rest[length] += 2 * n
        bins = min(bins, full + best_fit_decreasing(rest, capacity), key=lambda b: sum(b.values()))
    return local_search(bins, capacity)


def places(bins: Counter) -> dict[str, np.ndarray]:
    """length, first, last, sequence, offset: pieces of that length with rank first to last are at that offset of sequence + rank - first."""
    rows: list[tuple] = []
    taken: Counter = Counter()
    sequence = 0
    for content, many in sorted(bins.items()):
        offset = 0
        for length in content:
            rows.append((length, taken[length], taken[length] + many - 1, sequence, offset))
            taken[length] += many
            offset += length
        sequence += many
    return dict(zip(("length", "first", "last", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """A written table of pieces (doc_id, piece, start, length, part, own, ...) with sequence_id and offset."""
    spark = pieces.sparkSession
    columns = [c for c in pieces.columns if c not in ("part", "own")]
    sizes = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    # At most capacity rows, whatever the input.
    counts = {int(r["length"]): int(r["n"]) for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    counts.pop(capacity, 0)
    found = places(plan(counts, capacity))
    before = (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("_before")  # a row for each task
    before = written(sizes.select(F.col("length").alias("_length"), F.col("part").alias("_part"), before), "pieces-before")
    # A row for each place, or for each BUCKET ranks of it: pieces find theirs by length and bucket.
    table = spark.createDataFrame(pa.table({f"_{k}": v for k, v in found.items()}), "_length long, _first long, _last long, _sequence long, _offset long")
    bucket = F.explode(F.sequence(F.floor(F.col("_first") / BUCKET), F.floor(F.col("_last") / BUCKET))).alias("_bucket")
    table = written(table.repartition(spark.sparkContext.defaultParallelism).select("*", bucket).withColumnRenamed("_length", "_l"), "places")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    ranked = pieces.join(small(before), (F.col("length") == F.col("_length")) & (F.col("part") == F.col("_part"))).withColumn("_rank", F.col("own") + F.col("_before"))
    at = (F.col("length") == F.col("_l")) & (F.floor(F.col("_rank") / BUCKET) == F.col("_bucket")) & F.col("_rank").between(F.col("_first"), F.col("_last"))
    whole = F.col("length") == capacity
    sequence = F.when(whole, F.col("_rank") + filled(found)).otherwise(F.col("_sequence") + F.col("_rank") - F.col("_first"))
    return ranked.join(small(table), at, "left").select(*columns, sequence.alias("sequence_id"), F.when(whole, 0).otherwise(F.col("_offset")).cast("long").alias("offset"))


def filled(found: dict[str, np.ndarray]) -> int:
    """Sequences that a table of places fills."""
    return int((found["sequence"] + found["last"] - found["first"]).max()) + 1 if len(found["length"]) else 0


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(written(cut_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
