"""Token files with frequency-ranked ids, byte-aligned lengths in separate control bytes, numpy decoding (operator 3).

An id is replaced by its rank in the corpus (0: the most frequent), so frequent ids take one byte. A control byte
holds four 2-bit lengths (1 to 4 data bytes); data bytes follow in little-endian order. A shard is one byte string
with header, rank table (the id of each rank that the shard may hold, in the same coding), document index, control bytes and data
bytes: it's read without anything else. Each shard is a file, which its task writes under another name and moves; where workers can't
reach the file system, shards are rows of a Parquet table.

Documents go in ascending doc_id order (null first; rows of one doc_id by a checksum of their ids). Null text is the empty
text: one end id. An empty table gives no shard and no row. Extra columns are ignored. A very long text is a shard of its own,
coded and decoded in parts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .encoding import encoder, with_end
from .frames import rows, temporary, trim, written

MAGIC = b"FRVB"
HEAD = struct.Struct("<4sIIQQ")
#: Values coded or decoded at once.
PART = 1 << 18
#: Tokens after which a shard is closed; a longer document is a shard of its own.
SHARD_TOKENS = 1 << 20
#: Tokens that a range of doc_ids should hold.
RANGE_TOKENS = 1 << 24
#: File systems that workers use by themselves, and tasks that read files at most.
SYSTEMS, FILE_TASKS = ("file", "hdfs", "s3", "gs", "abfs", "abfss"), 1 << 14

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_TOTALS = _LENGTHS.sum(1)
_STARTS = np.cumsum(_LENGTHS, 1) - _LENGTHS
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    control, data = [], []
    for at in range(0, len(values), PART):
        part = np.ascontiguousarray(values[at : at + PART], "<u4")
        length = 1 + (part > 0xFF).astype(np.uint8) + (part > 0xFFFF) + (part > 0xFFFFFF)
        codes = np.zeros(-(-len(part) // 4) * 4, np.uint8)
        codes[: len(part)] = length - 1
        control.append((codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8).tobytes())
        data.append(part.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]].tobytes())
    return b"".join(control), b"".join(data)


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values again: each control byte is looked up for the four lengths and places, then bytes are gathered."""
    ctl, raw, at = np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), 0
    out = np.empty(count, np.uint32)
    for begin in range(0, count, PART):
        part = ctl[begin // 4 : (begin + PART) // 4]
        many = min(PART, count - begin)
        total = _TOTALS[part]
        ends = np.cumsum(total)
        place = ((ends - total)[:, None] + _STARTS[part]).ravel()[:many]
        length = _LENGTHS[part].ravel()[:many]
        # The last control byte may speak of values beyond count, which have no data.
        here = np.append(raw[at : at + int(ends[-1])], np.zeros(8, np.uint8)).astype(np.uint32)
        value = here[place] | here[place + 1] << 8
        wide = np.flatnonzero(length > 2)
        value[wide] |= here[place[wide] + 2] << 16 | here[place[wide] + 3] << 24
        out[begin : begin + many] = value & _MASKS[length]
        at += int(place[-1] + length[-1])
    return out


def shard_bytes(doc_ids: list[int | None], counts: list[int], ranks: np.ndarray, id_of_rank: np.ndarray) -> bytes:
    """A shard. id_of_rank: ids by rank, of all ranks up to the greatest that the shard holds."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    table = b"".join(pack(id_of_rank[: int(ranks.max()) + 1 if len(ranks) else 0]))
    control, data = pack(ranks)
    head = HEAD.pack(MAGIC, int(ranks.max()) + 1 if len(ranks) else 0, len(table), len(doc_ids), len(ranks))
    return b"".join([head, table, known.tobytes(), ids.tobytes(), np.array(counts, "<u8").tobytes(), control, data])


def read_shard(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, token counts and ids of a shard."""
    magic, known_ranks, table_size, docs, tokens = HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at, split = HEAD.size, HEAD.size + -(-known_ranks // 4)
    id_of_rank = unpack(blob[at:split], blob[split : at + table_size], known_ranks)
    at += table_size
    known = np.frombuffer(blob, np.uint8, docs, at)
    ids = np.frombuffer(blob, "<i8", docs, at + docs)
    counts = np.frombuffer(blob, "<u8", docs, at + 9 * docs).astype(np.int64)
    at += 17 * docs
    split, view = at + -(-tokens // 4), memoryview(blob)
    ranks = unpack(view[at:split], view[split:], tokens)
    return [int(i) if k else None for i, k in zip(ids, known, strict=True)], counts, id_of_rank[ranks]


def token_count(blob: bytes) -> int:
    return HEAD.unpack_from(blob)[4]


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, ids (bytes of unsigned 16- or 32-bit ids, end id included), tie (their checksum), one row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, counts = with_end(*enc.encode_column(part.column(1)), end_id)
                ends = pa.py_buffer(np.append(0, np.cumsum(counts) * enc.dtype.itemsize))
                raw = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, ends, pa.py_buffer(ids)])
                sums = pa.array([zlib.crc32(x.as_buffer()) for x in raw], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), raw.cast(pa.binary()), sums], ["doc_id", "n_tokens", "ids", "tie"])
            trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, tie long")


def id_type(tokenizer: str) -> str:
    """The NumPy type of a tokenizer's ids, so that workers that only handle ids don't load it."""
    return encoder(tokenizer).dtype.str


def id_ranks(tokens: DataFrame, dtype: str) -> DataFrame:
    """id, n, rank: ids by falling count over all documents, then by id. At most as many rows as the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for (ids,) in rows(batches):
            seen = np.bincount(np.frombuffer(b"".join(ids), dtype))
            if len(seen) > len(total):
                seen, total = total, seen
            total[: len(seen)] += seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # A window over the vocabulary: a bound that doesn't grow with the corpus.
    return counts.select("id", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).cast("long").alias("rank"))


def streamed(spark: SparkSession, path: str) -> bool:
    """Whether workers read and write files there by themselves."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() in SYSTEMS


def put_file(folder: str, part: int, seq: int, content: bytes) -> str:
    """Writes a shard's file PART-SEQ.frvb under another name and moves it: a task that is lost and run again leaves whole files only."""
    import uuid

    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    name, hidden = f"{root}/{part:06d}-{seq:06d}.frvb", f"{root}/.{uuid.uuid4().hex}"
    with system.open_output_stream(hidden) as out:
        out.write(content)
    system.move(hidden, name)
    return name


def get_file(folder: str, part: int, seq: int) -> bytes:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{root}/{part:06d}-{seq:06d}.frvb") as stream:
        return stream.read()


def write_shards(tokens: DataFrame, ranks: DataFrame, dtype: str, folder: str | None = None) -> DataFrame:
    """part, seq, n_docs, n_tokens, blob: shards in ascending doc_id order (by part, then seq), written and read back.

    With a folder (URI) that workers reach, each shard is a file in it and blob is null.
    """
    spark = tokens.sparkSession
    table = ranks.select("id", "rank").toArrow()  # at most the vocabulary
    ids, order = table["id"].to_numpy(), table["rank"].to_numpy()
    to_rank, to_id = np.zeros(max([0, *ids.tolist()]) + 1, "<u4"), np.zeros(len(ids), "<u4")
    to_rank[ids], to_id[order] = order, ids
    shared = spark.sparkContext.broadcast((to_rank, to_id))
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // RANGE_TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (lookup, names), part = shared.value, TaskContext.get().partitionId()
        doc_ids, counts, held, seq, size = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype)
            blob = shard_bytes(doc_ids, counts, lookup[ids], names)
            if folder:
                put_file(folder, part, seq, blob)
                blob = None
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([len(doc_ids)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())], ["part", "seq", "n_docs", "n_tokens", "blob"])

        for ds, ns, xs in rows(batches, 64):
            for d, n, x in zip(ds, ns, xs, strict=True):
                if doc_ids and size + n > SHARD_TOKENS:
                    yield close()
                    doc_ids, counts, held, seq, size = [], [], [], seq + 1, 0
                doc_ids.append(d), counts.append(n), held.append(x)
                size += n
        if doc_ids:
            yield close()

    # Rows of one doc_id, or of none, are dealt by their ids' checksum, equal rows by where they come from: no key is one task.
    spread = tokens.withColumn("_row", F.monotonically_increasing_id())
    ordered = spread.repartitionByRange(parts, "doc_id", "tie", "_row").sortWithinPartitions("doc_id", "tie", "_row")
    return written(ordered.select("doc_id", "n_tokens", "ids").mapInArrow(run, "part long, seq long, n_docs long, n_tokens long, blob binary"), "token-shards")


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, seq, start: ids in all shards before, from a row for each shard."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = totals.select(F.col("part").alias("_part"), (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))  # a row for each range of doc_ids
    within = Window.partitionBy("part").orderBy("seq")
    starts = shards.select("part", "seq", (F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("_within"))
    # Written, so that the planner knows its size: a small one is broadcast and the blobs aren't shuffled.
    return written(starts.join(before, F.col("part") == F.col("_part")).select("part", "seq", (F.col("_before") + F.col("_within")).alias("start")), "token-starts")


def read_documents(shards: DataFrame, sums: bool = False, folder: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (bytes of unsigned 32-bit ids) or with sums ids_crc32 (their CRC-32), shard: each document from its shard's bytes, or its file in folder."""
    name, kind = ("ids_crc32", "long") if sums else ("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, seq, start, blob in rows(batches, 1):
            doc_ids, counts, ids = read_shard(get_file(folder, part[0], seq[0]) if blob[0] is None else blob[0])
            ends, raw = np.cumsum(counts), memoryview(ids.astype("<u4", copy=False)).cast("B")
            begins, at = ends - counts, 0
            while at < len(doc_ids):
                to = max(at + 1, min(at + 512, int(np.searchsorted(ends, begins[at] + PART, "right"))))
                sl, at = slice(at, to), to
                found = [raw[4 * b : 4 * e] for b, e in zip(begins[sl].tolist(), ends[sl].tolist(), strict=True)]
                found = pa.array(map(zlib.crc32, found), pa.int64()) if sums else pa.array(found, pa.binary())
                cells = [pa.array(doc_ids[sl], pa.int64()), pa.array(begins[sl] + start[0]), pa.array(counts[sl]), found, pa.array([f"{part[0]:06d}-{seq[0]:06d}"] * (sl.stop - sl.start))]
                yield pa.RecordBatch.from_arrays(cells, ["doc_id", "start", "n_tokens", name, "shard"])
            trim()

    whole = shards.select("part", "seq", "blob").join(shard_starts(shards), ["part", "seq"]).select("part", "seq", "start", "blob")
    if folder:  # rows are short now, their files aren't: one for each task, or so
        whole = whole.repartition(max(1, min(FILE_TASKS, shards.count())), "part", "seq")
    return whole.mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} {kind}, shard string")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """The written shards, with a folder as files in it."""
    tokens = written(encode_documents(docs, tokenizer, end_id), "token-ids")
    ranks = written(id_ranks(tokens, id_type(tokenizer)), "token-ranks")
    return write_shards(tokens, ranks, id_type(tokenizer), folder)


def write_files(shards: DataFrame, folder: str) -> DataFrame:
    """part, seq, path: a file PART-SEQ.frvb of each shard, below a folder (URI) of a file system that pyarrow knows and all workers reach.

    A file is written under another name and then moved, so a task that is lost and run again leaves whole files only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, seq, blob in rows(batches, 1):
            name = put_file(folder, part[0], seq[0], blob[0])
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(seq, pa.int64()), pa.array([name])], ["part", "seq", "path"])

    return shards.select("part", "seq", "blob").mapInArrow(run, "part long, seq long, path string")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """part, seq, n_tokens, blob: the shards in a folder of such files, as `read_documents` takes them."""
    name = F.regexp_extract("path", r"(\d+)-(\d+)\.frvb$", 1), F.regexp_extract("path", r"(\d+)-(\d+)\.frvb$", 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, seq, blob in rows(batches, 1):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(seq, pa.int64()), pa.array([token_count(blob[0])], pa.int64()), pa.array(blob, pa.binary())], ["part", "seq", "n_tokens", "blob"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.frvb").load(folder)
    return found.select(name[0].cast("long").alias("part"), name[1].cast("long").alias("seq"), "content").mapInArrow(run, "part long, seq long, n_tokens long, blob binary")


def digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard: from files, which workers write where they can; else a shard is a cell of a Parquet table."""
    folder = temporary(docs.sparkSession, "token-files")
    folder = folder if streamed(docs.sparkSession, folder) else None
    return read_documents(token_files(docs, tokenizer, end_id, folder), True, folder)
