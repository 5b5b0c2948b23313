"""GIF media columns: reading frames and storing 8-bit payloads (operator 2).

`each_frame` decodes any GIF87a or GIF89a: LZW code streams, global and local palettes, interlacing, transparency,
delays and the four disposal rules, clear codes at any time; frames come as they are shown, with the pixel indices that the file holds.
`frame_table` stores one row for each frame with its time and colour histogram. `payload_gif` writes bytes losslessly
as pixels, 64 to a row, with real LZW compression; a comment holds the unpadded length. The query stores GIFs, reads them into a
stored frame table, and takes payloads and features from that table.

Null or empty text is 64 zero bytes. Null or broken media, also with too few pixels, give no frames (`frame_table`); `payload` raises on them. Equal texts give
equal bytes. Payloads beyond 64 x 4096 samples take several frames, which are made and read one by one, so a very long text
takes the memory of its bytes. Repeated rows have frames of their own. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import rows, written

CLEAR, END = 256, 257
#: Bytes of pixels after which a batch of frames goes on.
FLUSH_BYTES = 4 << 20
#: Bytes of one media's pixels that are held until all its frames are read; beyond, it is read once more to see whether it's whole.
HOLD_BYTES = 64 << 20
WIDTH, FRAME_ROWS = 64, 4096
#: Bits of the k-th code after a clear code, for 8-bit samples: 9 until the table holds 512 entries, and so on up to 12.
_BITS = np.clip([(258 + max(k - 1, 0)).bit_length() for k in range(8192)], 9, 12)
_UPTO = np.concatenate([[0], np.cumsum(_BITS)])
_SINGLE = [bytes([i]) for i in range(256)]
#: The palette of payloads: three bits red, three green, two blue.
PALETTE = np.stack([(np.arange(256) >> 5) * 255 // 7, (np.arange(256) >> 2 & 7) * 255 // 7, (np.arange(256) & 3) * 85], 1).astype(np.uint8)


def lzw_codes(data: bytes) -> list[int]:
    """Codes for 8-bit samples: a clear code first and whenever the table is full."""
    out = [CLEAR]
    table: dict[int, int] = {}
    nxt, prefix = 258, -1
    find, put = table.get, out.append
    for b in data:
        if prefix < 0:
            prefix = b
            continue
        key = prefix << 8 | b
        if (code := find(key)) is not None:
            prefix = code
            continue
        put(prefix)
        if nxt < 4096:
            table[key] = nxt
            nxt += 1
        else:
            put(CLEAR)
            table.clear()
            nxt = 258
        prefix = b
    if prefix >= 0:
        put(prefix)
    put(END)
    return out


def code_stream(codes: list[int]) -> bytes:
    """Codes in as many bits as a decoder expects at each place, lowest bits first."""
    code = np.array(codes, np.int64)
    clears = np.flatnonzero(code == CLEAR)
    since = np.arange(len(code)) - np.repeat(clears, np.diff(np.append(clears, len(code)))) - 1
    since[clears[1:]] = np.diff(clears) - 1  # a clear code has the width that its place before it asks for
    bits = _BITS[np.maximum(since, 0)]
    ends = np.cumsum(bits)
    at = ends - bits
    value, byte = code << (at & 7), at >> 3
    size = int(ends[-1] + 7) // 8
    out = sum(np.bincount(byte + k, value >> 8 * k & 255, size + 3) for k in range(3))
    return out[:size].astype(np.uint8).tobytes()


def _codes(raw: np.ndarray, bit: int, least: int, many: int, full: bool) -> np.ndarray:
    """The next codes, as if no clear code were among them; full: of a table that was full before."""
    if full:
        ends = bit + 12 * np.arange(many + 1)
    elif least == 8:
        ends = bit + _UPTO[: many + 1]
    else:
        first = (1 << least) + 2
        ends = bit + np.concatenate([[0], np.cumsum(np.clip([(first + max(k - 1, 0)).bit_length() for k in range(many)], least + 1, 12))])
    ends = ends[: np.searchsorted(ends, 8 * (len(raw) - 3), "right")]
    at, width = ends[:-1], np.diff(ends)
    byte = at >> 3
    return (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (at & 7) & (1 << width) - 1


def lzw_bytes(stream: bytes, least: int, count: int) -> bytes:
    """`count` samples of a code stream. Codes are cut out with numpy up to the next clear code, then looked up in the growing table.

    A full table stays as it is until a clear code comes, however late. A stream that ends before `count` samples is an error.
    """
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    clear, end, out, bit, size = 1 << least, (1 << least) + 1, [], 0, 0
    base = [*_SINGLE[:clear], b"", b""]
    table, prev, full = base.copy(), b"", False
    while size < count:
        codes = _codes(raw, bit, least, min(8191, count - size + 3), full)
        if not len(codes):
            break
        stops = np.flatnonzero((codes == clear) | (codes == end))
        cut = int(stops[0]) if len(stops) else len(codes)
        for code in codes[:cut].tolist():
            if code < len(table):
                entry = table[code]
            elif prev:
                entry = prev + prev[:1]
            else:
                raise ValueError("broken LZW stream")
            if prev and len(table) < 4096:
                table.append(prev + entry[:1])
            out.append(entry)
            size += len(entry)
            prev = entry
        if len(stops) and codes[cut] == end:
            break
        many = cut + 1 if len(stops) else cut
        if full:
            bit += 12 * many
        else:
            bit += int(_UPTO[many]) if least == 8 else int(np.clip([((1 << least) + 2 + max(k - 1, 0)).bit_length() for k in range(many)], least + 1, 12).sum())
        if len(stops):
            table, prev, full = base.copy(), b"", False
        else:
            full = True
    if size < count:
        raise ValueError("an LZW stream that ends short")
    return b"".join(out)[:count]


@dataclass
class Frame:
    """A frame as shown. indices: pixel indices as stored, row by row; rgba: the whole canvas after drawing."""

    number: int
    left: int
    top: int
    width: int
    height: int
    start_ms: int
    delay_ms: int
    disposal: int
    transparent: int | None
    indices: bytes
    rgba: np.ndarray

    def histogram(self) -> list[int]:
        """Counts of the visible pixels' colours in 64 bins, two bits for each of red, green and blue."""
        seen = self.rgba.reshape(-1, 4)
        seen = seen[seen[:, 3] > 0] >> 6
        return np.bincount(seen[:, 0].astype(np.int64) << 4 | seen[:, 1] << 2 | seen[:, 2], minlength=64).tolist()


def _blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    """Data of a chain of sub-blocks and the place after it."""
    parts = []
    while size := raw[at]:
        parts.append(raw[at + 1 : at + 1 + size])
        at += 1 + size
    return b"".join(parts), at + 1


def _rows_in_order(height: int) -> np.ndarray:
    return np.concatenate([np.arange(a, height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def read_gif(raw: bytes) -> tuple[list[Frame], list[bytes]]:
    """Frames and comments."""
    comments: list[bytes] = []
    return list(each_frame(raw, comments)), comments


def each_frame(raw: bytes, comments: list[bytes]) -> Iterator[Frame]:
    """Frames one after the other; comments are added to a list as they are met."""
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background = struct.unpack_from("<HHBB", raw, 6)
    at, table = 13, None
    if flags & 128:
        table = np.frombuffer(raw, np.uint8, 3 << (flags & 7) + 1, at).reshape(-1, 3)
        at += table.size
    canvas = np.zeros((height, width, 4), np.uint8)
    number, delay, disposal, clear_index, now = 0, 0, 0, None, 0
    while at < len(raw) and raw[at] != 0x3B:
        if raw[at] == 0x21:
            label = raw[at + 1]
            data, at = _blocks(raw, at + 2)
            if label == 0xF9 and len(data) >= 4:
                disposal, delay = data[0] >> 2 & 7, 10 * (data[1] | data[2] << 8)
                clear_index = data[3] if data[0] & 1 else None
            elif label == 0xFE:
                comments.append(data)
            continue
        if raw[at] != 0x2C:
            raise ValueError("broken GIF")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", raw, at + 1)
        at += 10
        palette = table
        if flags & 128:
            palette = np.frombuffer(raw, np.uint8, 3 << (flags & 7) + 1, at).reshape(-1, 3)
            at += palette.size
        if palette is None:
            raise ValueError("a frame without palette")
        least = raw[at]
        stream, at = _blocks(raw, at + 1)
        pixels = np.frombuffer(lzw_bytes(stream, least, w * h), np.uint8).reshape(h, w)
        if flags & 64:
            ordered = np.empty_like(pixels)
            ordered[_rows_in_order(h)] = pixels
            pixels = ordered
        before = canvas.copy() if disposal == 3 else None
        y, x = min(h, height - top), min(w, width - left)
        part, drawn = canvas[top : top + y, left : left + x], pixels[:y, :x]
        colour = np.concatenate([palette, np.full((len(palette), 1), 255, np.uint8)], 1)
        colour = np.concatenate([colour, np.zeros((256 - len(colour), 4), np.uint8)]) if len(colour) < 256 else colour
        seen = slice(None) if clear_index is None else drawn != clear_index
        part[seen] = colour[drawn[seen]]
        yield Frame(number, left, top, w, h, now, delay, disposal, clear_index, pixels.tobytes(), canvas.copy())
        number += 1
        if disposal == 2:
            part[:] = 0
        elif disposal == 3:
            canvas = before
        now, delay, disposal, clear_index = now + delay, 0, 0, None


def _chain(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of 64, and its length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), len(raw)


def payload_gif(data: bytes, length: int) -> bytes:
    """data (a multiple of 64 bytes) as pixels; frames of up to 4096 rows, a tenth of a second each."""
    height = len(data) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(height, FRAME_ROWS), 0xF7, 0, 0), PALETTE.tobytes(), b"\x21\xfe", _chain(b"%d" % length)]
    for row in range(0, height, FRAME_ROWS):
        part = data[row * WIDTH : (row + FRAME_ROWS) * WIDTH]
        out += [b"\x21\xf9\x04\x04", struct.pack("<HB", 10, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", _chain(code_stream(lzw_codes(part)))]
    return b"".join([*out, b"\x3b"])


def payload(media: bytes) -> tuple[bytes, int, list[Frame]]:
    """The padded bytes that a payload GIF holds, their unpadded length, and its frames."""
    frames, comments = read_gif(media)
    return b"".join(f.indices for f in frames), int(comments[0]), frames


def store(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, media: each text's GIF, written to a table and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text, row in rows(batches, 64):
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(doc_id, pa.int64()), pa.array([payload_gif(*padded(t)) for t in text], pa.binary())], ["row", "doc_id", "media"])

    numbered = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row"))
    return written(numbered.mapInArrow(run, "row long, doc_id long, media binary"), "gif")


_CELLS = ("frame", "start_ms", "delay_ms", "disposal", "transparent", "left", "top", "width", "height")
_CELL_TYPES = [(n, pa.int32()) for n in _CELLS] + [("last", pa.bool_()), ("histogram", pa.list_(pa.int32())), ("pixels", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("comment", pa.binary())]


def frame_table(media: DataFrame, keys: tuple[str, ...] = ("doc_id",), stored: bool = False) -> DataFrame:
    """keys, then frame, start_ms, delay_ms, disposal, transparent, left, top, width, height, last, histogram, pixels, media_bytes, media_sha256, comment: one row for each frame.

    last: whether it's the last one of its media. histogram: of the canvas as shown, in 64 colours. pixels: the canvas in RGBA; stored: the frame's
    indices as stored. comment: all comments before the first frame. Media that is null or no readable GIF has no rows.
    """
    schema = ", ".join(f"{k} long" for k in keys) + ", " + ", ".join(f"{n} int" for n in _CELLS) + ", last boolean, histogram array<int>, pixels binary, media_bytes long, media_sha256 string, comment binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            kinds = [(k, pa.int64()) for k in keys] + _CELL_TYPES
            return pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], kind) for i, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])

        for *ids, found in rows(batches, 16):
            for key, raw in zip(zip(*ids, strict=True), found, strict=True):
                for cells in frame_cells(raw, stored):
                    held.append((*key, *cells))
                    size += len(cells[11])
                    if size > FLUSH_BYTES:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()

    return media.select(*[F.col(k).cast("long").alias(k) for k in keys], "media").mapInArrow(run, schema)


def frame_cells(raw: bytes | None, stored: bool) -> Iterator[tuple]:
    """The cells of each frame of some media; none at all of broken media."""
    held, size, whole = [], 0, False
    try:
        for cells in _cells(raw or b"", stored):
            held.append(cells)
            size += len(cells[11])
            if size > HOLD_BYTES and not whole:
                for _ in each_frame(raw, []):  # raises on broken media
                    pass
                whole = True
            if whole:
                yield from held
                held = []
    except (ValueError, IndexError, struct.error):
        return
    yield from held


def _cells(raw: bytes, stored: bool) -> Iterator[tuple]:
    comments: list[bytes] = []
    held: Frame | None = None
    about = (len(raw), hashlib.sha256(raw).hexdigest())

    def cells(f: Frame, last: bool) -> tuple:
        return (f.number, f.start_ms, f.delay_ms, f.disposal, f.transparent, f.left, f.top, f.width, f.height, last, f.histogram(), f.indices if stored else f.rgba.tobytes(), *about, b"".join(comments))

    for frame in each_frame(raw, comments):
        if held is not None:
            yield cells(held, False)
        held = frame
    if held is not None:
        yield cells(held, True)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature: from the stored frames of the stored media.

    feature: frames, milliseconds, and the colour histogram summed over frames.
    """
    frames = written(frame_table(store(docs), ("row", "doc_id"), True), "gif-frames", level=9)
    names = ["doc_id", "frame", "last", "delay_ms", "histogram", "pixels", "media_bytes", "media_sha256", "comment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in rows(batches, 256):
            out = []
            for doc_id, frame, last, delay, histogram, pixels, media_bytes, media_sum, comment in zip(*parts, strict=True):
                if frame == 0:
                    sum_, size, ms, colours = hashlib.sha256(), 0, 0, np.zeros(64, np.int64)
                sum_.update(pixels)
                size, ms, colours = size + len(pixels), ms + delay, colours + histogram
                if last:
                    feature = f"frames={frame + 1};ms={ms};colours=" + ",".join(f"{i}:{colours[i]}" for i in np.flatnonzero(colours).tolist())
                    out.append((doc_id, int(comment), size, sum_.hexdigest(), zlib.crc32(pixels[-64:]), media_bytes, media_sum, feature))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    # Only documents of several frames are shuffled, to have these together and in order.
    alone = (F.col("frame") == 0) & F.col("last")
    several = frames.where(~alone).repartition("row").sortWithinPartitions("row", "frame")
    return frames.where(alone).select(*names).mapInArrow(run, schema).union(several.select(*names).mapInArrow(run, schema))
