"""Quality classifier: a factorisation machine (operator 1).

Features are hashed words, statistics of a text's structure and its recorded length (n_chars). The score is
sigmoid(b + <w, x> + sum of all pairwise terms <v_i, v_j> x_i x_j), where the pairwise sum is taken in linear time
as half of (sum v_i x_i)^2 - sum (v_i x_i)^2, by factor.

It is fitted on at most `sample` labelled rows (those with the least hash of doc_id), in one task that gets feature
arrays; only the model leaves it. Rows whose crc32(doc_id as text) mod 4 is 2 are never learned from. Labels, lang,
source and doc_id are no inputs of a score.

Null text is the empty text; null n_chars is a missing value. Without labelled rows the prior stands alone (score
0.9). Labels without a quality, or for no document, are left out; of repeated ones the least counts. Every row of docs gets a row, an empty table gives none. Equal texts with equal n_chars have equal scores. Extra
columns are ignored. Very long texts are cut and counted in parts.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import extended, fresh, hashed_words, rows, trim, written

#: Labelled rows that are learned from at most.
SAMPLE = 20_000
BUCKETS = 1 << 15
FACTORS = 8
BINS = 8
EPOCHS = 8
CUT = 0.7
#: Words whose hashes a worker remembers.
WORD_MEMO = 120_000

#: Byte classes: 0 other ASCII, 1 lower case, 2 upper case, 3 digits, 4 blanks, 5 line ends, 6 . , ; :, 7 ! ?, 8 quotes and brackets, 9 bars and slashes, 10 marks, 11 beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b" \t"), (5, b"\r\n"), (6, b".,;:"), (7, b"!?"), (8, b"\"'()[]{}<>"), (9, b"|/\\_"), (10, b"#$%&*+=@^~"), (11, bytes(range(128, 256)))):
    _CLASS[[*_chars]] = _k
_CLASSES = 12

_buckets: dict[str, int] = {}


def _word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & 0x7FFFFFFFFFFF


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def features(texts: list[str | None], lengths: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets and weights of all texts, one after the other, how many each text has, and the statistics (texts x some).

    A text's weights have length 1.
    """
    texts = [t or "" for t in texts]
    n = len(texts)
    words, count = hashed_words(texts, _buckets, WORD_MEMO, _word_hash)
    words = words.astype(np.int64)
    owner = np.repeat(np.arange(n), count)
    keys, times = _distinct(owner * BUCKETS + words % BUCKETS)
    text, bucket = keys // BUCKETS, keys % BUCKETS
    weight = np.log1p(times)
    norm = np.sqrt(np.bincount(text, weight * weight, n))
    weight = weight / np.maximum(norm, 1e-12)[text]
    sizes = np.bincount(text, minlength=n)
    # Structure.
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    nbytes = np.array([len(c) for c in coded], np.int64)
    shares = np.zeros((n, _CLASSES), np.int64)
    for i, c in enumerate(coded):
        raw = np.frombuffer(c, np.uint8)
        for at in range(0, len(raw), 1 << 20):
            shares[i] += np.bincount(_CLASS[raw[at : at + (1 << 20)]], minlength=_CLASSES)
    total, tokens = np.maximum(nbytes, 1), np.maximum(count, 1)
    most = np.zeros(n)
    np.maximum.at(most, text, times)
    triple_share = np.ones(n)
    if len(words) > 2:
        grams = words[:-2] * 31 + words[1:-1] * 1009 + words[2:] * 65537
        same = owner[:-2] == owner[2:]
        at = owner[:-2][same]
        order = np.lexsort((grams[same], at))
        g, a = grams[same][order], at[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (a[1:] != a[:-1])
        distinct = np.bincount(a[new], minlength=n)
        full = np.bincount(at, minlength=n)
        triple_share = np.where(full > 0, distinct / np.maximum(full, 1), 1.0)
    lines = [t.split("\n") for t in texts]
    line_share = np.array([len(set(x)) / len(x) for x in lines])
    stop_share = np.array([sum(x[-1:] in ".!?" for x in ls if x) / len(ls) for ls in lines])
    known = np.array([x is not None for x in lengths])
    chars = np.array([x or 0 for x in lengths], np.float64)
    stats = np.column_stack(
        [
            shares / total[:, None], np.log1p(nbytes), np.log1p(count), nbytes / tokens, sizes / tokens, most / tokens, triple_share,
            line_share, stop_share, np.log1p([len(x) for x in lines]), count / np.array([len(x) for x in lines]), np.log1p(np.maximum(chars, 0)), known,
        ]
    )
    return bucket, weight, sizes, stats


class Machine:
    """A fitted factorisation machine over word buckets, standardised statistics and their quantile bins."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, edges: np.ndarray, bias: float, weights: np.ndarray):
        self.mean, self.scale, self.edges, self.bias, self.weights = mean, scale, edges, bias, weights

    @staticmethod
    def size(stats: int) -> int:
        return BUCKETS + stats * (BINS + 1)

    def inputs(self, bucket: np.ndarray, weight: np.ndarray, sizes: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All features: indices, values, owners."""
        n, m = stats.shape
        value = np.clip((stats - self.mean) / self.scale, -4, 4) / math.sqrt(m)
        bins = (stats[:, :, None] > self.edges[None]).sum(2)
        column = np.arange(m)
        rows_ = np.repeat(np.arange(n), m)
        index = np.concatenate([bucket, np.tile(BUCKETS + column, n), (BUCKETS + m + column * BINS + bins).ravel()])
        values = np.concatenate([weight, value.ravel(), np.full(n * m, 1 / math.sqrt(m))])
        return index, values, np.concatenate([np.repeat(np.arange(n), sizes), rows_, rows_])

    def raw(self, index: np.ndarray, value: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of n rows, and the sums of v x by row and factor."""
        part = self.weights[index] * value[:, None]
        order = np.argsort(owner, kind="stable")
        part, own = part[order], owner[order]
        starts = np.searchsorted(own, np.arange(n))
        sums = np.add.reduceat(part, starts, 0)  # every row has statistics, so no row is empty
        squares = np.add.reduceat(part[:, 1:] ** 2, starts, 0)
        return self.bias + sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - squares).sum(1), sums[:, 1:]

    def score(self, texts: list[str | None], lengths: list[int | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        logit, _ = self.raw(*self.inputs(*features(texts, lengths)), len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, mean=self.mean, scale=self.scale, edges=self.edges, bias=self.bias, weights=self.weights.astype(np.float32))
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Machine:
        with np.load(io.BytesIO(raw), allow_pickle=False) as z:
            return cls(z["mean"], z["scale"], z["edges"], float(z["bias"]), z["weights"].astype(np.float64))


def fit(bucket: np.ndarray, weight: np.ndarray, sizes: np.ndarray, stats: np.ndarray, labels: np.ndarray, seed: int = 17) -> Machine:
    """Adam on the logistic loss with L2 penalty, in batches; deterministic. Inputs are made for a batch at a time."""
    n, m = stats.shape
    quantiles = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T if n else np.zeros((m, BINS - 1))
    mean = stats.mean(0) if n else np.zeros(m)
    scale = np.maximum(stats.std(0), 1e-6) if n else np.ones(m)
    rng = np.random.default_rng(seed)
    weights = np.zeros((Machine.size(m), FACTORS + 1))
    weights[:, 1:] = rng.normal(0, 0.05, (len(weights), FACTORS))
    prior = (labels.sum() + 9) / (n + 10)
    model = Machine(mean, scale, quantiles, float(np.log(prior / (1 - prior))), weights)
    if not n:
        weights[:] = 0
        return model
    starts = np.cumsum(sizes) - sizes
    first, second, bias_first, bias_second, step = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0, 0
    batch = 256
    for epoch in range(EPOCHS):
        rate = 0.02 * (1 - epoch / EPOCHS)
        shuffled = rng.permutation(n)
        for at in range(0, n, batch):
            own = shuffled[at : at + batch]
            length = sizes[own]
            take = np.repeat(starts[own] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            i, x, o = model.inputs(bucket[take].astype(np.int64), weight[take].astype(np.float64), length, stats[own])
            logit, sums = model.raw(i, x, o, len(own))
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[own]) / len(own)
            e = error[o]
            grad = np.empty_like(weights)
            grad[:, 0] = np.bincount(i, e * x, len(weights))
            for k in range(FACTORS):
                grad[:, k + 1] = np.bincount(i, e * x * (sums[o, k] - weights[i, k + 1] * x), len(weights))
            grad += 1e-6 * weights
            step += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad * grad
            weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            g = error.sum()
            bias_first, bias_second = 0.9 * bias_first + 0.1 * g, 0.999 * bias_second + 0.001 * g * g
            model.bias -= rate * (bias_first / (1 - 0.9**step)) / (math.sqrt(bias_second / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text mod 4 is 2; false where doc_id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _length(docs: DataFrame) -> Column:
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("long").alias("n_chars")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes:
    """A model from labelled rows outside the held-out part."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(F.col("quality").cast("int")).alias("_quality"))
    known = written(known.withColumn("_hash", F.xxhash64("_id")), "known-labels")
    # Only a few more than `sample` rows, by their hashes, go to the one task that orders them.
    share = (sample + 10 * math.sqrt(sample) + 100) / max(1, known.count())
    few = known if share >= 1 else known.where(F.col("_hash") < int(-(2**63) + share * 2**64))
    # At most `sample` rows, whatever the input: a broadcast of a fixed size.
    chosen = written(few.orderBy("_hash", "_id").limit(sample).select("_id", "_quality"), "labelled")
    rows_ = docs.select("doc_id", "text", _length(docs)).join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("_id")).select("_id", "text", "n_chars", "_quality")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, lengths, labels_ in rows(batches, 256):
            bucket, weight, sizes, stats = features(texts, lengths)
            ends = np.cumsum(sizes)
            cut = [(b, e) for b, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            columns = [pa.array(ids, pa.int64()), pa.array(labels_, pa.int32()), *(pa.array(x, pa.binary()) for x in ([bucket[b:e].astype("<u2").tobytes() for b, e in cut], [weight[b:e].astype("<f4").tobytes() for b, e in cut], [s.tobytes() for s in stats]))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "bucket", "weight", "stats"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple] = {}
        for part in rows(batches):
            for i, *rest in zip(*part, strict=True):
                seen[i] = min(seen.get(i, tuple(rest)), tuple(rest))  # repeated ids count once, and the order of rows doesn't count
        got = [seen[i] for i in sorted(seen)]
        array = lambda k, kind: np.frombuffer(b"".join(g[k] for g in got), kind)
        stats = array(3, np.float64).reshape(len(got), -1) if got else np.zeros((0, features([""], [None])[3].shape[1]))
        model = fit(array(1, "<u2"), array(2, "<f4"), np.array([len(g[1]) // 2 for g in got], np.int64), stats, np.array([g[0] for g in got], np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([model.dump()], pa.binary())], ["model"])

    found = written(rows_.mapInArrow(extract, "id long, label int, bucket binary, weight binary, stats binary"), "labelled-features")
    return written(found.coalesce(1).mapInArrow(learn, "model binary"), "model").first()[0]


def scored(docs: DataFrame, model: bytes, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with a score and a prediction, which replace columns of these names."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # some 1 MB, by the numbers of buckets and factors
    keep = docs.drop(score, predicted)
    columns = keep.columns
    schema = extended(keep.schema, **{score: T.DoubleType(), predicted: T.IntegerType()})
    text, length = (fresh(keep, n) for n in ("_text", "_length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine.load(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = machine.score(part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(found), pa.array((found >= CUT).astype(np.int32))], names=[*columns, score, predicted])
            trim()

    return docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias(text), _length(docs).alias(length)).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels, sample)
    names = ["doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else [])]
    return scored(docs.select(*names), model).select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs whose score is at least CUT, with all their columns."""
    columns, score, predicted = docs.columns, fresh(docs, "_score"), fresh(docs, "_predicted")
    out = scored(docs, train(docs, labels, sample), score, predicted)
    return out.where(F.col(predicted) == 1).select(*[F.col(f"`{c}`") for c in columns])
