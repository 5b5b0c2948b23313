"""The quality machine and the pipeline against versions written without the operators' code."""

import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import xxhash
import zlib
from conftest import ROWS

import corpus_pipeline as pipe
from pairwave.llm import quality

CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", ".,;:", "!?", "\"'()[]{}<>", "|/\\_", "#$%&*+=@^~"]


def plain_features(text, length):
    """{word bucket: weight} and the list of statistics of one text, by loops."""
    text = text or ""
    words, raw = text.lower().split(), text.encode()
    bucket = lambda w: (xxhash.xxh3_64_intdigest(w.encode()) & 0x7FFFFFFFFFFF) % quality.BUCKETS
    times = Counter(bucket(w) for w in words)
    weight = {b: math.log1p(k) for b, k in times.items()}
    norm = max(math.sqrt(sum(v * v for v in weight.values())), 1e-12)
    shares = [0] * 12
    for b in raw:
        shares[11 if b >= 128 else next((k for k, chars in enumerate(CLASSES, 1) if chr(b) in chars), 0)] += 1
    tokens, lines = max(len(words), 1), text.split("\n")
    triples = list(zip(words, words[1:], words[2:]))
    stats = [s / max(len(raw), 1) for s in shares]
    stats += [math.log1p(len(raw)), math.log1p(len(words)), len(raw) / tokens, len(times) / tokens, max(times.values(), default=0) / tokens, len(set(triples)) / len(triples) if triples else 1.0]
    stats += [len(set(lines)) / len(lines), sum(x[-1:] in (".", "!", "?") for x in lines if x) / len(lines), math.log1p(len(lines)), len(words) / len(lines), math.log1p(max(length or 0, 0)), float(length is not None)]
    return {b: v / norm for b, v in weight.items()}, stats


def plain_score(model, text, length):
    """All pairs of features one by one."""
    words, stats = plain_features(text, length)
    m = len(stats)
    inputs = list(words.items())
    for k, s in enumerate(stats):
        inputs.append((quality.BUCKETS + k, min(4, max(-4, (s - model.mean[k]) / model.scale[k])) / math.sqrt(m)))
        inputs.append((quality.BUCKETS + m + k * quality.BINS + sum(s > e for e in model.edges[k]), 1 / math.sqrt(m)))
    total = model.bias + sum(model.weights[i, 0] * x for i, x in inputs)
    for a, (i, x) in enumerate(inputs):
        for j, y in inputs[:a]:
            total += float(model.weights[i, 1:] @ model.weights[j, 1:]) * x * y
    return 1 / (1 + math.exp(-total))


def test_quality_scores_against_a_plain_version(spark, data):
    rows = spark.read.parquet(f"{data('0.001')}/documents.parquet").select("text", "n_chars").limit(60).collect()
    texts = [(r["text"], r["n_chars"]) for r in rows] + [(t, n) for (_, t), n in zip(ROWS, [5, None, None, 0, 3, None] * 3)]
    texts = [(t, n) for t, n in texts if len((t or "").split()) < 150]
    assert len(texts) > 20
    model = quality.fit(*quality.features([t for t, _ in texts], [n for _, n in texts]), np.arange(len(texts)) % 2)
    got = model.score([t for t, _ in texts], [n for _, n in texts])
    assert np.allclose(got, [plain_score(model, t, n) for t, n in texts], rtol=1e-9, atol=1e-12)


# The pipeline.


def words_of(text):
    return [w for w in re.split(r"\s+", text.lower()) if w]


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


SECRET = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{6,})")


def test_stages_after_quality_against_a_plain_pipeline(spark, data):
    """Near duplicates by all pairs of shingle sets, one secret's kind by its pattern, sequences from the library's ids."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data('0.001')}/documents.parquet")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()))
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][1] == rows[b][1] or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = pipe.near_duplicate_stage(spark, docs, data("0.001"))
    assert {r["doc_id"] for r in kept.collect()} == {rows[k][0] for k in range(len(rows)) if find(k) == k}
    clean = {r["doc_id"]: r["text"] for r in pipe.secret_stage(spark, kept, data("0.001")).collect()}
    before = {r["doc_id"]: r["text"] for r in kept.collect()}
    marked = [d for d, t in before.items() if SECRET.search(t or "")]
    assert all(not SECRET.search(clean[d]) or "[" in clean[d] for d in marked) and all(SECRET.search(before[d])[1] not in clean[d] for d in marked)
    # Packing: every id of every document once, no sequence beyond its capacity, no gaps.
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for d, t in clean.items()}
    places = pipe.packing_stage(spark, spark.createDataFrame(list(clean.items()), "doc_id long, text string"), data("0.001")).collect()
    sequences = {}
    for r in places:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in places) == sum(map(len, ids.values()))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
