"""Operators 11 to 13 against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import duckdb
import public_tokenizers
import pytest
from conftest import ROWS, TEXT

from pairwave.llm import alignment, decontaminate, funnels
from pairwave.llm.queries import ORACLE_SQL, QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", ["op11_ordinal_funnels", "op12_benchmark_windows"])
def test_matches_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("clicks", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{data('0.001')}/{table}.parquet')")
    got, want = QUERIES[name](spark, data("0.001")).toPandas(), con.execute(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) > 0
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


# Operator 11


def plain_funnels(rows, which, limit, percent):
    events = {(c, k, t) for c, k, t in rows if None not in (c, k, t)}
    by = defaultdict(list)
    for c, k, t in events:
        by[c, k].append(t)
    out = {}
    for f in which:
        for c in {c for c, k, _ in events if k == f.steps[0]}:
            lengths = defaultdict(list)
            deepest, counts = 1, [len(by[c, f.steps[0]])] + [0] * 3
            for began in by[c, f.steps[0]]:
                at = began
                for s, k in enumerate(f.steps[1:], 1):
                    later = [t for t in by[c, k] if t > at]
                    if not later or min(later) - began > limit or any(at < t <= min(later) for x in f.excluding for t in by[c, x]):
                        break
                    lengths[s].append(min(later) - at)
                    at, deepest = min(later), max(deepest, s + 1)
                    counts[s] += 1
            pick = lambda x: sorted(x)[-(-percent * len(x) // 100) - 1] if x else None
            out[f.name, c] = (*counts, deepest, *(pick(lengths[s]) for s in (1, 2, 3)))
    depths = Counter((k[0], v[4]) for k, v in out.items())
    return {k: (*v, depths[k[0], v[4]]) for k, v in out.items()}


def counted(frame):
    return {(r.funnel, r.client_id): (r.n1, r.n2, r.n3, r.n4, r.deepest, r.t2, r.t3, r.t4, r.same_depth) for r in frame.collect()}


BASE = datetime(2024, 3, 31, 0, 59)


def test_funnels_against_plain_version(spark):
    draw, kinds = random.Random(5), ["view", "click", "purchase", "signup", "error", "other", None]
    rows = [(draw.choice([7] * 6 + [1, 2, 3, None]), draw.choice(kinds), draw.choice([None] + [draw.randrange(3_000)] * 12)) for _ in range(4_000)]
    rows += rows[:200]  # repeats; times collide by themselves
    for kind in ("timestamp_ntz", "timestamp"):
        frame = spark.createDataFrame([(c, k, None if t is None else BASE + timedelta(microseconds=t * 1_000_003), 1, 2) for c, k, t in rows], f"client_id long, kind string, arrived_at {kind}, seen_0 int, chunk int").repartition(5)
        want = plain_funnels([(c, k, None if t is None else t * 1_000_003) for c, k, t in rows], funnels.FUNNELS, funnels.LIMIT, 25)
        assert counted(funnels.count(frame)) == want
        assert sum(v[3] for v in want.values()) > 0


def test_funnels_of_any_length_and_names(spark):
    rows = [("a", "x", 1), ("a", "y", 2), ("a", "x", 3), ("a", "y", 3), ("b", "x", 9)]
    frame = spark.createDataFrame([(c, k, BASE + timedelta(microseconds=t)) for c, k, t in rows], "who string, what string, `when` timestamp_ntz")
    which = (funnels.Funnel("one", ("y",)), funnels.Funnel("two", ("x", "y"), ("z",)), funnels.Funnel("three", ("x", "x", "y")))
    got = {(r.funnel, r.client_id): (r.n1, r.n2, r.n3, r.deepest, r.t2, r.t3) for r in funnels.count(frame, which, client="who", kind="what", time="when").collect()}
    # The x at 3 has no y after it: the one at the same time doesn't count.
    assert got == {("one", "a"): (2, 0, 0, 1, None, None), ("two", "a"): (2, 1, 0, 2, 1, None), ("two", "b"): (1, 0, 0, 1, None, None), ("three", "a"): (2, 1, 0, 2, 2, None), ("three", "b"): (1, 0, 0, 1, None, None)}


def test_funnels_of_nothing(spark):
    assert funnels.count(spark.createDataFrame([], "client_id long, kind string, arrived_at timestamp_ntz")).count() == 0
    assert funnels.count(spark.createDataFrame([(None, "view", BASE)], "client_id long, kind string, arrived_at timestamp_ntz")).count() == 0


def test_quantile_over_blocks(spark):
    draw = random.Random(2)
    rows = [(0, c, 2, draw.choice([5, 5, 1 << 15, (1 << 15) - 1, draw.randrange(1 << 28)])) for c in (1, 1, 1, 2) for _ in range(150)]
    for percent in (1, 25, 50, 100):
        got = {r.client: r.value for r in funnels.quantile(spark.createDataFrame(rows, "funnel int, client long, step int, length long"), percent).collect()}
        for c in (1, 2):
            own = sorted(r[3] for r in rows if r[1] == c)
            assert got[c] == own[-(-percent * len(own) // 100) - 1]


def test_hot_client_is_counted_in_chunks(spark):
    """All rows of one client: its times lie in several chunks, and counts go on over them."""
    n = 5_000
    frame = spark.range(n).selectExpr("7L AS client_id", "IF(id % 2 = 0, 'view', 'click') AS kind", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS arrived_at")
    rows = funnels.timeline(frame, ["click", "view"]).orderBy("at").collect()
    assert [r.seen_1 for r in rows] == [i // 2 + 1 for i in range(n)]
    assert [r.seen_0 for r in rows] == [(i + 1) // 2 for i in range(n)]


# Operator 12


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_hits(texts, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in texts:
        w, hit, found = plain_words(text), set(), set()
        for i in range(len(w)):
            for k in sizes:
                if i + k <= len(w) and (own := windows.get(tuple(w[i : i + k]))):
                    hit.update(range(i, i + k))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


PASSAGE = "Alpha beta, gamma: delta 5 epsilon ζήτα eta theta iota kappa lambda"
ITEMS = [(1, PASSAGE), (2, "two words"), (10, "two words"), (3, None), (4, " .,! "), (None, "no id"), (5, "Ünïcode"), (9, "long " * 12), (1, "sixteen"), (9, "long " * 12)]
TEXTS = [*ROWS, (20, PASSAGE.replace("beta", "BeTA") + " end"), (21, "x " + PASSAGE.replace(" ", "\n-- ")), (22, PASSAGE[6:]), (23, "two. Words"), (24, "TWO_WORDS two"), (25, "alpha"), (26, "a" * 50_000), (27, "fine")]


@pytest.mark.parametrize("bound", [decontaminate.SET_WINDOWS, 0])
def test_benchmark_windows_against_plain_version(spark, docs, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "SET_WINDOWS", bound)
    frame = spark.createDataFrame([(i, t, 1, "w", 2) for i, t in TEXTS], "doc_id long, text string, n_words int, _bytes string, items int").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = plain_hits(TEXTS, ITEMS)
    assert Counter(map(tuple, decontaminate.digest(frame, items).collect())) == Counter(want)
    kept = decontaminate.remove_documents(frame, items)
    assert kept.columns == frame.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(w[0] for w in want if not w[5])
    left = {r.doc_id: r.text for r in decontaminate.remove_spans(frame, items).collect()}
    assert left[20] == " end" and left[21] == "x " and left[23] == "" and left[24] == " two" and left[27] == "fine" and left[3] is None and left[4] == ""
    assert left[22] == "" and left[12] == TEXT.replace("sixteen", "")


def test_benchmark_of_nothing(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.digest(none, items).count() == 0
    assert decontaminate.digest(docs, items.limit(0)).where("contaminated OR n_items > 0").count() == 0
    assert decontaminate.remove_documents(docs, items.limit(0)).count() == docs.count()


def test_long_texts_are_read_in_parts(monkeypatch):
    """Windows over the cuts, words longer than a part, and what reaches into the next part."""
    rows = [(b"one two three", "x"), (b"w" * 300, "y"), (b" ".join([b"aa"] * 10), "z")]
    draw = random.Random(3)
    texts = [b" ".join(draw.choice([b"one", b"two", b"three", b"aa", b"aa", b"w" * 300]) for _ in range(n)) for n in (0, 1, 50, 400, 900)] + [b"one two"]
    known = decontaminate.WindowSet(rows)

    def found():
        out = defaultdict(list)
        for t, before, own, starts, ends, hits in decontaminate.occurrences(texts, known, 10):
            out[t] += [(before + i, n, int(starts[i]), int(ends[i + n - 1]), known.windows[k]) for i, n, k in hits]
        return {t: sorted(x) for t, x in out.items()}

    whole = found()
    assert sum(map(len, whole.values())) > 100
    for size in (7, 64, 1000):
        monkeypatch.setattr(decontaminate, "CHUNK_BYTES", size)
        assert {t: x for t, x in found().items() if x} == {t: x for t, x in whole.items() if x}
    monkeypatch.setattr(decontaminate, "BLOCK", 100)
    monkeypatch.setattr(decontaminate, "_powers", [])
    known = decontaminate.WindowSet(rows)
    assert {t: x for t, x in found().items() if x} == {t: x for t, x in whole.items() if x}


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontaminate, "window_hashes", lambda w, n: (w[: len(w) - n + 1] * 0).astype("uint64"))
    known = decontaminate.WindowSet([(b"a b", "1"), (b"c d", "2"), (b"e", "3")])
    hits = [h for *_, found in decontaminate.occurrences([b"x c d e a b"], known, 10) for h in found]
    assert {(i, known.windows[k]) for i, _, k in hits} == {(1, b"c d"), (3, b"e"), (4, b"a b")}


# Operator 13


@pytest.fixture(scope="module")
def plain():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    from pairwave.llm.bpe import byte_alphabet

    tok, sp = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    back = {c: b for b, c in enumerate(byte_alphabet())}

    def groups(text):
        if not text:
            return []
        a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        x = [bytes(back[c] for c in tok.id_to_token(i)) for i in a]
        y = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(x) == b"".join(y) == (" " + text).encode():
            return []
        ends = [0, 0], ([], [])
        for side, tokens in enumerate((x, y)):
            for t in tokens:
                ends[0][side] += len(t)
                ends[1][side].append(ends[0][side])
        out, i, j = [], 0, 0
        for end in sorted({*ends[1][0]} & {*ends[1][1]}):
            p, q = ends[1][0].index(end, i) + 1, ends[1][1].index(end, j) + 1
            out.append((a[i:p], b[j:q]))
            i, j = p, q
        return out

    return groups


def plain_digest(texts, groups):
    found = [(d, groups(t)) for d, t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in found]
    count = Counter(p for link in links for p in link)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (d, g), link in zip(found, links, strict=True):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(link.values()), sum(n for p, n in link.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in link.items()), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return out


HARD = [
    (30, "  two  blanks  "), (31, "\n\n a\n\nb\n c \n"), (32, "a\nb\r\nc\td"), (33, "don't 'sad it's ''s x'd've"), (34, "x▁y"), (35, "<s> </s> <0x0A> <unk> <|endoftext|>"), (36, "é à　b   c d é"),
    (37, "日本語 の テキスト 한국어 🎉🎉 👩‍👩‍👧"), (38, "a1b2.c3-d4_e5/f6"), (39, "\x00 \x01\x7f"), (40, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9), (41, "=" * 500 + " " * 700 + "x"), (42, "año. ¿qué? niño, ünï—x “q” …"), (43, "{\r\n}\r\n"), (44, " "),
]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_against_plain_version(spark, plain, data, small):
    some = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data('0.001')}/documents.parquet").limit(120).collect()] if not small else []
    texts = [*ROWS, *HARD, *some]
    frame = spark.createDataFrame([(i, t, 1, "p") for i, t in texts], "doc_id long, text string, row int, pairs string").repartition(3)
    got = alignment.digest(frame, A, B, **({"frequent": 40, "row_pairs": 7} if small else {}))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_digest(texts, plain))


def test_alignment_groups(spark, plain):
    frame = spark.createDataFrame([(i, t, "g") for i, t in [*ROWS, *HARD]], "doc_id long, text string, groups string")
    got = alignment.align(frame, A, B)
    assert got.columns == ["doc_id", "text", "groups"]
    for r in got.collect():
        assert [(g.a, g.b) for g in r.groups] == plain(r.text)


def test_alignment_of_nothing(spark, none):
    assert alignment.digest(none, A, B).count() == 0
    assert [tuple(r)[1:] for r in alignment.digest(spark.createDataFrame([(None, None)], "doc_id long, text string"), A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_alignment_of_long_texts_in_parts(plain, monkeypatch):
    import pyarrow as pa

    from pairwave.llm import encoding

    text = " ".join(t for _, t in [*ROWS, *HARD] if t and "▁" not in t)
    want = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain(text))
    for size in (50, 700):
        monkeypatch.setattr(encoding, "CHUNK_BYTES", size)
        monkeypatch.setattr(alignment, "CHUNK_BYTES", size)
        found = list(alignment.Aligner(A, B).align_column(pa.array([" " + text, None, " " + text])))
        assert len(found) > 6
        assert b"".join(f[3] for f in found if f[0] == 0)[1:].decode() == want == b"".join(f[3] for f in found if f[0] == 2)[1:].decode()


def test_transducer_states():
    walk = alignment.Transducer([b"ab", b"c", b"abc", b"x"], [b"a", b"bc", b"abc"])
    assert walk.groups([0, 1], [0, 1]) == [([0, 1], [0, 1])]
    assert walk.groups([2, 0, 1], [2, 2]) == [([2], [2]), ([0, 1], [2])]
    assert walk.groups([3], [0]) is None and walk.groups([0], [0]) is None and walk.groups([], [0]) is None
    assert walk.groups([], []) == []
    assert walk.leads[0] == 0 and set(zip(walk.leads, walk.rest, strict=True)) >= {(0, b""), (1, b"ab"), (1, b"b"), (2, b"c")}
