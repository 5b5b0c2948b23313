"""The registered queries of the text operators: each over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, decontaminate, fingerprints, funnels, gif, ngrams, packing, quality, secrets, sharding, varint, warc
from .frames import table

WORD_BPE, BYTE_BPE, PIECE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), sample=quality.SAMPLE)


def op2_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digest(table(spark, sf_dir, "documents"))


def op3_ranked_varint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varint.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=2)


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), shards=16)


def op5_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(table(spark, sf_dir, "documents"))


def op6_banded_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.jaccard_classes(table(spark, sf_dir, "documents"), n=5, threshold=0.8, recall=0.999)


def op7_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(table(spark, sf_dir, "pages"))


def op9_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=2, capacity=1024)


def op10_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op11_ordinal_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnels.count(table(spark, sf_dir, "clicks"), funnels.FUNNELS, limit=funnels.LIMIT, percent=25)


def op12_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=decontaminate.WINDOW)


def op13_suffix_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


QUERIES = {f.__name__: f for f in (op1_factorisation_machine, op2_gif, op3_ranked_varint, op4_virtual_slots, op5_one_permutation, op6_banded_jaccard, op7_speculative_bpe, op8_warc_derivatives, op9_swap_packing, op10_trigram_secrets, op11_ordinal_funnels, op12_benchmark_windows, op13_suffix_alignment)}

#: CRC-32 of a text's UTF-8 bytes, by hex digits and the table of its polynomial; the slot of a doc_id; the edit of the first map.
_OP4 = f"""WITH RECURSIVE polynomial AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT + 1 AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {sharding.SLOTS} AS v,
 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(hex(coalesce(text, '')), ''), lambda c: (instr('0123456789ABCDEF', c) - 1)::BIGINT)),
 lambda s, n: CASE WHEN s < 4294967296 THEN s + ((n + 16) << 32) ELSE xor((s & 4294967295) >> 8, t[1 + (xor(s & 255, (((s >> 32) - 16) << 4) + n))::INTEGER]) END), 4294967295)::BIGINT AS crc FROM documents, polynomial),
m AS (SELECT k.v, k.v % 16 AS shard, coalesce(sum(size), 0)::BIGINT AS bytes FROM (SELECT unnest(range({sharding.SLOTS})) AS v) k LEFT JOIN d ON d.v = k.v GROUP BY k.v),
u AS (SELECT *, sum(bytes) OVER (PARTITION BY shard ORDER BY bytes DESC, v ROWS UNBOUNDED PRECEDING) <= sum(bytes) OVER () / 16 AS stays FROM m),
pool AS (SELECT v, bytes, row_number() OVER (ORDER BY bytes DESC, v) AS n FROM u WHERE NOT stays),
loads AS (SELECT list(b ORDER BY shard) AS l FROM (SELECT shard, coalesce(sum(bytes) FILTER (stays), 0)::BIGINT AS b FROM u GROUP BY shard)),
placed AS (SELECT 0::BIGINT AS n, l, NULL::BIGINT AS v, NULL::INTEGER AS shard FROM loads UNION ALL
 SELECT p.n, list_transform(l, lambda x, i: CASE WHEN i = e THEN x + p.bytes ELSE x END), p.v, (e - 1)::INTEGER FROM (SELECT n, l, list_position(l, list_min(l)) AS e FROM placed) r JOIN pool p ON p.n = r.n + 1),
now AS (SELECT v, shard FROM u WHERE stays UNION ALL SELECT v, shard FROM placed WHERE n > 0)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, now.shard::INTEGER AS shard, row_number() OVER (PARTITION BY now.shard ORDER BY d.v, crc % {sharding.GROUPS}, doc_id NULLS FIRST, size, crc) - 1 AS slot, NULL::INTEGER AS grown_shard,
 d.v::INTEGER AS virtual_slot, 2::INTEGER AS map_version, (d.v % 16)::INTEGER AS first_shard FROM d JOIN now ON now.v = d.v"""
#: Next steps and next excluded rows by as-of joins, quantiles by row numbers.
_STEP = """a{n} AS (SELECT q.funnel, q.client_id, q.b, q.p, q.t FROM (SELECT a.funnel, a.client_id, a.b, a.t AS p, n.t, f.x FROM a{m} a JOIN f USING (funnel) ASOF JOIN e n ON a.client_id = n.client_id AND f.k{n} = n.kind AND a.t < n.t) q
 ASOF LEFT JOIN e z ON q.client_id = z.client_id AND q.x = z.kind AND q.p < z.t WHERE q.t - q.b <= 300000000 AND (z.t IS NULL OR z.t > q.t))"""
_OP11 = f"""WITH e AS (SELECT DISTINCT client_id, kind, epoch_us(arrived_at) AS t FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND arrived_at IS NOT NULL),
f(funnel, k1, k2, k3, k4, x) AS (VALUES ('A', 'view', 'click', 'view', 'purchase', 'error'), ('B', 'signup', 'view', 'click', 'purchase', 'error'), ('C', 'click', 'click', 'purchase', 'view', 'signup')),
a1 AS (SELECT funnel, client_id, t AS b, NULL::BIGINT AS p, t FROM e JOIN f ON kind = k1),
{", ".join(_STEP.format(n=n, m=n - 1) for n in (2, 3, 4)).replace(", a", ",\na")},
s AS (SELECT 1 AS step, * FROM a1 UNION ALL SELECT 2, * FROM a2 UNION ALL SELECT 3, * FROM a3 UNION ALL SELECT 4, * FROM a4),
r AS (SELECT *, row_number() OVER (PARTITION BY funnel, client_id, step ORDER BY t - p) AS i, count(*) OVER (PARTITION BY funnel, client_id, step) AS n FROM s),
g AS (SELECT funnel, client_id, count(*) FILTER (step = 1) AS n1, count(*) FILTER (step = 2) AS n2, count(*) FILTER (step = 3) AS n3, count(*) FILTER (step = 4) AS n4, max(step)::INTEGER AS deepest,
 {", ".join(f"max(t - p) FILTER (step = {k} AND i = (25 * n + 99) // 100) AS t{k}" for k in (2, 3, 4))} FROM r GROUP BY funnel, client_id)
SELECT *, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM g"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP12 = f"""WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
v AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS g FROM (SELECT *, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
o AS (SELECT r, i, k, item FROM (SELECT r, i, k, array_to_string(w[i + 1 : i + k], ' ') AS g FROM (SELECT r, w, k, unnest(range(len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM v) WHERE len(w) >= k)) JOIN v USING (k, g)),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS x FROM o) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)"""
ORACLE_SQL: dict[str, str] = {"op4_virtual_slots": _OP4, "op11_ordinal_funnels": _OP11, "op12_benchmark_windows": _OP12}
