"""The pipeline's stages one by one, and as a whole, against plain versions on small documents."""

import os
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from pairwave.llm import ngrams, quality, secrets
from pairwave.llm.frames import shared_dir
from pairwave.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def folder(data):
    return data("0.001")


def test_stages_keep_their_promises(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    good = pipe.quality_stage(spark, docs, folder).cache()
    scores = {r["doc_id"]: r["predicted"] for r in quality.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert good.columns == columns and {r["doc_id"] for r in good.collect()} == {i for i, p in scores.items() if p}
    one = pipe.near_duplicate_stage(spark, good, folder).cache()
    classes = ngrams.jaccard_classes(good)
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == {r["class_id"] for r in classes.select("class_id").distinct().collect()}
    clean = pipe.secret_stage(spark, one, folder).cache()
    assert clean.columns == columns and clean.count() == one.count()
    before = {r["doc_id"]: r["text"] for r in one.collect()}
    for r in clean.collect():
        spans = secrets.scanner().scan([before[r["doc_id"]]])[0]
        assert r["text"] == secrets.masked(before[r["doc_id"]], spans) and (r["text"] == before[r["doc_id"]]) == (not spans)
    packed = pipe.packing_stage(spark, clean, folder)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in clean.collect()}


def stored(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file://")))


def test_joins_and_pipelines_at_the_same_time(spark, folder):
    """None reads or deletes another's tables, and none leaves tables behind but its result's."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = stored(spark)
    alone = [Counter(map(tuple, ngrams.jaccard_classes(docs).collect())), Counter(r["doc_id"] for r in pipe.run(spark, folder).collect())]
    middle = stored(spark)
    jobs = [lambda: Counter(map(tuple, ngrams.jaccard_classes(docs).collect())), lambda: Counter(r["doc_id"] for r in pipe.run(spark, folder).collect())]
    with ThreadPoolExecutor(5) as pool:
        found = list(pool.map(lambda k: jobs[k](), [0, 1, 0, 1, 0]))
    assert found == [alone[k] for k in (0, 1, 0, 1, 0)]
    # Joins leave the tables that their frames read; a pipeline leaves its result only.
    join, pipeline = [x for x in middle - before if not x.startswith("stage-")], [x for x in middle - before if x.startswith("stage-")]
    assert len(pipeline) == 1 and len(stored(spark) - middle) == 3 * len(join) + 2


def test_run_is_all_stages(spark, folder):
    before = stored(spark)
    rows = pipe.run(spark, folder).collect()
    assert len(stored(spark) - before) == 1  # only the last stage's table is left
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipe.STAGES:
        docs = stage(spark, docs, folder)
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, rows)) == Counter(map(key, docs.collect()))
    assert [n for n, _ in pipe.STAGES] == ["quality", "near_duplicates", "secrets", "packing"] and pipe.ORACLE_SQL is None


def test_stages_take_odd_rows(spark, folder):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "a b c d e f", None, "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipe.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert pipe.packing_stage(spark, docs, folder).agg(F.count("*")).first()[0] == 4


def test_each_operator_has_one_query():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["op4_virtual_slots"])
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_matches_sql(spark, data, name, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data(sf)}/documents.parquet')")
    got, want = QUERIES[name](spark, data(sf)).toPandas(), con.execute(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    got, want = (x[columns].sort_values(["doc_id", "slot"]).reset_index(drop=True) for x in (got, want))
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c
