"""The pipeline's stages over the smallest tables, each against its own input."""
import hashlib
import pickle
import random

import corpus_pipeline
import __spark_entry__ as entry
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from attrition.llm import ngram_join, packing, quality, queries
from tests.llm.test_copies import brute_classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("steps")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(str(top / str(k)))
        out.append(spark.read.parquet(str(top / str(k))))
    return out


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "mix_sources", "packing"]
    for s in steps[:5]:
        assert s.schema == steps[0].schema
    assert steps[5].columns == [f.split()[0].strip("`") for f in packing.SCHEMA.split(", ")]


def test_stages_on_their_own_input(steps):
    rows = [{r.doc_id: r for r in s.collect()} for s in steps[:5]]
    for before, after in zip(rows, rows[1:], strict=False):
        assert 0 < len(after) <= len(before) and all(before[i] == r for i, r in after.items())
    last = {}
    for r in rows[1].values():
        key = hashlib.sha256((r.text or "").encode()).hexdigest()
        last[key] = max(last.get(key, -1), r.doc_id)
    assert set(rows[2]) == set(last.values())
    classes = brute_classes([(i, r.text) for i, r in rows[2].items()], 5, 80, 100)
    assert set(rows[3]) == {c for _, c in classes.values()}
    assert {r.doc_id for r in steps[5].select("doc_id").distinct().collect()} == set(rows[4])


def test_pipeline_on_nasty_documents(spark, nasty_docs):
    docs = nasty_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_rows_that_repeat_an_id_are_dropped_by_their_own_links(spark):
    rng = random.Random(8)
    a, other, more = (" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)) for n in (60, 40, 50))
    rows = [(1, a), (2, a + " word"), (2, other), (7, more), (7, more), (3, more + " end"), (None, a), (5, None), (6, ""), (8, ""), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"own": F.lit(1), "cls": F.lit("x"), "__dropped": F.lit(2)}).repartition(3)
    kept = corpus_pipeline.STAGES[2][1](spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, a), (2, other), (3, more + " end"), (None, a), (5, None), (6, ""), (8, ""), (2, None)], key=repr)


def test_stages_without_documents(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == no_docs.columns and docs.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect() == []


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == steps[4].select("doc_id").distinct().count()


def test_queries_are_registered():
    names = entry.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and set(queries.ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.execute(queries.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    rows = lambda d: sorted(map(repr, d[cols].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_jaccard_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute_classes([(r.doc_id, r.text) for r in docs], 4, 85, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op8_ngram_join(spark, SF).collect()}
    assert got == {i: (n.pop(), c) for i, (n, c) in want.items()}


def test_counters_pass_the_driver_compressed(spark, monkeypatch):
    sizes = []
    keep = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sizes.append(len(pickle.dumps(value))) or keep(self, value))
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(rng.randint(1, 40)))) for i in range(60)]
    rows += [(i + 60, t + " end") for i, t in rows]
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), words=3, num=80, den=100, bits=24).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in brute_classes(rows, 3, 80, 100).items()}
    assert max(sizes) < 4 << 20  # 2**24 counters of two bytes are 32 MB


def test_packed_counters_are_read_back():
    counts = np.array([0, 1, 255, 256, 65535, 3], dtype=np.uint16)
    assert (ngram_join.unpacked(ngram_join.packed(counts)) == counts).all()


def test_raking_is_planned_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    spark.sparkContext.setJobGroup("raking", "jobs of one mix")
    try:
        mixed = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [spark.conf.get(n) for n in names] == before
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("raking")) < 70
    assert 0 < mixed.count() <= docs.count()


def test_fit_in_blocks():
    rng = np.random.default_rng(4)
    rows, grades = [np.unique(rng.integers(0, 256, 20)).astype("<i4") for _ in range(90)], rng.integers(0, 3, 90).tolist()
    one, many = (quality.fit(rows, grades, 2, 8, each=n) for n in (1000, 7))
    assert (one.weights == many.weights).all() and (one.thresholds == many.thresholds).all()
