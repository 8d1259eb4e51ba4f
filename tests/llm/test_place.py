"""Revisits, top-k search and shards against brute force."""
import datetime as dt
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from attrition.llm import revisits, sharding, topk

START = dt.datetime(2024, 1, 1)


def brute_resolve(records):
    by_id, full = {}, defaultdict(list)
    for n, (i, url, ts, status, headers, payload) in enumerate(records):
        c = revisits.canonical(url)
        if status and 200 <= status < 300 and status != 206 and c and ts and i is not None:
            full[c].append((ts, i, payload, {k.lower(): v for k, v in reversed((headers or {}).items())}))
        by_id[n] = (c, {k.lower(): v for k, v in reversed((headers or {}).items())})
    out = []
    for n, (i, url, ts, status, headers, payload) in enumerate(records):
        c, own = by_id[n]
        if not c or ts is None or i is None:
            out.append((i, "no_key", None, payload, own))
            continue
        if status != 304:
            out.append((i, "full" if status and 200 <= status < 300 and status != 206 else "other", None, payload, own))
            continue
        earlier = [f for f in full[c] if f[0] < ts]
        if not earlier:
            out.append((i, "no_response", None, None, own))
            continue
        _, rid, digest, old = max(earlier, key=lambda f: f[:2])
        if "etag" in own and "etag" in old:
            same = own["etag"].removeprefix("W/") == old["etag"].removeprefix("W/")
        elif "last-modified" in own and "last-modified" in old:
            same = own["last-modified"] == old["last-modified"]
        else:
            same = None
        merged = old | {k: v for k, v in own.items() if k in revisits.PERMITTED}
        out.append((i, {True: "resolved", False: "mismatch", None: "unverified"}[same], rid, digest if same is not False else None, merged if same is not False else own))
    return out


SCHEMA = "record_id long, url string, ts timestamp, status int, headers map<string,string>, payload_digest string"


@pytest.mark.parametrize("partitions", ["2", "13"])
def test_resolve(spark, partitions):
    rng = random.Random(8)
    urls = ["http://www.hot.example/a?b=1&utm_source=x", "https://hot.example:443/a?b=1#top", "http://cold.example", None, "nonsense", "http://[bad"]
    records = []
    for i in range(400):
        headers = {k: rng.choice(["1", "2", "W/1"]) for k in ("ETag", "Last-Modified", "Date", "Content-Length", "vary") if rng.random() < 0.6}
        status = rng.choice([200, 304, 304, 404, 206, None])
        records.append((i if rng.random() < 0.98 else None, rng.choice(urls[:2] * 6 + urls), START + dt.timedelta(minutes=rng.randint(0, 60)) if rng.random() < 0.97 else None,
                        status, headers if rng.random() < 0.95 else None, None if status == 304 else f"p{i}"))
    records.append((500, urls[0], START + dt.timedelta(days=1), 304, {"ETAG": "1", "etag": "2"}, None))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(records, SCHEMA).withColumns({c: F.lit(1) for c in ("part", "r", "own", "curl", "kind", "late")})
        got = [(r.record_id, r.outcome, r.response_id, r.payload_digest, r.headers) for r in revisits.resolve(df).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    tidy = lambda x: sorted(repr((*r[:4], sorted(r[4].items()))) for r in x)
    assert tidy(got) == tidy(brute_resolve(records))
    assert revisits.resolve(df.where("record_id < -1")).collect() == []


def test_canonical():
    c = revisits.canonical
    assert c("HTTP://WWW.Example.com:80") == c("https://example.com/#x") == "example.com/"
    assert c("http://a.b/p?z=1&a=&utm_medium=q") == "a.b/p?a=&z=1" and c("http://a.b:8080/") == "a.b:8080/"
    assert c(None) is c("") is c("no host") is c("http://a.b:port/") is None


def test_captures_resolve(spark):
    out = revisits.op7_revisits(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    kinds = {r.outcome: r["count"] for r in out.groupBy("outcome").count().collect()}
    assert sum(kinds.values()) == 2 * n and kinds["full"] == n and min(kinds.get(k, 0) for k in ("resolved", "mismatch", "no_response", "unverified")) > 0


def brute_top(rows, k, is_query):
    valid = [(i, [int(np.floor(1024.0 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in {(i, tuple(v)) for i, v in valid if is_query(i)}:
        s = sorted((-sum(a * b for a, b in zip(q[1], v, strict=True)), i) for i, v in valid if i != q[0] and len(v) == len(q[1]))
        out += [(q[0], r + 1, i, max(-(1 << 63), min((1 << 63) - 1, -m))) for r, (m, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("drop,block,chunk", [(2, 7, 2), (0, 64, 100), (5, 1000, 1)])
def test_top_k(spark, drop, block, chunk):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, 6).round(1)]) for i in range(90)]
    rows += [(100, None), (101, []), (102, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (103, [float("nan")] * 6), (104, [float("inf")] * 6), (105, [0.5, 0.5]), (110, [0.25, -1.0]), (None, [0.0] * 6),
             (5, rows[5][1]), (10, rows[10][1]), (106, [0.0] * 6), (107, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumns({c: F.lit(1) for c in ("v", "score", "rank", "query_id")})
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, k=5, drop=drop, block_rows=block, chunk=chunk).collect())
    assert got == brute_top([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows], 5, lambda i: i % 10 == 0)
    assert topk.top_k(df.where("vec_id < 0"), F.col("vec_id") % 10 == 0).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(0, 12), st.integers(1, 9), st.data())
def test_block_search(dims, drop, k, data):
    number = st.integers(-2000, 2000)
    codes = data.draw(st.lists(st.lists(number, min_size=dims, max_size=dims), min_size=1, max_size=90))
    q = np.array(data.draw(st.lists(number, min_size=dims, max_size=dims)))
    ids = np.array(data.draw(st.permutations(range(len(codes)))))
    codes = np.array(codes)
    found, scores = topk.Block(ids, codes, drop).search(0, q, k)
    want = sorted((-int(c @ q), int(i)) for i, c in zip(ids, codes, strict=True) if i)[:k]
    assert [(-int(s), int(i)) for i, s in zip(found, scores, strict=True)] == want


def test_large_components_saturate(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0]), (3, [0.0, 1.0]), (4, [1e12, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0, k=4).orderBy("rank").collect()]
    assert [i for i, _ in got] == [1, 4, 3, 2] and got[0][1] == (1 << 63) - 1 and got[2][1] == 1 << 20 and got[3][1] == -(1 << 63)


def check_shards(got, rows, shards):
    assert sorted((r.doc_id is None, r.doc_id, r["size"], r.text_crc32) for r in got) == sorted(
        (i is None, i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return {k: sum(r["size"] for r in got if r.shard == k) for k in range(shards)}


def test_shards_of_nasty_documents(nasty_docs, nasty_rows, no_docs):
    check_shards(sharding.shard_by_bytes(nasty_docs).collect(), [(i, t) for i, t, *_ in nasty_rows], 16)
    assert sharding.shard_by_bytes(no_docs).collect() == []


def test_shards_are_equal_and_groups_stay_together(spark):
    rng = random.Random(9)
    rows = [(i, "hot text " * 12 if i % 3 == 0 else f"text {rng.randint(0, 9000)} " * rng.randint(1, 30)) for i in range(12_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard_by_bytes(df).collect()
    size = check_shards(got, rows, 16)
    mean = sum(size.values()) / 16
    assert max(abs(s - mean) for s in size.values()) < 0.04 * mean
    text = dict(rows)
    places = defaultdict(set)
    for r in got:
        places[text[r.doc_id]].add(r.shard)
    hot = places.pop("hot text " * 12)
    assert len(hot) > 3 and sum(len(p) > 1 for p in places.values()) == 0
    few = sharding.shard_by_bytes(df, ranges=16, overfull=1.2).select("fine_range", "size").toPandas().groupby("fine_range")["size"].sum()
    assert few.max() <= 1.2 * sum(size.values()) / 16  # overfull ranges were subdivided


def test_write_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string")
    plan = sharding.shard_by_bytes(df, shards=4, ranges=8)
    sharding.write_shards(df, plan, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    want = {(r.doc_id, r.shard, r.slot) for r in plan.collect()}
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == want and back.columns == ["doc_id", "text", "slot", "shard"]
