"""URL lists, archives, top-k search, the pipeline, and registered queries against their SQL."""

import gzip
import hashlib
import random
from datetime import date, timedelta
from urllib.parse import urlsplit

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from placescore.llm import topk, url_filters, warc
from placescore.llm.common import ORACLES, QUERIES
from tests.llm.helpers import LOWER, awkward, components, docs_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(str(tuple(r[c] for c in names)) for r in df.collect()) == sorted(str(r) for r in cur.fetchall())


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(QUERIES) < set(entry.queries()) and "pipeline" in entry.queries()


@pytest.mark.parametrize("url", ["http://a.b.example.com/x", "https://u:p@A.b.Example.com:8080?q#f", "http://example.com.", "ftp://h/", "no url", "", None, "http://", "https://x.y.z/@q"])
def test_host_of(spark, url):
    got = spark.createDataFrame([(url,)], "url string").select(url_filters.host_of(F.col("url"))).first()[0]
    try:
        want = (urlsplit(url or "").hostname or "").rstrip(".") or None
    except ValueError:
        want = None
    assert got == want


def test_temporal_join(spark):
    random.seed(1)
    day = lambda n: date(2024, 1, 1) + timedelta(n)
    hosts = ["a.x.com", "b.x.com", "x.com", "y.org", "q.y.org"]
    entries = [(random.choice([*hosts, "X.com", None]), day(random.randint(0, 40)), random.choice(["add", "add", "remove", "other"]), random.choice(["spam", "adult"])) for _ in range(60)]
    captures = [(i, f"http://{random.choice(hosts)}/p", day(random.randint(0, 40)), "x") for i in range(300)] + [(1000, None, day(3), "x"), (1001, "http://x.com/", None, "x"), (None, "http://x.com/", day(9), "x")]
    got = url_filters.judge(spark.createDataFrame(captures, "page_id bigint, url string, fetched date, host string"), spark.createDataFrame(entries, "key string, since date, action string, category string")).collect()

    def want(url, when):
        if not url or not when:
            return 0, None, None
        labels, hits = urlsplit(url).hostname.split("."), []
        for i in range(len(labels)):
            key = ".".join(labels[i:])
            for category in ("adult", "spam"):
                past = [(s, a) for k, s, a, c in entries if k and k.lower() == key and c == category and a in ("add", "remove") and s <= when]
                if past and max(past)[1] == "add":
                    hits.append((-len(key), category, key))
        return len(hits), *((min(hits)[2], min(hits)[1]) if hits else (None, None))

    by_id = {r.page_id: (r.active, r.decided_by, r.category) for r in got}
    assert len(got) == len(captures)
    assert all(by_id[i] == want(u, f) for i, u, f, _ in captures)
    none = spark.createDataFrame([], "page_id bigint, url string, fetched date")
    assert url_filters.judge(none, spark.createDataFrame(entries, "key string, since date, action string, category string")).count() == 0


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES_PER_BLOCK", 7)
    monkeypatch.setattr(warc, "LINES_PER_SHARD", 40)
    random.seed(2)
    bodies = ["é" * 60, "x" * 99, "y" * 100, "long " * 50_000, None, "", "a\r\n\r\nb" * 30]
    pages = [(i, random.choice(["http://a.com/", "https://b.a.com:80/p q\n?z", None, "odd"]) if i % 5 else f"http://h{i}.org/{i}", random.choice(bodies), "x") for i in range(200)]
    pages += [(pages[7][0], *pages[7][1:]), (None, "http://n.org/", "y" * 100, "x")]
    got = warc.archive_and_read(spark.createDataFrame(pages, "page_id bigint, url string, html string, key string").repartition(4)).collect()
    first = {}
    for i, _, t, _ in pages:
        if i is not None and len((t or "").encode()) >= 100:
            first[t] = min(first.get(t, i), i)
    want = []
    for i, _, t, _ in pages:
        raw = (t or "").encode()
        refers = first[t] if len(raw) >= 100 and i != first[t] else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert warc.archive_and_read(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_warc_record_can_be_read_by_hand(tmp_path):
    raw = gzip.decompress(gzip.compress(warc.record(7, "http://a/\r\nX: y", b"<p>", hashlib.sha256(b"<p>").hexdigest(), "response", None)))
    head, _, block = raw.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and b"\r\nX: y" not in head
    assert warc.parse(raw) == (7, 3, hashlib.sha256(b"<p>").hexdigest(), "response", None)
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(raw.replace(b"<p>", b"<q>"))


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=12).round(1 if i % 2 else 6)]) for i in range(1, 500)]
    rows += [(600, rows[99][1]), (700, rows[99][1]), (701, None), (702, []), (703, [1.0, None] * 6), (704, [float("nan")] * 12), (705, [float("inf")] * 12), (None, rows[5][1]), (800, [1.0, 2.0]), (801, [3.0, 4.0]), (900, [0.0] * 12)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, id int").repartition(3)
    usable = [(i, np.floor(1024 * np.float32(v).astype(float)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in usable:
        if q % 100 == 0:
            scored = sorted((-int(a @ b), i) for i, b in usable if i != q and len(a) == len(b))[:10]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_max_score_leaves_terms_unread_and_carries_its_threshold():
    rng = np.random.default_rng(5)
    shard = np.floor(rng.normal(size=(24, 500)) * 1024 * np.linspace(4, 0.05, 24)[:, None])
    ids, asked = np.arange(500), np.floor(rng.normal(size=24) * 1024)
    scores = asked @ shard
    order = np.lexsort((ids, -scores))[:10]
    for floor in (None, int(scores[order[-1]]), int(scores[order[4]]), int(scores.max()) + 1, int(scores.min()) - 1):
        got, score = topk.max_score(shard, ids, asked, None, 10, floor)
        want = [i for i in order if floor is None or scores[i] >= floor]
        assert got.tolist() == want and score.tolist() == scores[want].tolist()

    class Counted(np.ndarray):
        pass

    read = []
    view = shard.view(Counted)
    Counted.__getitem__ = lambda self, key: (read.append(key), np.ndarray.__getitem__(self, key))[1]
    topk.max_score(view, ids, asked, None, 10, int(scores[order[-1]]))
    assert 0 < len(read[0]) < 24  # essential terms alone are traversed for all rows


def test_top_k_of_huge_components(spark):
    df = spark.createDataFrame([(100, [3e38, 0.0]), (1, [3e38, 1.0]), (2, [-3e38, 0.0]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    got = [(r.vec_id, r.score) for r in topk.top_k(df).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (3, 0), (2, -(2**63) + 1)]


def test_pipeline_stages(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + awkward()
    docs = docs_of(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        before = [(r.doc_id, r.text) for r in docs.collect()]
        if name != "best_fit_packing":
            assert out.columns == docs.columns, name
            after = [(r.doc_id, r.text) for r in out.collect()]
            assert {r["_id"] for r in out.collect()} <= {"x"}
        if name == "language_id":
            assert set(before) - set(after) <= {x for x in before if not (x[1] or "").strip() or len(x[1].split()) < 8}
        elif name == "exact_dedup":
            best = {}
            for d, t in before:
                k = (t or "").translate(LOWER)
                best[k] = max((x for x in (best.get(k), d) if x is not None), default=None)
            assert sorted((str(d), (t or "").translate(LOWER)) for d, t in after) == sorted((str(d), k) for k, d in best.items())
        elif name == "ngram_jaccard":
            assert sorted(str(d) for d, _ in after) == sorted(d for d, _, c, _ in components(before, 5, 80) if d == c)
        elif name == "pii":
            assert sorted(str(d) for d, _ in after) == sorted(str(d) for d, _ in before)
            assert not any("@mail" in (t or "") for _, t in after)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.where("piece = 0").count() == len(before)
    assert docs.agg(F.max("length")).first()[0] <= 1024


def test_pipeline_on_an_empty_table(spark):
    docs = docs_of(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
