"""Inverted index, blocked scores and cells, against brute force."""

import collections
import math
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shelfcast.operators import retrieval as rt
from shelfcast.operators import textindex as ti
from shelfcast.operators import textscore as ts

WORD = re.compile(r"[^\W_]+")


def texts(n, seed=1):
    """Zipf-like words, so that some are in most texts and many in few."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [" ".join(rng.choices(words, weights, k=rng.randint(0, 40))) for _ in range(n)]


def plain_tfidf(corpus, queries, k):
    tf = {i: collections.Counter(WORD.findall(t.lower())) for i, t in corpus}
    df = collections.Counter(t for c in tf.values() for t in c)
    n = len(tf)
    idf = lambda t: math.log((1 + n) / (1 + df[t])) + 1
    unit = {i: {t: c * idf(t) for t, c in counts.items()} for i, counts in tf.items()}
    size = {i: math.sqrt(sum(v * v for v in w.values())) for i, w in unit.items()}
    out = set()
    for q, text in queries:
        w = {t: c * idf(t) for t, c in collections.Counter(WORD.findall(text.lower())).items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        hits = sorted((-math.floor(sum(w[t] * unit[i][t] for t in w if t in unit[i]) / size[i] / norm * 1e6 + 0.5) / 1e6, i)
                      for i in unit if any(t in unit[i] for t in w))
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(hits[:k], 1)}
    return out


def test_index_matches_plain_tfidf(spark, monkeypatch):
    corpus, queries = list(enumerate(texts(400))), [*enumerate(texts(30, 5)), (90, "w0 w0 w0"), (91, "nowhere"), (92, ""), (93, "w399 nowhere")]
    a = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    b = spark.createDataFrame(queries, "item_id long, text string")
    want = plain_tfidf(corpus, queries, 5)
    for postings in (500_000, 300):  # one shard, and many
        index = ti.build(a, "doc_id", postings=postings)
        assert index.shards == (1 if postings > 10_000 else index.shards) and (postings > 10_000 or index.shards > 5)
        got = {tuple(r) for r in ti.search(index, b, "item_id", 5).collect()}
        assert {g[:3] for g in got} == {w[:3] for w in want}
        assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(sorted(got), sorted(want)))
    assert ti.search(ti.build(a.limit(0), "doc_id"), b, "item_id", 5).count() == 0
    assert ti.search(index, b.limit(0), "item_id", 5).count() == 0


def test_index_holds_an_id_once_a_document(spark, monkeypatch):
    """Norms from common and rare terms; postings hold places and counts only."""
    monkeypatch.setattr(ti, "COMMON", 3)
    corpus = [*enumerate(texts(60, 8)), (900, "alone"), (901, ""), (None, "w1 alone")]
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    index = ti.build(docs, "doc_id", postings=200)
    idf = {r["term"]: r["idf"] for r in index.idf.collect()}
    counts = {i: collections.Counter(WORD.findall(t)) for i, t in corpus if t and i is not None}
    want = {i: math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items())) for i, c in counts.items()}
    got, found = {}, {}
    rows = index.postings.collect()
    for r in rows:
        if r["term"] is None:
            got.update(zip(r["ids"], r["norms"]))
    names = {r["shard"]: r["ids"] for r in rows if r["term"] is None}
    for r in rows:
        if r["term"] is not None:
            assert r["ids"] is None and r["norms"] is None
            found.update({(names[r["shard"]][p], r["term"]): n for p, n in zip(r["places"], r["tfs"])})
    assert index.shards > 1 and sum(map(len, names.values())) == len(want)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert found == {(i, t): n for i, c in counts.items() for t, n in c.items()}


def test_max_score_reads_fewer_postings():
    """Equal hits, and most postings of common terms unread."""
    rng = np.random.default_rng(2)
    n, lists = 5_000, {}
    for t in range(60):
        at = np.flatnonzero(rng.random(n) < 0.9 / (t + 1))
        lists[f"t{t}"] = (at, rng.random(len(at)) * (0.05 if t < 5 else 0.6))
    shard = ti.Shard(list(lists), [x for x, _ in lists.values()], [y for _, y in lists.values()], [y.max() for _, y in lists.values()])
    read = whole = 0
    for _ in range(30):
        terms = [f"t{t}" for t in (0, 1, 2, *rng.choice(np.arange(5, 60), 5, replace=False))]
        weights = rng.random(8)
        score = np.zeros(n)
        for t, w in zip(terms, weights):
            score[lists[t][0]] += w * lists[t][1]
        want = sorted(((-round(s, 9), int(i)) for i, s in enumerate(score) if s > 0))[:10]
        at, found, r = shard.search(terms, weights, 10)
        got = sorted((-round(s, 9), int(shard.ids[i])) for i, s in zip(at, found))[:10]
        assert got == want
        read, whole = read + r, whole + sum(len(lists[t][0]) for t in terms)
    assert read < whole / 3


def test_a_row_is_dealt_once(spark):
    """Blocks of rows are not copied for more queries."""
    rng = np.random.default_rng(1)
    v = rng.standard_normal((700, 8))
    emb = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:90] + 0.1)], "query_id long, vector array<double>")
    got = rt.cosine_topk(emb, q, k=4, row_block=100, query_block=7).collect()
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = np.floor(unit(v[:90] + 0.1) @ unit(v).T * 1e6 + 0.5) / 1e6
    for r in got:
        order = np.lexsort((np.arange(700), -exact[r["query_id"]]))
        assert order[r["rank"] - 1] == r["vec_id"] and abs(exact[r["query_id"], r["vec_id"]] - r["score"]) < 2e-6
    assert len(got) == 360
    assert rt.cosine_topk(emb.limit(0), q).count() == 0 and rt.cosine_topk(emb, q.limit(0)).count() == 0


def test_cells_recall_on_clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 16)) * 3
    v = np.concatenate([c + rng.standard_normal((80, 16)) for c in centres])
    emb = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(i, (v[i * 37] + 0.05).tolist()) for i in range(100)], "query_id long, vector array<double>")
    found = rt.cells_topk(emb, q, k=10).cache()
    recall = rt.recall(found, rt.cosine_topk(emb, q, k=10)).agg(F.avg("recall"), F.count("*")).first()
    assert recall[0] >= 0.9 and recall[1] == 100
    assert found.agg(F.max("candidates")).first()[0] < len(v) / 10
    # Cells grow slower than the rows, and few rows are whole cells.
    assert rt.cells_topk(emb.limit(0), q).count() == 0
    assert rt.cells_topk(emb.where("vec_id < 2"), q.where("query_id = 0"), k=10).count() <= 2


def test_hot_cells_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(rt, "ROW_BLOCK", 10)
    emb = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 else [0.0, 1.0 + i]) for i in range(200)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.1])], "query_id long, vector array<double>")
    got = [(r["rank"], r["vec_id"]) for r in rt.cells_topk(emb, q, k=5).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 4), (4, 5), (5, 7)]


def test_perplexity_of_common_and_rare_terms(spark, monkeypatch):
    monkeypatch.setattr(ts, "COMMON", 3)
    docs = list(enumerate([*texts(50), "", "unique once"]))
    got = {r["doc_id"]: r for r in ts.corpus_perplexity(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    c = collections.Counter(w for _, t in docs for w in t.split())
    total = sum(c.values()) + len(c)
    want = {i: math.exp(-sum(math.log((c[w] + 1) / total) for w in t.split()) / len(t.split())) for i, t in docs if t}
    assert set(got) == set(want) and all(abs(got[i]["perplexity"] - p) < 1e-3 for i, p in want.items())


def test_factorised_ids_keep_order():
    shard = ti.Shard(["a", "b"], [np.array([9, 3]), np.array([3, 5])], [np.array([0.5, 0.5]), np.array([1.0, 0.2])], [0.5, 1.0])
    assert shard.ids.tolist() == [3, 5, 9]
    assert isinstance(pd.Series(shard.ids), pd.Series)
