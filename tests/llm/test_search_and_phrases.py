"""Spelling variants, exact top products and collocations, against brute force."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import ann, phrases, products, variants
from tests.llm.conftest import NASTY, SF_SMALL, documents

FOLD = str.maketrans(variants.UPPER, variants.LOWER)


# --- spelling variants ------------------------------------------------------

def plain_variants(rows, least=5, ratio=5, mutate=199):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % mutate == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least}

    def is_near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    out, form = {}, {}
    for w in n:
        others = sorted((-n[x], x) for x in n if x != w and is_near(w, x))
        form[w] = others[0][1] if others and -others[0][0] >= ratio * n[w] else None
        out[w] = [n[w], len(others), form[w]]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, out[w][0], out[w][1], n[form[w]] if form[w] else None)
    return out


def spelled(rng, n=160):
    """Texts of words, anagrams and one-letter edits of unequal frequency."""
    base = ["receive", "recieve", "separate", "seperate", "accommodation", "Übergröße", "naïveté", "parallel", "aaaaaaa", "÷×÷×÷×÷"]
    words = []
    for w in base:
        words += [w] * rng.choice([8, 40, 400])
        for _ in range(12):
            i = rng.randrange(len(w))
            edit = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("aeé") + w[i + 1:], w[:i] + "s" + w[i:], w[::-1]])
            words += [edit.upper() if rng.random() < 0.3 else edit] * rng.choice([2, 6, 9, 60])
    rng.shuffle(words)
    return [" ".join(words[i::n]) for i in range(n)]


@pytest.mark.parametrize("cell,sample", [(2_048, 100_000), (6, 60)])
def test_variants_match_brute_force(spark, monkeypatch, cell, sample):
    monkeypatch.setattr(variants, "CELL", cell)
    monkeypatch.setattr(variants, "SAMPLE", sample)
    texts = [*spelled(random.Random(3)), *NASTY, "word" * 4_000 + " x"]
    extra = [(None, "receive recieve", None, None, None)] * 6
    docs = documents(spark, texts, extra)
    for c in ("word", "n", "_id", "_run", "_h", "len", "cell"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = variants.variants(docs, mutate=7)
    want = plain_variants([*enumerate(texts), *((None, r[1]) for r in extra)], mutate=7)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect()} == want
    assert any(root not in (w, form) for w, (form, root, *_) in want.items()), "a path of two steps"


def test_variants_of_nothing(spark, empty):
    assert variants.variants(empty).collect() == []
    assert variants.variants(documents(spark, ["too rare", None])).collect() == []


def test_tree_reaches_every_neighbour():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, (400, 7)).astype(np.uint8)
    vectors = variants.counts(data)
    for length in (6, 7):
        query = rng.integers(97, 101, (200, length)).astype(np.uint8)
        q, d = variants.near(variants.Tree(vectors, variants.LEAF, tight=True), data, vectors, query)
        want = {(i, j) for i in range(200) for j in range(400) if variants._one_edit(query[i:i + 1], data[j:j + 1])[0]}
        assert len(q) == len(want) and set(zip(q.tolist(), d.tolist())) == want
    long = np.full((3, 40_000), 97, dtype=np.uint8)
    long[1, 7] = long[2, 9] = 98
    v = variants.counts(long)
    q, d = variants.near(variants.Tree(v, 1, tight=True), long, v, long)
    assert sorted(zip(q.tolist(), d.tolist())) == [(0, 1), (0, 2), (1, 0), (2, 0)]


def test_variants_oracle(spark):
    _oracle(spark, "op11_spelling_variants", "documents")


# --- exact top products -----------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int"


def plain_products(rows, k=10):
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(1024 * x) for x in v)]
    out = collections.Counter()
    for a, (i, q) in enumerate(usable):
        if i % 10 == 0:
            best = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(usable) if b != a and len(v) == len(q))
            out.update((i, r, j, max(min(-s, 2 ** 63 - 1), -2 ** 63)) for r, (s, j) in enumerate(best[:k], 1))
    return out


def hostile_vectors():
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(9) * rng.choice([0.01, 1, 3]) * np.r_[4, 3, np.full(7, 0.3)]).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[20][1]) for i in range(120)]  # one vector that many rows hold
    rows += [(30, rows[30][1]), (30, rows[30][1]), (2000, [0.0] * 9), (2010, None), (2020, [1.0, None]), (2030, [float("nan")] * 9),
             (2040, [float("-inf")] + [0.0] * 8), (None, [1.0] * 9), (2050, []), (2060, []), (2070, [-1e-20, 2.0]), (2080, [3.0, -2.0]),
             (2090, [1.7e308] * 9)]
    return rows


@pytest.mark.parametrize("block", [(8_192, 131_072), (16, 32)])
def test_products_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(products, "BLOCK", block)
    monkeypatch.setattr(products, "SAMPLE", 50)
    rows = hostile_vectors()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(7)
    for c in ("_v", "_q", "_dim", "_row", "_len", "score"):
        df = df.withColumn(c, F.lit("clash"))
    got = collections.Counter(map(tuple, products.top_products(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == plain_products(rows)


def test_products_beyond_doubles(spark):
    rows = [(i, [x, 1.0, -x]) for i, x in enumerate([1e30, -1e30, 3.0, 1e18, 1e18 + 4096, -5e200, 7e-200])]
    rows += [(10, [1e18, 0.5, 0.25]), (20, [2.0 ** 40 + 1, 1.0, 1.0]), (30, [2.0 ** 40, 1.0, 1.0])]
    got = products.top_products(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS), F.col("vec_id") % 10 == 0)
    assert collections.Counter(map(tuple, got.collect())) == plain_products(rows)


def test_products_of_nothing(spark):
    df = spark.createDataFrame([], VECTORS)
    assert products.top_products(df, F.col("vec_id") % 10 == 0).collect() == []
    alone = spark.createDataFrame([(0, [1.0], 0), (5, None, 0)], VECTORS)
    assert products.top_products(alone, F.col("vec_id") % 10 == 0).collect() == []


def test_partial_sums_prune(monkeypatch):
    """Most pairs are left before their full product."""
    rng = np.random.default_rng(2)
    x = np.floor(1024 * rng.standard_normal((4_000, 32)) * 0.8 ** np.arange(32))
    basis = products.axes(x[:500])
    block = products.Block(np.arange(4_000), np.arange(4_000), x, basis)
    full = []
    monkeypatch.setattr(np, "einsum", lambda spec, a, b, real=np.einsum: full.append(len(a)) or real(spec, a, b))
    found = products.search(block, x[:20], np.arange(20), np.full(20, -np.inf), basis, 10)
    for q, (at, scores) in enumerate(found):
        want = sorted((-float(x[q] @ x[j]), j) for j in range(4_000) if j != q)[:10]
        assert [(-s, int(block.ids[p])) for p, s in zip(at, scores)] == [(s, j) for s, j in want]
    assert sum(full) < 20 * 4_000 / 10


def test_products_oracle(spark):
    _oracle(spark, "op12_top_products", "embeddings")


# --- collocations -----------------------------------------------------------

def plain_collocations(rows, least=10, longest=3, top=2_000):
    f = collections.defaultdict(collections.Counter)
    total = collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(FOLD)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, c in f.items():
        every = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in every.items():
            if any(100 * b >= 50 * a for q, b in every.items() if len(q) > len(p) and any(
                    q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((10 ** 6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out |= {(lang, r, p.decode(), -a, x, y, total[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)}
    return out


def phrase_texts(rng):
    words = ["New", "york", "times", "of", "the", "a b", "É", "x" * 50, "-", "san", "Francisco", "bay"]
    fixed = ["new YORK times", "san francisco bay", "of the", "the the the the", "x\ty"]
    return [" ".join(rng.choice([rng.choice(words), rng.choice(fixed)]) + rng.choice(["", "", "", ",", "\n"])
                     for _ in range(rng.randint(0, 60))) for _ in range(120)]


def _rows(df):
    return {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize("fan,longest,least,top", [(16, 3, 10, 2_000), (2, 3, 2, 40), (3, 4, 3, 2_000)])
def test_collocations_match_brute_force(spark, monkeypatch, fan, longest, least, top):
    monkeypatch.setattr(phrases, "FAN", fan)
    monkeypatch.setattr(phrases, "TILE_PLACES", {16: 2_000_000, 2: 40, 3: 200}[fan])
    texts = [*phrase_texts(random.Random(8)), *NASTY]
    docs = documents(spark, texts, [(3, "of the of the", "und", "", 1)] * 9).repartition(6)
    for c in ("chunk", "words", "counts", "ids", "n", "a", "id"):
        docs = docs.withColumn(c, F.lit("clash"))
    want = plain_collocations([(r["lang"], r["text"]) for r in docs.collect()], least, longest, top)
    got = phrases.collocations(docs, least, longest, top)
    assert _rows(got) == want and len(want) > 20
    assert got.count() == len(want)


def test_collocations_of_nothing(spark, empty):
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(documents(spark, ["", None, ".,;", "one two"])).collect() == []


def test_scores_beyond_64_bits(spark):
    a, left, right = 3 * 10 ** 12, 4 * 10 ** 12, 5 * 10 ** 12
    df = spark.createDataFrame([(a, [left, a], [right, a])], "a long, prefix array<long>, suffix array<long>")
    got = df.select(phrases._score("a", "prefix", "suffix", 2).alias("s")).first()["s"]
    assert (got["score"], got["k"], got["l"], got["r"]) == (10 ** 6 * a * a // (left * right), 1, left, right)


def test_tiles_add_up(monkeypatch):
    """Dense and sparse tiles of uneven bands."""
    monkeypatch.setattr(phrases, "ARRAY", 20)
    monkeypatch.setattr(phrases, "FILLED", 3)
    rng = np.random.default_rng(4)
    edges = np.array([0, 1, 4, 9, 30])
    want, tiles, kinds = collections.Counter(), {}, collections.Counter()
    for size in (40, 3, 1, 0, 25, 200):
        first, second = (rng.random(size) ** 2 * 30).astype(int), (rng.random(size) ** 2 * 30).astype(int)
        want.update(zip(first.tolist(), second.tolist()))
        made = phrases.tiles(first, second, np.arange(size), edges)
        for row, col, left0, right0, width, area, steps, counts, places in made.itertuples(index=False):
            cells, n = phrases.unpacked(steps, counts)
            tile = tiles.setdefault((left0, right0, width), phrases.Tile(area))
            tile.add(cells, n)
            at = np.frombuffer(places, dtype=np.int32)
            assert [(first[p], second[p]) for p in at] == list(itertools.chain.from_iterable(
                [(left0 + c // width, right0 + c % width)] * k for c, k in zip(cells, n)))
    got = {}
    for (left0, right0, width), t in tiles.items():
        kinds[t.array is None] += 1
        got |= {(left0 + c // width, right0 + c % width): n for c, n in zip(*(x.tolist() for x in t.counted()))}
    assert got == want and len(kinds) == 2


def test_bands_hold_equal_shares(spark, monkeypatch):
    monkeypatch.setattr(phrases, "TILE_PLACES", 100)
    rows = [("en", f"w{i}", 2_000 // (i + 1)) for i in range(1_000)] + [("de", "x", 5), ("de", "y", 5)]
    df = spark.createDataFrame(rows, "lang string, text string, a long")
    level = phrases.ranked(df, "a", ["text"], "test-ranks").cache()
    by_id = {(r["lang"], r["id"]): r for r in level.collect()}
    places, want = {"en": sum(a for lang, _, a in rows if lang == "en"), "de": 10}, collections.Counter()
    for lang, text, a in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        r = by_id[lang, want[lang]]
        assert (r["text"], r["before"]) == (text, want[lang, "sum"])
        want[lang] += 1
        want[lang, "sum"] += a
    edges = {r["lang"]: r["edges"] for r in phrases.bands(level).collect()}
    assert edges["de"] == [0, 2]
    en = edges["en"]
    shares = [sum(by_id["en", i]["a"] for i in range(x, y)) / places["en"] for x, y in zip(en, en[1:])]
    assert en[0] == 0 and en[-1] == 1_000 and len(en) > 5 and max(shares[1:]) < 2 * max(shares[0], 1 / len(shares))


def test_chunks_are_bounded(monkeypatch):
    """A language's chunk closes at its size, and all when they are many."""
    monkeypatch.setattr(phrases, "CHUNK", 10)
    b = pd.DataFrame({"lang": ["a", "a", "b", "c", "d", "e", "a"] * 3, "text": ["one two three. One"] * 21})
    out = pd.concat(phrases._chunks(iter([b])))
    assert out["ids"].map(lambda x: len(x) // 4).max() <= 16
    words = collections.Counter()
    for ws, n in zip(out["words"], out["counts"]):
        words.update(dict(zip(ws, n.tolist())))
    assert words == {"one": 42, "two": 21, "three": 21}


def test_collocations_oracle(spark):
    _oracle(spark, "op13_collocations", "documents")


def _oracle(spark, name, table):
    import duckdb

    from shelfcast.llm import queries
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_SMALL}/{table}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cur.description]
    want = collections.Counter(cur.fetchall())
    got = queries.QUERIES[name](spark, SF_SMALL)
    assert sorted(columns) == sorted(got.columns)
    assert collections.Counter(tuple(r[c] for c in columns) for r in got.collect()) == want and want


def test_queries_searched_together_find_the_same(monkeypatch):
    """Counting by places or by members, together or alone: the same hits; and
    windows of one round are looked up once a line, not once a query."""
    rng = np.random.default_rng(11)
    vectors = np.concatenate([rng.standard_normal((700, 24)), rng.standard_normal((1, 24)) + 0.01 * rng.standard_normal((50, 24))])
    queries, owns = [*vectors[:40], vectors[720] * 3], [np.array([i]) for i in range(40)] + [np.zeros(0, dtype=np.int64)]
    found = []
    for dense in (0, 1, 10 ** 9):  # by members only, where the windows take in more than the block, by places only
        monkeypatch.setattr(ann, "DENSE", dense)
        index, lookups = ann.Index(vectors), []
        places = index._places
        index._places = lambda *x: lookups.append(1) or places(*x)
        found.append([(a.tolist(), s.tolist()) for a, s in index.search_all(queries, owns, 7)])
        assert len(lookups) < 2 * 25
        found.append([(a.tolist(), s.tolist()) for a, s in (index.search(q, o, 7) for q, o in zip(queries, owns))])
    assert all(f == found[0] for f in found) and all(len(a) >= 7 for a, _ in found[0])
