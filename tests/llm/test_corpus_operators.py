"""Operators that compare rows with each other, against brute force."""

import binascii
import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfcast.llm import ann, components, langid, mixing, pieces, repeats, simhash, warc
from tests.llm.conftest import NASTY, SF_SMALL, documents, prose

WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def keyed(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


# --- WARC -----------------------------------------------------------------

def pages(spark):
    big, other = "<p>é</p>" * 200, "x" * 1000
    rows = [(0, "http://a/", big), (1, None, big), (2, "http://c/\r\nX: y", big), (3, "u", "small"), (4, "u", "small"),
            (5, "u", None), (6, "u", ""), (7, "u", other), (8, "u", other[1:]), (9, "u", other[1:]), (None, "n", big),
            (10, "u", other), (10, "u", other), (11, "u", "WARC/1.1\r\n\r\n" * 200)]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def test_warc_round_trip_and_roles(spark):
    df, rows = pages(spark)
    index = warc.write(df.withColumn("digest", F.lit("clash")))
    got = warc.read(index).collect()
    assert len(got) == len(rows)
    top = collections.defaultdict(lambda: -1)
    for i, _, h in rows:
        top[h or ""] = max(top[h or ""], -1 if i is None else i)
    want = collections.Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        to = top[h or ""] if len(raw) >= 1000 and i != top[h or ""] else None
        want[i, hashlib.sha1(raw).hexdigest(), len(raw), "response" if to is None else "revisit", to] += 1
    assert collections.Counter((r["page_id"], r["digest"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["digest"] for r in got if r["payload"] is not None)
    # A selection is read by its ranges alone.
    some = warc.read(index.where("page_id IN (3, 11)")).collect()
    assert sorted(r["page_id"] for r in some) == [3, 11]
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_warc_oracle(spark):
    import duckdb
    from shelfcast.llm import queries
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{SF_SMALL}/pages.parquet'")
    want = duckdb.sql(queries.ORACLES["op2_warc"]).fetchall()
    got = [tuple(r) for r in queries.op2_warc(spark, SF_SMALL).collect()]
    assert sorted(got) == sorted(want)


# --- Mixing ---------------------------------------------------------------

def levels(sizes):
    """Targets by repeated resharing."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2 * sizes[s]
            open_.remove(s)
            left -= 2 * sizes[s]


def check_mix(docs):
    out = mixing.mix(docs)
    got = [tuple(r) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, (tuple(r) for r in mixing.mix(docs.repartition(5)).collect())))
    rows = docs.collect()
    assert len(got) == len(rows)
    size = lambda t: len(WORDS.findall(t or ""))
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += size(r["text"])
    want = levels(sizes)
    taken = collections.Counter()
    source = {r["doc_id"]: r["source"] for r in rows}
    for doc_id, n, source_size, target, took in got:
        s = source[doc_id]
        assert source_size == sizes[s] and target == pytest.approx(want[s])
        assert 0 <= took <= 2 * n
        taken[s] += took
    assert collections.Counter((r["doc_id"], size(r["text"])) for r in rows) == collections.Counter(x[:2] for x in got)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5


def test_mix(spark, nasty, empty):
    check_mix(nasty)
    check_mix(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    rng = random.Random(5)
    hot = [prose(rng, rng.randint(0, 900)) for _ in range(120)]
    rows = [(i, t, None, "hot" if i % 3 else f"s{i % 7}", len(t)) for i, t in enumerate(hot)]
    check_mix(spark.createDataFrame(rows, nasty.schema))
    assert mixing.mix(empty).count() == 0
    assert mixing.mix_documents(empty).count() == 0


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 100, 257):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("k"), F.lit(1)).alias("x")).collect()
        assert sorted(r["x"] for r in got) == list(range(n))


def test_mix_documents_hold_what_the_mix_takes(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(docs).collect()}
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    mixed = {r["doc_id"]: r for r in out.collect()}
    assert set(mixed) == {i for i, (_, n) in taken.items() if n}
    for i, r in mixed.items():
        words = WORDS.findall(r["text"])
        assert len(words) == taken[i][1] and r["n_chars"] == len(r["text"])
        assert set(words) <= set(WORDS.findall(texts[i]))
        if taken[i][1] == taken[i][0] and words == WORDS.findall(texts[i]) and r["text"] != texts[i]:
            assert " ".join(words) == r["text"]  # all of it, in two passes' pieces


# --- Repeats --------------------------------------------------------------

def check_repeats(docs):
    rows = docs.collect()
    raws = [(r["text"] or "").encode() for r in rows]
    count = collections.Counter(raw[k:k + 200] for raw in raws for k in range(len(raw) - 199))
    want = collections.Counter()
    for r, raw in zip(rows, raws):
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for k in range(len(raw) - 199):
            if count[raw[k:k + 200]] > 1:
                gone[k:k + 200] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
        want[r["doc_id"], len(raw), int(gone.sum()), spans, kept] += 1
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
                              for r in repeats.remove_repeats(docs).collect())
    assert got == want


def repeated_texts():
    rng = random.Random(9)
    shared, line = prose(rng, 90), prose(rng, 20)
    texts = [prose(rng, 60) + shared[rng.randint(0, 40):] + prose(rng, 30) for _ in range(6)]
    texts += [prose(rng, 50) + line + prose(rng, 50) for _ in range(12)]
    copy = prose(rng, 200)
    texts += [copy, copy, copy[:400] + "!" + copy[401:], copy[3:], "é" + copy[50:260] + "ü"]
    texts += ["ab" * 300, "ab" * 99 + "a", "ba" * 101, "x" * 1000, "x" * 200, "y" * 200, "y" * 199, "z" * 201, "0123456789" * 22]
    texts += [shared[:199], shared[:200], prose(rng, 70) * 2, prose(rng, 3000), None, ""]
    return texts


def test_repeats(spark, nasty, empty, monkeypatch):
    docs = documents(spark, repeated_texts(), [(2, None, None, None, None), (None, repeated_texts()[0], "x", "y", 1)])
    check_repeats(docs)
    check_repeats(docs.unionAll(docs.limit(4)))
    check_repeats(nasty)
    assert repeats.remove_repeats(empty).count() == 0
    # The same with every key split into windows, and with small chunks.
    monkeypatch.setattr(repeats, "GROUP_BYTES", 300)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 500)
    check_repeats(docs)


def test_matching_statistics():
    rng = random.Random(4)
    for t in range(20):
        texts = [bytes(rng.choices(b"ab" if t % 2 else b"abcd", k=rng.randint(1, 40))) for _ in range(rng.randint(1, 6))]
        got = repeats.matching_statistics(texts)
        starts = [(x, i) for x in range(len(texts)) for i in range(len(texts[x]))]
        for x, i in starts:
            best = 0
            for y, j in starts:
                if (x, i) != (y, j):
                    n = 0
                    while i + n < len(texts[x]) and j + n < len(texts[y]) and texts[x][i + n] == texts[y][j + n]:
                        n += 1
                    best = max(best, n)
            assert got[x][i] == best


# --- SimHash --------------------------------------------------------------

def plain_fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode("utf-8", "surrogatepass"), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(rows):
    """Smallest id reachable over links of 3 bits or fewer, by brute force."""
    prints = [plain_fingerprint(r["text"]) for r in rows]
    root = list(range(len(rows)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        ids = [x for x in (least.get(find(i)), r["doc_id"]) if x is not None]
        least[find(i)] = min(ids) if ids else None
    return [(r["doc_id"], f"{p:016x}", least[find(i)]) for i, (r, p) in enumerate(zip(rows, prints))]


def near_copies():
    rng = random.Random(2)
    texts = []
    for _ in range(12):
        base = prose(rng, 150).split()
        for _ in range(5):
            copy = base[:]
            copy[rng.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy))
    return texts


def test_near_duplicates(spark, nasty, empty):
    for docs in (nasty, documents(spark, near_copies()), spark.read.parquet(f"{SF_SMALL}/documents.parquet")):
        got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
        assert collections.Counter(got) == collections.Counter(classes(docs.collect()))
        kept = simhash.drop_near_duplicates(docs)
        assert kept.columns == docs.columns
        assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(
            {c for _, _, c in got})
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_links_lose_none(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    some = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(8)}
    signed = [x - (1 << 64) if x >> 63 else x for x in some]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "_fp long")).collect()}
    near = lambda a, b: ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3
    assert got == {(a, b) for a in signed for b in signed if a < b and near(a, b)}


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}


# --- Nearest neighbours ---------------------------------------------------

def test_nearest(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 24))
    x = np.vstack([centres[rng.integers(30, size=1200)] + 0.3 * rng.standard_normal((1200, 24)), rng.standard_normal((600, 24))])
    x *= rng.uniform(0.2, 3, size=(len(x), 1))
    x[50:90] = x[50]  # ties
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)]
    bad = [(20000, None, ""), (20020, [0.0] * 24, ""), (20040, [1.0, None] * 12, ""), (20060, [float("nan")] + [1.0] * 23, ""),
           (20080, [float("inf")] + [1.0] * 23, ""), (None, [1.0] * 24, ""), (40, x[40].tolist(), ""), (20100, [1.0, 2.0], ""), (20101, [1.0, 3.0], "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, _block string")
    monkeypatch.setattr(ann, "BLOCK", (700, 700))
    found = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 1800, 20)) | {20100}
    assert found[20100] == [(1, 20101, 7.0)]
    assert len(found.pop(40)) == 40  # two rows, each a query
    del found[20100]
    hits = total = 0
    ids = np.append(np.arange(len(x)), 40)
    every = np.vstack([x, x[40]])
    for q, got in found.items():
        assert [r for r, _, _ in got] == list(range(1, 21))
        scores = ann.inner(every, x[q])
        mine = scores.copy()
        mine[q] = -np.inf
        order = np.lexsort((ids, -mine))[:20]
        hits += len({(i, s) for _, i, s in got} & {(int(ids[o]), float(scores[o])) for o in order})
        total += 20
        assert [(s, -i) for _, i, s in got] == sorted(((s, -i) for _, i, s in got), reverse=True)
    assert hits / total >= 0.9
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# --- Pieces ---------------------------------------------------------------

def test_pieces_round_trip(spark, nasty, empty):
    texts = {(r["doc_id"], r["text"]) for r in nasty.collect()}
    out = pieces.encode(nasty, k=3)
    back = pieces.decode(out).collect()
    assert all(r["exact"] for r in back)
    assert {(r["doc_id"], r["text"]) for r in back} == {(i, t or "") for i, t in texts}
    by_id = collections.defaultdict(list)
    for r in back:
        by_id[r["doc_id"], r["text"]].append(r)
    for (_, text), found in by_id.items():
        copies = len(found) // len({r["rank"] for r in found})
        assert len({tuple(r["ids"]) for r in found}) * copies == len(found)
        best = sorted(found, key=lambda r: r["rank"])
        assert [r["perturbed"] for r in best] == sorted((r["perturbed"] for r in best), reverse=True)
        assert all(0 <= r["inclusion"] <= 1 and r["log_prob"] <= 1e-6 for r in found)
    assert pieces.encode(empty).count() == 0
    again = pieces.encode(nasty.repartition(3), k=3)
    assert again.exceptAll(out).count() == 0 and again.count() == out.count()


def test_pieces_sample_without_replacement():
    p = pieces.pieces(pieces.MODEL, 0.5)
    ids = {p.text[i]: i for i in range(len(p.text))}

    def every(rest, done=()):
        if not rest:
            yield done
        for n in range(1, len(rest) + 1):
            if rest[:n] in ids:
                yield from every(rest[n:], (*done, ids[rest[:n]]))
    paths = list(every(b" cats"))
    weight = np.array([np.exp(p.logp[list(x)].sum()) for x in paths])
    prob = dict(zip(paths, weight / weight.sum()))
    n, first, second = 20_000, collections.Counter(), collections.Counter()
    for found in pieces.sample(["cats"] * n, np.random.default_rng(0).integers(2 ** 62, size=n), 2, p):
        a, b = (tuple(int(i) for i in x[0]) for x in found)
        assert a != b and np.exp(found[0][1]) == pytest.approx(prob[a])
        first[a] += 1
        second[b] += 1
    for path, q in prob.items():
        two = sum(prob[o] * q / (1 - prob[o]) for o in prob if o != path)
        for seen, want in ((first[path] / n, q), (second[path] / n, two)):
            assert abs(seen - want) < 5 * np.sqrt(want * (1 - want) / n) + 1e-3


def test_pieces_inclusion_is_unbiased():
    """Over many keys, the mean of sum f / inclusion is the sum of f p."""
    p = pieces.pieces(pieces.MODEL, 0.5)
    n, total = 20_000, 0.0
    for found in pieces.sample(["cats"] * n, np.random.default_rng(1).integers(2 ** 62, size=n), 3, p):
        total += sum(np.exp(logp) / score for _, logp, _, score in found)
    assert total / n == pytest.approx(1.0, abs=0.02)


def test_pieces_branch_together(monkeypatch):
    """The second paths of all texts are drawn together, not text by text."""
    p, calls, plain = pieces.pieces(pieces.MODEL, 1.0), [], pieces._hash
    monkeypatch.setattr(pieces, "_hash", lambda *parts: calls.append(1) or plain(*parts))
    texts = [f"a cat number {i} \u4e2d\U0001f600 sat" for i in range(200)]
    found = pieces.sample(texts, np.arange(200), 2, p)
    assert len(calls) < 20 and all(len(f) == 2 for f in found)
    for i in (0, 7, 199):  # a text alone
        alone = pieces.sample([texts[i]], np.array([i]), 2, p)[0]
        assert [(a.tolist(), *x) for a, *x in alone] == [(a.tolist(), *x) for a, *x in found[i]]
        assert all(p.decode(np.asarray(ids)) == texts[i] for ids, *_ in alone)


def test_pieces_keep_large_ids_beside_null(spark):
    docs = spark.createDataFrame([(2 ** 53 + 1, "a cat"), (None, "a dog"), (5, None)], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in pieces.encode(docs, together=3).collect()} == {2 ** 53 + 1, None, 5}


# --- Language -------------------------------------------------------------

def test_language(spark, nasty, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = keyed(langid.identify(docs))
    held = right = 0
    for r in docs.collect():
        x = got[r["doc_id"]]
        assert x["held_out"] == (binascii.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= x["score"] <= 1
        held += x["held_out"]
        right += x["held_out"] and x["lang_pred"] == r["lang"]
    assert held > 200 and right / held > 0.97
    found = langid.identify(nasty)
    assert found.count() == nasty.count() and empty.count() == langid.identify(empty).count()
    for r in found.join(nasty.select("doc_id", "text"), "doc_id").collect():
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert r["lang_pred"] == "und" and r["score"] == 0
        else:
            assert r["lang_pred"] in ("en", "de")


def test_automaton_accepts_the_substrings():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 4, size=60)
    table = langid.automaton(text, 4)
    subs = {tuple(text[i:j]) for i in range(60) for j in range(i, 61)}
    for _ in range(2000):
        s, state = rng.integers(1, 4, size=rng.integers(1, 9)), 0
        for c in s:
            state = table[state, c] if state >= 0 else -1
        assert (state >= 0) == (tuple(s) in subs)


def test_cross_parsing_matches_greedy_phrases(monkeypatch):
    rng = random.Random(3)
    samples = (("a", prose(rng, 300)), ("b", prose(rng, 300, words=("xa", "yb", "zc", "qq"))))
    parser = langid.Parser(samples)
    texts = [prose(rng, n) + "Ж!9 " + prose(rng, n) for n in (0, 1, 40, 300)] + ["", "9"]
    got = parser.phrases(texts)
    for t, found in zip(texts, got):
        plain = langid.plain(t)
        for j, (_, text) in enumerate(samples):
            source, n = langid.plain(text), 0
            for k in range(0, len(plain), langid.SEGMENT):
                rest = plain[k:k + langid.SEGMENT]
                while rest:
                    m = 0
                    while m < len(rest) and rest[:m + 1] in source:
                        m += 1
                    # A character that the sample lacks ends a phrase, and none begins with it.
                    rest, n = rest[max(m, 1):], n + 1
            assert found[j] == n, (t, plain)


def test_parser_knows_every_character_of_many_scripts():
    rng = random.Random(4)
    scripts = {"en": (0x61, 26), "ru": (0x430, 32), "el": (0x3B1, 24), "ar": (0x628, 30), "ja": (0x4E00, 900), "zh": (0x7000, 900)}

    def text(lang, n):
        first, size = scripts[lang]
        return "".join(" " if rng.random() < 0.1 else chr(first + min(int(rng.expovariate(6 / size)), size - 1)) for _ in range(n))
    samples = tuple((k, text(k, 3000)) for k in sorted(scripts))
    parser = langid.Parser(samples)
    assert len(parser.points) == len(set("".join(langid.plain(t) for _, t in samples))) > 500
    texts = [samples[k % 6][1][40 * k:40 * k + 30] + text(lang, 60) for k, lang in enumerate(sorted(scripts) * 3)]
    for t, found in zip(texts, parser.phrases(texts)):
        plain = langid.plain(t)
        for j, (_, sample) in enumerate(samples):
            source, rest, n = langid.plain(sample), plain, 0
            while rest:
                m = 0
                while m < len(rest) and rest[:m + 1] in source:
                    m += 1
                rest, n = rest[max(m, 1):], n + 1
            assert found[j] == n, (t, plain)
    own = [text(lang, 200) for lang in sorted(scripts)]
    assert parser.predict(own)[0] == sorted(scripts)


def test_moves_hold_every_transition(monkeypatch):
    rng = np.random.default_rng(5)
    text = rng.integers(1, 300, size=2000)
    states, source, code, to = langid.transitions(text)
    for tries in (langid.Moves.TRIES, 0):
        monkeypatch.setattr(langid.Moves, "TRIES", tries)
        moves = langid.Moves(states, 300, source, code, to)
        assert (moves[source, code] == to).all()
        known = set(zip(source.tolist(), code.tolist()))
        s, c = rng.integers(0, states, size=5000), rng.integers(0, 300, size=5000)
        assert [x >= 0 for x in moves[s, c].tolist()] == [k in known for k in zip(s.tolist(), c.tolist())]


def test_nasty_texts_are_whole():
    assert any(len(t or "") > 10_000 for t in NASTY)
