"""Clashing names, hostile numbers, hot copies, and the rules' own labels."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfcast.llm import ann, langid, licenses, mixing, pieces, pii, quality, simhash
from tests.llm.conftest import NASTY, documents, prose

CLASHES = ("_key", "_size", "_pieces", "_text", "_clean", "_pii_email", "doc", "hit", "_s", "_fp", "clean", "_r", "_left", "rank")


def clashing(df):
    for c in CLASHES:
        df = df.withColumn(c, F.concat(F.lit(f"own {c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return df


def some_documents(spark):
    rng = random.Random(11)
    return documents(spark, [*NASTY, *(prose(rng, rng.randint(1, 120)) for _ in range(60)), *[prose(random.Random(1), 80)] * 4])


def labels(spark, n=110):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(n)], "doc_id long, quality int, toxic int")


FILTERS = {
    "quality": lambda df, lab: quality.filter_documents(df, lab), "near_dedup": lambda df, _: simhash.drop_near_duplicates(df),
    "pii": lambda df, _: pii.redact(df), "mix": lambda df, _: mixing.mix_documents(df)}


@pytest.mark.parametrize("name", sorted(FILTERS))
def test_filters_pass_clashing_columns_through(spark, name):
    df, lab = some_documents(spark), labels(spark)
    want = {r["doc_id"]: r for r in FILTERS[name](df, lab).collect()}
    got = FILTERS[name](clashing(df), lab)
    assert got.columns == [*df.columns, *CLASHES]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows.keys() == want.keys() and rows
    for i, r in rows.items():
        assert all(r[c] == want[i][c] for c in df.columns)
        assert all(r[c] == f"own {c} {'-' if i is None else i}" for c in CLASHES)


OPERATORS = {
    "licenses": (licenses.scan, ("doc_id",)), "mix": (mixing.mix, ("doc_id",)), "simhash": (simhash.near_duplicates, ("doc_id",)),
    "quality": (lambda df: quality.quality(df, labels(df.sparkSession)), ("doc_id",)),
    "pieces": (pieces.encode, ("doc_id", "rank")), "langid": (langid.identify, ("doc_id",)), "pii": (pii.find, ("doc_id",))}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_ignore_clashing_columns(spark, name):
    df = some_documents(spark)
    run, key = OPERATORS[name]
    strip = lambda rows: collections.Counter(repr(r) for r in rows)
    assert strip(run(clashing(df)).collect()) == strip(run(df).collect())


def test_every_stage_passes_clashing_columns(spark):
    docs = clashing(some_documents(spark))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert all(r["_text"] == f"own _text {'-' if r['doc_id'] is None else r['doc_id']}" for r in out.collect()), name


def test_vectors_that_overflow_or_vanish(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 5))
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(x, np.resize([1e200, 1e-200, 1.0], 60)))]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect()
    assert collections.Counter(r["query_id"] for r in got) == {0: 5, 20: 5, 40: 5}
    for r in got:
        with np.errstate(over="ignore"):
            want = float(ann.inner(np.array([rows[r["vec_id"]][1]]), np.array(rows[r["query_id"]][1]))[0])
        assert r["score"] is None if math.isnan(want) else r["score"] == want or math.isclose(r["score"], want)


def test_more_segmentations_than_a_step_holds(spark):
    docs = spark.createDataFrame([(1, "unbelievable international responsibilities " * 3), (2, "a"), (3, None)], "doc_id long, text string")
    rows = pieces.encode(docs, k=100).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert len(by[1]) == 100 and len({tuple(r["ids"]) for r in by[1]}) == 100 and all(r["exact"] for r in by[1])
    assert [r["rank"] for r in sorted(by[1], key=lambda r: r["rank"])] == list(range(1, 101))
    texts = pieces.decode(pieces.encode(docs, k=100)).where("doc_id = 1").select("text").distinct().collect()
    assert [r["text"].strip() for r in texts] == [("unbelievable international responsibilities " * 3).strip()]


# --- language samples ---------------------------------------------------------

def test_samples_fill_up_with_short_texts(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 10) + f" t{i}", "xx", None, 0) for i in range(1_000)]
    rows += [(5_000 + i, "the same words once more", "yy", None, 0) for i in range(64)]
    rows += [(6_000 + i, prose(rng, 30), "yy", None, 0) for i in range(200)]
    docs = documents(spark, [], rows)
    found = dict(langid.samples(docs, sample_chars=12_000))
    assert len(found["xx"]) == 12_000 and found["yy"].count("the same words once more") <= 1 and len(found["yy"]) > 8_000
    assert langid.samples(docs) == langid.samples(docs.orderBy(F.rand(5)).repartition(7))


@pytest.mark.parametrize("text", ["²", "½ ①", "Ⅷ", "123 _ -", "", "๑๒๓", "‿"])
def test_texts_without_letters(spark, text):
    docs = documents(spark, [], [(i, prose(random.Random(i), 40), "xx", None, 0) for i in range(40)] + [(99, text, "xx", None, 0)])
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert (got[99]["lang_pred"], got[99]["score"]) == ("und", 0.0) and got[1]["lang_pred"] == "xx"


def test_marks_stay_with_their_letters():
    assert langid.plain("कि ภาษาไทย é") == "कि ภาษาไทย é" and langid.plain("a²b Ⅷc_d") == "a b c d"


# --- quality: the bound of the fit ------------------------------------------------

def test_a_repeated_document_counts_once_in_the_fit(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, prose(rng, 60 + i), "en", None, 0) for i in range(60)]
    docs, hot = documents(spark, [], rows), documents(spark, [], [*rows, *[rows[5]] * 30])
    seen = []
    real = quality.fit_trees
    monkeypatch.setattr(quality, "fit_trees", lambda x, y, *a: seen.append(len(y)) or real(x, y, *a))
    one, two = quality.fit(docs, labels(spark)), quality.fit(hot, labels(spark))
    assert seen == [60, 60] and all(np.array_equal(a, b) for a, b in ((one.feature, two.feature), (one.value, two.value)))
    quality.fit(hot, labels(spark), max_rows=10)
    assert seen[-1] <= 10


# --- mixing: many sources -----------------------------------------------------------

def test_sources_are_never_one_task(spark):
    import contextlib
    import io
    rng = random.Random(9)
    docs = documents(spark, [], [(i, prose(rng, rng.randint(0, 90)), "en", f"http://s{rng.randint(0, 300)}/", 0) for i in range(500)])
    buf = io.StringIO()
    rows = mixing.sizes(docs)
    with contextlib.redirect_stdout(buf):
        mixing.running(rows.groupBy("_s").agg(F.sum("size").alias("n")), [F.col("_s")], {"n": "before"}, "test").explain()
    # The only window over all rows reads a row a partition.
    assert "rangepartitioning" not in buf.getvalue() or buf.getvalue().count("SinglePartition") <= 1
    goals = {r["_s"]: r for r in mixing.targets(rows).collect()}
    sizes = {r["_s"]: r["n"] for r in rows.groupBy("_s").agg(F.sum("size").alias("n")).collect()}
    order = sorted(sizes)
    want, capped = {}, set()
    total = 1.5 * sum(sizes.values())
    while True:
        w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order) if s not in capped}
        left = total - sum(2 * sizes[s] for s in capped)
        want = {s: left * x / sum(w.values()) for s, x in w.items()}
        over = {s for s, t in want.items() if t > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    want |= {s: 2.0 * sizes[s] for s in capped}
    assert goals.keys() == want.keys() and len(want) > 200
    assert all(math.isclose(goals[s]["target"], t, rel_tol=1e-9, abs_tol=1e-6) for s, t in want.items())
    first, slots = 0, sum(r["_quota"] for r in goals.values())
    for s in order:
        assert (goals[s]["_first"], goals[s]["_slots"]) == (first, slots)
        first += goals[s]["_quota"]


def broadcast_by(df):
    """The keys of the broadcast joins that the planner takes before anything has run."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan
    return {tuple(re.findall(r"(\w+)#", keys)) for keys in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan)}


def test_mix_documents_broadcasts_no_slots(spark):
    # A slot takes a byte in the staged table and 70 in a broadcast, and a row
    # unrolls to any number of them: the planner's sizes say nothing of either.
    rng = random.Random(3)
    docs = documents(spark, [], [(i, prose(rng, 600), "en", f"s{i % 4}", 0) for i in range(100)])
    out = mixing.mix_documents(docs)
    assert broadcast_by(out) <= {("_shard", "_s")}
    assert sum(len(r["text"].split()) for r in out.collect()) == 90_000


def test_mix_broadcasts_neither_slots_nor_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    rng = random.Random(4)
    docs = documents(spark, [], [(i, prose(rng, rng.randint(0, 90)), "en", f"http://s{i}/" if i % 2 else "hot", 0) for i in range(300)])
    rows = mixing.sizes(docs)
    goals = mixing.targets(rows)
    assert broadcast_by(mixing.draws(goals)) <= {("_shard", "_s")}
    ends = collections.Counter()
    for r in sorted(mixing.place(rows, goals).collect(), key=lambda r: (r["_s"], r["_start"], r["size"])):
        assert r["_start"] == ends[r["_s"]]
        ends[r["_s"]] += r["size"]
    want = {r["_s"]: r["target"] for r in goals.collect()}
    assert ends == {r["_s"]: r["source_size"] for r in goals.collect()} and len(want) == 151
    taken = collections.Counter()
    for r in mixing.mix(docs).collect():
        taken[f"0http://s{r['doc_id']}/" if r["doc_id"] % 2 else "0hot"] += r["taken"]
    assert all(abs(taken[s] - t) <= 0.5 for s, t in want.items())


# --- personal data: added spans --------------------------------------------------------

def mod97(value):
    packed = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def with_check(country, body):
    for check in range(2, 99):
        if mod97(f"{country}{check:02d}{body}"):
            return f"{country}{check:02d}{body}"
    raise AssertionError(country)


def test_ibans_of_every_length(spark):
    rng, texts, want = random.Random(4), [], []
    for length, countries in pii.IBAN_LENGTHS.items():
        for country in countries.split():
            iban = with_check(country, "".join(rng.choices("0123456789", k=length - 4)))
            spaced = " ".join(iban[i:i + 4] for i in range(0, length, 4))
            texts += [f"pay {iban} BANK", f"{spaced} BANK and 7", f"x{iban}", f"{iban}X", f"{iban[:-1]} "]
            want += [f"iban:4:{4 + length}", f"iban:0:{len(spaced)}", "", "", ""]
    texts.append("ES91 2100 0418 4502 0005 1332 BANK")
    want.append("iban:0:29")
    got = {r["doc_id"]: r["spans"] for r in pii.find(documents(spark, texts)).collect()}
    ibans = [",".join(s for s in got[i].split(",") if s.startswith("iban")) for i in range(len(texts))]
    assert ibans == want


def test_context_on_both_sides(spark):
    texts = ["123-45-6789 is my ssn", "ssn 123-45-6789", "123-45-6789", "123-45-6789" + " x" * 30 + " ssn", "ssn 000-12-3456"]
    got = {r["doc_id"]: r["spans"] for r in pii.find(documents(spark, texts)).collect()}
    assert [got[i] for i in range(5)] == ["ssn:0:11", "ssn:4:15", "", "", ""]


# --- licenses: a plain engine -------------------------------------------------------------

def plain_labels(text):
    words = [w for w in re.split(licenses.SEPARATOR, (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))) if w]
    found, base = [], set()
    count = lambda m: len(m.group().split()) if m else 0
    for p, word in enumerate(words):
        left, right = " ".join(words[max(0, p - licenses.REACH):p]), " ".join(words[p + 1:p + 1 + licenses.REACH])
        for i, label, key, before, after, priority, _, is_base in licenses.rules():
            if key != word:
                continue
            a, b = re.search(before, left) if before else None, re.search(after, right) if after else None
            if (before and not a) or (after and not b):
                continue
            found.append((p - count(a), -(p + 1 + count(b)), -priority, i, label))
            base |= {label} if is_base else set()
    kept = set(base)
    best = {1: -1, 2: -1, 3: -1}
    for start, end, priority, _, label in sorted(found):
        if max(best[k] for k in best if -priority <= k) < -end:
            kept.add(label)
        best[-priority] = max(best[-priority], -end)
    return ",".join(sorted(kept))


PHRASES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND": "as-is",
    "GPL-2.0-or-later": "gpl-2", "GPLv3": "gpl-3", "CC0 1.0 Universal": "cc0", "CC BY 4.0": "cc-by",
    "under cc by sa 4.0": "cc-by-sa", "Licensed under the MIT license and GPL": "gpl,mit",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "released under the artistic director": "", "distributed under the boost of demand": "", "available under the python directory": "",
    "released under the Artistic License": "artistic", "distributed under the Boost Software License": "boost",
    "available under the Python Software Foundation license": "python", "LGPL-2.1-only": "lgpl-2.1", "AGPLv3": "agpl-3",
    "Licensed under the GNU Lesser General Public License v3": "lgpl-3", "nothing of the kind, by charge of the binary": "",
}


def test_license_phrases(spark):
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(documents(spark, list(PHRASES))).collect()}
    assert {t: got[i] for i, t in enumerate(PHRASES)} == PHRASES


def test_license_rules_match_a_plain_engine(spark):
    rng = random.Random(6)
    parts = [*PHRASES, "and", "or", "the", "license", "version 2", "under the mit license", "apache license version 2", "cc by nc", "v2", "GNU GPL"]
    texts = [*NASTY, *(" ".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(150))]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(documents(spark, texts)).collect()}
    wrong = [(t, got[i], plain_labels(t)) for i, t in enumerate(texts) if got[i] != plain_labels(t)]
    assert wrong == []
