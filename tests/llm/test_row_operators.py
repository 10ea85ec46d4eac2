"""Operators that look at one text at a time, against plain Python."""

import collections
import hashlib
import re

from shelfcast.llm import licenses, pii, quality

SPLIT = re.compile(r"[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows(df):
    return [r.asDict() for r in df.collect()]


def by_text(df, docs):
    """Results with their texts; results of equal (doc_id, text) rows agree."""
    texts = collections.defaultdict(set)
    for r in docs.collect():
        texts[r["doc_id"]].add(r["text"])
    return [(next(iter(texts[r["doc_id"]])), r) for r in rows(df)]


def test_licenses_base(nasty, empty):
    found = by_text(licenses.scan(nasty), nasty)
    assert len(found) == nasty.count()
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for text, r in found:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
        assert r["n_words"] == len(words), text
        assert r["n_base"] == len(places), text
        starts = [i for i, _ in places]
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        base = sorted({label for _, label in places})
        assert r["base_labels"] == ",".join(base)
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and set(base) <= set(labels)
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(labels)
    assert licenses.scan(empty).count() == 0


def test_licenses_suppress_contained(spark):
    from tests.llm.conftest import documents
    texts = {"licensed under the GNU Lesser General Public License, version 3": "lgpl-3",
             "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3", "the Mozilla Public License 2.0 license": "mpl-2",
             "a Creative Commons Attribution ShareAlike license": "cc-by-sa", "no such thing": ""}
    got = [r["labels"] for r in rows(licenses.scan(documents(spark, list(texts))).orderBy("doc_id"))]
    assert got == list(texts.values())
    assert len(licenses.rules()) > 300


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def check_pii(docs):
    found = by_text(pii.find(docs), docs)
    assert len(found) == docs.count()
    for text, r in found:
        base = base_spans(text)
        for k in ("email", "ip", "card", "phone"):
            assert r[f"n_{k}"] == sum(x[0] == k for x in base), (k, text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), text
        assert r["spans"] == joined or r["spans"].startswith(joined), text
    return {t: r["spans"] for t, r in found}


def test_licenses_of_standard_notices(spark):
    """Full names that hold the keyword, versions apart from it, SPDX ids, and texts with a weak sign."""
    from tests.llm.conftest import documents
    texts = {
        "you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
        "the GNU General Public License as published by the Free Software Foundation; either version 2 of the License": "gpl-2",
        "under version 3 of the GNU General Public License": "gpl-3",
        "the GNU Lesser General Public License, version 2.1": "lgpl-2.1",
        "the terms of the GNU Affero General Public License": "agpl",
        "the GNU General Public License. 2. Redistributions": "gpl",
        "subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2",
        "the Eclipse Public License - v 2.0": "epl-2", "the European Union Public Licence": "eupl",
        "the Apache License 2.0": "apache-2", "the Common Development and Distribution License": "cddl",
        "the GNU Free Documentation License": "gfdl", "the Common Public License": "cpl", "Artistic License 2.0": "artistic-2",
        "released under a BSD variant": "bsd", "available under MPL 2.0": "mpl-2", "distributed under zlib": "zlib",
        "SPDX-License-Identifier: BSL-1.0": "boost", "SPDX-License-Identifier: PSF-2.0": "python",
        "released last year, available soon, the general public": "",
    }
    got = [r["labels"] for r in rows(licenses.scan(documents(spark, list(texts))).orderBy("doc_id"))]
    assert dict(zip(texts, got)) == texts


def test_license_hint_admits_every_rule():
    """Each rule's own words, the optional ones left out, pass the hint."""
    hint = re.compile(licenses.hint())
    for _, _, word, before, after, *_ in licenses.rules():
        plain = [re.sub(r"\(\?:\^\| \)|[$^]|\(\?: \|\$\)", "", x) for x in (before, after)]
        lead = [re.sub(r"\(\?:|\)\??|\?", "", x) for x in plain]
        for sep in (" ", "-- ", "\n"):
            assert hint.search(" ".join([lead[0], word, lead[1]]).strip().replace(" ", sep).upper()), (word, before, after)


def test_pii_base(nasty, empty):
    spans = check_pii(nasty)
    assert spans["konto DE89 3704 0044 0532 0130 00."].endswith("iban:6:33")
    assert spans["ssn 123-45-6789"] == "ssn:4:15" and spans["123-45-6789"] == ""
    assert pii.find(empty).count() == 0


def test_pii_documents(spark):
    check_pii(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_redact(spark, nasty):
    from tests.llm.conftest import documents
    docs = documents(spark, ["mail a@b.com or +1 947 555 7668!", None, "nothing", "a@b.com"])
    out = pii.redact(docs).orderBy("doc_id")
    assert out.columns == docs.columns
    assert [(r["text"], r["n_chars"]) for r in out.collect()] == [
        ("mail [EMAIL] or [PHONE]!", 24), (None, 0), ("nothing", 7), ("[EMAIL]", 7)]
    assert pii.redact(nasty).count() == nasty.count()


def test_quality_base(spark, nasty, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (5, None)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        found = by_text(quality.quality(nasty, some), nasty)
        assert len(found) == nasty.count()
        for text, r in found:
            words = SPLIT.findall(text or "")
            windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
            often = collections.Counter(windows)
            repeat = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
            lines = [x for x in (text or "").split("\n") if SPLIT.search(x)]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
                len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat)), text
            assert r["base_failed"] == (len(words) < 50 or 100 * len(repeat) > 50 * len(words))
            assert not (r["base_failed"] and r["kept"])
    assert quality.quality(empty, labels).count() == 0
    kept = quality.filter_documents(nasty, labels)
    assert kept.columns == nasty.columns


def test_quality_model_is_monotone_and_sound():
    import numpy as np
    rng = np.random.default_rng(3)
    x = rng.random((1500, len(quality.FEATURES)))
    y = ((x[:, 1] + 0.3 * rng.random(1500)) < 0.7).astype(float)
    trees = quality.fit_trees(x[:1000], y[:1000])
    assert ((trees.score(x[1000:]) > 0.5) == y[1000:]).mean() > 0.85
    for f, (_, sign) in enumerate(quality.FEATURES):
        if sign:
            low, high = x[:200].copy(), x[:200].copy()
            low[:, f], high[:, f] = 0.2, 0.8
            assert (sign * (trees.score(high) - trees.score(low)) >= -1e-12).all()
