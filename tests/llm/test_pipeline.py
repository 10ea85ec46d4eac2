"""The corpus pipeline, stage by stage, and the queries' registration."""

import collections
import importlib
import sys

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from shelfcast.llm import mixing, pieces, pii, quality
from shelfcast.session import materialize
from tests.llm.conftest import SF_SMALL
from tests.llm.test_corpus_operators import classes

NAMES = ["quality", "near_dedup", "pii", "mix", "pieces"]


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns on the small documents, read back from Parquet."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF_SMALL), f"test-{name}"))
    return out


def test_stages_are_named_and_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def test_quality_stage(spark, stages):
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality(
        stages[0], spark.read.parquet(f"{SF_SMALL}/labels.parquet")).collect()}
    kept = {r["doc_id"]: r for r in stages[1].collect()}
    assert set(kept) == {i for i, k in verdict.items() if k} and 0 < len(kept) < len(verdict)
    assert all(kept[r["doc_id"]] == r for r in stages[0].collect() if r["doc_id"] in kept)


def test_near_dedup_stage(stages):
    before = stages[1].collect()
    least = {c for _, _, c in classes(before)}
    assert {r["doc_id"]: r for r in stages[2].collect()} == {r["doc_id"]: r for r in before if r["doc_id"] in least}


def test_pii_stage(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    spans = {r["doc_id"]: r["spans"] for r in pii.find(stages[2]).collect()}
    for r in stages[3].collect():
        at, out = 0, []
        for kind, a, z in sorted((x.split(":") for x in spans[r["doc_id"]].split(",") if x), key=lambda s: (int(s[1]), int(s[2]))):
            if int(a) >= at:
                out += [before[r["doc_id"]][at:int(a)], f"[{kind.upper()}]"]
            at = max(at, int(z))
        assert r["text"] == "".join(out) + before[r["doc_id"]][at:]
        assert r["n_chars"] == len(r["text"])
    assert any(spans.values()) and len(spans) == stages[3].count()


def test_mix_stage(stages):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(stages[3]).collect()}
    words = {r["doc_id"]: len(r["text"].split()) for r in stages[4].collect()}
    assert words == {i: n for i, n in taken.items() if n}


def test_pieces_stage(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    got = collections.Counter()
    for r in pieces.decode(stages[5]).collect():
        assert r["text"] == texts[r["doc_id"]] and r["exact"]
        got[r["doc_id"]] += 1
    assert set(got) == set(texts) and set(got.values()) <= {1, 2}


def test_run_gives_the_last_stage(spark, stages):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.exceptAll(stages[-1]).count() == 0 and out.count() == stages[-1].count()


def test_stages_take_nasty_and_empty_tables(spark, nasty, empty):
    for docs in (nasty, empty):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_SMALL)
            assert out.count() >= 0
            docs = docs if stage is corpus_pipeline.STAGES[-1][1] else materialize(out, "test-nasty")


def test_entry_registers_every_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in entry.queries()


def test_entry_works_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "shelfcast.llm", None)
    fresh = importlib.reload(entry)
    assert "demand_panel" in fresh.queries() and not any(n.startswith("op") for n in fresh.queries())
    assert fresh.oracle_sql()
