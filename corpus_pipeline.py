"""The corpus pipeline (part of subpackage llm).

documents -> quality rules -> SimHash near-dedup -> PII redaction -> source mix
-> sampled SentencePiece segmentations.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  The first four
return the columns of `docs`: a quality stage without the texts it rejects, one
document of each near-duplicate class, texts with personal data replaced, and
the texts that the mix takes (its pieces of a text, pass after pass).  The last
one returns the token ids: `doc_id, rank, ids, log_prob, perturbed, inclusion,
exact`.  `run` writes every stage's result as Parquet in the session's shared
folder and reads it again for the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfcast.llm import mixing, pieces, pii, quality, simhash
from shelfcast.session import materialize, ship_package
from shelfcast.sources.tables import read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality.filter_documents(docs, read_table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.drop_near_duplicates(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    # Workers here hold memory of earlier stages, too: smaller steps.
    return pieces.encode(docs, together=500_000)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mix", mix_stage),
    ("pieces", pieces_stage),
]

# Trees, permutations and sampled paths are beyond SQL; the tests hold every
# stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
