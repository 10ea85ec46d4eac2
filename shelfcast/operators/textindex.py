"""TF-IDF retrieval over an inverted index with max-score pruning.

The index is a table: documents are dealt into shards of a bounded number of
postings, and each shard holds its documents' ids and the norms of their vectors
and, for each of its terms, the documents with that term, by place, and its
counts in them.  The impact of a term on a document is its count over the
document's norm; its idf comes with the queries.  A search reads the postings of
the queries' own terms, once, whatever the number of queries; queries are copied
once a shard.  No posting is shuffled alone: texts are counted in their rows, and
go to the shards as such rows.

In a shard, a query takes its terms by the most that each can add to a score.
Once the k-th best score passes what all further terms can add together, only
documents met so far can still enter the k best: of the further postings no more
is read than those documents' places, and documents leave as soon as what is
left to add cannot lift them to the k-th best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.exprs import term_counts
from shelfcast.session import materialize

POSTINGS = 500_000  # postings a shard, about
QUERIES = 500
COMMON = 20_000  # terms whose idf goes to every task
# Scores are compared after rounding to 6 dp: nothing this near is pruned.
MARGIN = 2e-6


@dataclass(frozen=True)
class TextIndex:
    """`postings` (shard, term, places, tfs), and of each shard a row (shard, ids,
    norms) that the places refer to, its term null; `idf` (term, idf)."""
    postings: DataFrame
    idf: DataFrame
    n_docs: int
    shards: int
    id_col: str


def staged_terms(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, terms): texts are tokenised once; terms are counted within each row."""
    return materialize(texts.select(id_col, term_counts(text_col).alias("terms")), "terms")


def _rows(terms: DataFrame, id_col: str) -> DataFrame:
    return terms.select(id_col, F.explode("terms").alias("t")).select(id_col, "t.term", "t.tf")


def weighted(terms: DataFrame, idf: DataFrame, id_col: str, unknown: float) -> DataFrame:
    """(id, terms, weights): the terms of a row's TF-IDF vector, joined by spaces,
    and their shares of the unit vector times their idf.  A term that `idf` lacks
    has the idf `unknown`."""
    rows = (_rows(terms, id_col).join(idf, "term", "left").withColumn("idf", F.coalesce("idf", F.lit(unknown)))
            .groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("term", (F.col("tf") * F.col("idf")).alias("w"), "idf"))).alias("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    return rows.select(id_col, "v", norm.alias("norm")).select(
        id_col, F.array_join(F.transform("v", lambda x: x["term"]), " ").alias("terms"),
        F.transform("v", lambda x: x["w"] / F.col("norm") * x["idf"]).alias("weights"))


def norms(terms: DataFrame, idf: DataFrame, id_col: str) -> DataFrame:
    """(id, norm) of the TF-IDF vectors.  The `COMMON` most frequent terms, most
    of all postings, are a broadcast of that many rows, and their squares are
    summed where they are; only the other terms are joined by term."""
    rows = _rows(terms, id_col)
    head = F.broadcast(idf.orderBy("idf", "term").limit(COMMON))
    squares = lambda df: df.groupBy(id_col).agg(F.sum(F.pow(F.col("tf") * F.col("idf"), 2)).alias("s"))
    both = squares(rows.join(head, "term")).unionByName(squares(rows.join(head, "term", "left_anti").join(idf, "term")))
    return both.groupBy(id_col).agg(F.sqrt(F.sum("s")).alias("norm"))


def build(corpus: DataFrame, id_col: str, text_col: str = "text", postings: int = POSTINGS) -> TextIndex:
    """Smooth idf = ln((1 + N) / (1 + df)) + 1 over the N ids of the corpus.
    Counted texts are dealt to the shards once, a row a text.  A null id is
    counted, but never found."""
    terms = staged_terms(corpus, id_col, text_col)
    size = terms.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    n_docs = terms.select(id_col).distinct().count()
    df = _rows(terms, id_col).groupBy("term").agg(F.count("*").alias("df"))
    idf = materialize(df.select("term", (F.log((1.0 + F.lit(n_docs)) / (1.0 + F.col("df"))) + 1.0).alias("idf")), "idf")
    shards = max(1, -(-size // postings))
    kind = corpus.schema[id_col].dataType.simpleString()

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard, rows in _runs(batches, "shard"):
            docs, texts = rows[rows["terms"].isna()], rows[rows["terms"].notna()]
            ids = docs[id_col].to_numpy()
            yield pd.DataFrame({"shard": shard, "term": None, "ids": [ids], "norms": [docs["norm"].to_numpy()], "places": None, "tfs": None})
            code, terms = pd.factorize(np.array(" ".join(texts["terms"]).split(" "), dtype=object))
            place = np.repeat(pd.Index(ids).get_indexer(texts[id_col]).astype(np.int32), texts["tfs"].map(len))
            tf = np.concatenate(texts["tfs"].to_numpy())
            order = np.lexsort((tf, place, code))
            cuts = np.flatnonzero(np.diff(code[order])) + 1
            yield pd.DataFrame({"shard": shard, "term": terms, "ids": None, "norms": None,
                                "places": np.split(place[order], cuts), "tfs": np.split(tf[order], cuts)})

    shard = F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int").alias("shard")
    none = F.lit(None)
    texts = terms.where(F.col(id_col).isNotNull() & (F.size("terms") > 0)).select(
        shard, id_col, none.cast("double").alias("norm"), F.array_join(F.transform("terms", lambda t: t["term"]), " ").alias("terms"),
        F.transform("terms", lambda t: t["tf"].cast("int")).alias("tfs"))
    docs = norms(terms, idf, id_col).where(F.col(id_col).isNotNull()).select(
        shard, id_col, "norm", none.cast("string").alias("terms"), none.cast("array<int>").alias("tfs"))
    made = (docs.unionByName(texts).repartition("shard").sortWithinPartitions("shard", id_col)
            .mapInPandas(invert, f"shard int, term string, ids array<{kind}>, norms array<double>, places array<int>, tfs array<int>"))
    return TextIndex(materialize(made, "postings"), idf, n_docs, shards, id_col)


def _runs(batches: Iterator[pd.DataFrame], column: str) -> Iterator[tuple]:
    """(value, rows) of each run of equal values of a sorted column."""
    held: list[pd.DataFrame] = []
    for b in batches:
        values = b[column].to_numpy()
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        for i, j in zip(np.append(0, cuts), np.append(cuts, len(b))):
            if i == j:
                continue
            if held and held[-1][column].iloc[-1] != values[i]:
                yield held[-1][column].iloc[-1], pd.concat(held)
                held = []
            held.append(b.iloc[i:j])
    if held:
        yield held[-1][column].iloc[-1], pd.concat(held)


class Shard:
    """The postings of one shard."""

    def __init__(self, terms, ids, impacts, largest) -> None:
        lengths = [len(x) for x in ids]
        code, self.ids = pd.factorize(np.concatenate(list(ids)) if lengths else np.zeros(0), sort=True)
        cuts = np.cumsum(lengths)[:-1]
        self.lists = {t: (d, np.asarray(x), m) for t, d, x, m in zip(terms, np.split(code, cuts), impacts, largest)}

    def search(self, terms, weights, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places in `ids` and scores of the documents that may be among the k
        best, and the postings read for them."""
        own = sorted(((w * self.lists[t][2], w, *self.lists[t][:2]) for t, w in zip(terms, weights) if t in self.lists),
                     key=lambda x: -x[0])
        left = np.append(np.cumsum([x[0] for x in own][::-1])[::-1], 0.0)  # what terms from here on can add
        score, met = np.zeros(len(self.ids)), np.zeros(len(self.ids), dtype=bool)
        bar, read, i = -np.inf, 0, 0
        while i < len(own) and left[i] + MARGIN >= bar:
            _, w, at, impact = own[i]
            score[at] += w * impact
            met[at] = True
            read, i = read + len(at), i + 1
            bar = self._kth(score[met], k)
        some = np.flatnonzero(met)
        while True:
            some = some[score[some] + left[i] + MARGIN >= bar]
            if i == len(own):
                return some, score[some], read
            _, w, at, impact = own[i]
            place = np.minimum(np.searchsorted(at, some), len(at) - 1)
            hit = at[place] == some
            score[some[hit]] += w * impact[place[hit]]
            read, i = read + len(some), i + 1
            bar = max(bar, self._kth(score[some], k))

    @staticmethod
    def _kth(scores: np.ndarray, k: int) -> float:
        return -np.inf if len(scores) < k else float(np.partition(scores, len(scores) - k)[len(scores) - k])


def search(index: TextIndex, queries: DataFrame, query_id: str, k: int, text_col: str = "text") -> DataFrame:
    """(query_id, rank, id, score): the k documents of largest cosine of each
    query, of those that share a term with it; scores are rounded to 6 dp, ties go
    to the smaller id.  A query term that no document has weighs the idf of df = 0."""
    id_col = index.id_col
    asked = materialize(weighted(staged_terms(queries, query_id, text_col), index.idf, query_id,
                                 float(np.log(1.0 + index.n_docs) + 1.0)), "asked")
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, query_id),)}
    id_kind = index.postings.schema["ids"].dataType.elementType.simpleString()
    wanted = asked.select(F.explode(F.split("terms", " ")).alias("term")).distinct()
    of = lambda name, kind, df: F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)
    columns = {"shard": "int", "ask": "int", "term": "string", "ids": f"array<{id_kind}>", "norms": "array<double>",
               "places": "array<int>", "tfs": "array<int>", "_query": kinds[query_id], "terms": "string", "weights": "array<double>"}
    lists = index.postings.where("term IS NOT NULL").join(wanted, "term", "left_semi").unionByName(
        index.postings.where("term IS NULL")).withColumn("ask", F.lit(0))
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(index.shards - 1))).alias("shard"), F.lit(1).alias("ask"),
                         F.col(query_id).alias("_query"), "terms", "weights")
    both = lists.select(*(of(c, t, lists) for c, t in columns.items())).unionByName(
        every.select(*(of(c, t, every) for c, t in columns.items())))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, shard, ids = None, [], None, None
        for b in batches:
            keys = b[["shard", "ask"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for i, j in zip(np.append(0, cuts), np.append(cuts, len(b))):
                if i == j:
                    continue
                number, ask = keys[i]
                if number != now:
                    now, held, shard = number, [], None
                if not ask:
                    held.append(b.iloc[i:j])
                    continue
                if shard is None:
                    own = pd.concat(held) if held else b.iloc[:0]
                    docs, own, held = own[own["term"].isna()], own[own["term"].notna()], []
                    # Places follow the ids' order.
                    ids, sizes = (np.concatenate([np.asarray(x) for x in docs[c]] or [np.zeros(0)]) for c in ("ids", "norms"))
                    impacts = [np.asarray(tf) / sizes[at] for at, tf in zip(own["places"], own["tfs"])]
                    shard = Shard(own["term"], own["places"], impacts, [x.max() for x in impacts])
                out = []
                for q, terms, weights in zip(*(b[c].iloc[i:j] for c in ("_query", "terms", "weights"))):
                    at, scores, _ = shard.search(terms.split(" "), weights, k)
                    scores = np.floor(scores * 1e6 + 0.5) / 1e6
                    best = np.lexsort((at, -scores))[:k]
                    out += [(q, ids[shard.ids[at[x]]], scores[x]) for x in best]
                yield pd.DataFrame(out, columns=[query_id, id_col, "score"])

    found = (both.repartition("shard").sortWithinPartitions("shard", "ask")
             .mapInPandas(run, f"{query_id} {kinds[query_id]}, {id_col} {id_kind}, score double"))
    by = Window.partitionBy(query_id).orderBy(F.col("score").desc(), F.col(id_col))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(query_id, "rank", id_col, "score")
