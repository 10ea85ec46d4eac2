"""Vector and TF-IDF retrieval with complete top-k, plus retrieval prompts.

Exact retrieval scores every query against every row, in blocks: rows are dealt
once into blocks of a bounded size by a hash, a task holds one block, streams the
queries past it as NumPy products and returns its k best rows per query, and the
k best of all blocks are merged by query.  Nothing is collected to the driver, no
(row, query) pair leaves a task, and neither side has a size limit.  Texts are
found over an inverted index (`textindex`).  `lsh_topk` looks only at rows whose
signature is near the query's, `cells_topk` at the cells nearest to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.exprs import cosine, r6
from shelfcast.operators import textindex
from shelfcast.session import materialize

TOP_K = 3           # fixed value: the reference's top_k
ROW_BLOCK = 20_000
QUERY_BLOCK = 500


def label_centroids(emb: DataFrame) -> DataFrame:
    """Mean vector per label: one query per label (bounded by the label count)."""
    cells = emb.select("label", F.posexplode("embedding").alias("idx", "v"))
    means = cells.groupBy("label", "idx").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "m"))), lambda s: s["m"]).alias("vector"))


def top_k(scored: DataFrame, group: str, score: str, tie: str, k: int = TOP_K) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _blocked(rows: DataFrame, queries: DataFrame, row_id: str, query_id: str, k: int,
             score: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], row_block: int, query_block: int) -> DataFrame:
    """(query_id, rank, row_id, score): the k best rows of each query, by
    `score(rows, queries)`, a matrix for one block of either (NaN: no match).
    A row is dealt once; queries are copied once a block of rows.  Scores are
    rounded to 6 dp, ties go to the smaller row id."""
    n_blocks = max(1, -(-rows.count() // row_block))
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, query_id), (rows, row_id))}
    only = lambda df, other: [F.col(c) if c in df.columns else F.lit(None).cast(other.schema[c].dataType).alias(c)
                              for c in dict.fromkeys([*rows.columns, *queries.columns])]
    data = rows.select(F.pmod(F.xxhash64(row_id), F.lit(n_blocks)).cast("int").alias("_b"), F.lit(0).alias("_ask"), *only(rows, queries))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_b"), F.lit(1).alias("_ask"), *only(queries, rows))

    def best(r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out, ids = [], r[row_id].to_numpy()
        for one, s in zip(q[query_id], np.floor(score(r, q) * 1e6 + 0.5).T / 1e6):
            at = np.flatnonzero(~np.isnan(s))
            if len(at) > k:  # all that tie with the k-th
                at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
            at = at[np.lexsort((ids[at], -s[at]))][:k]
            out += [(one, i, x) for i, x in zip(ids[at], s[at])]
        return pd.DataFrame(out, columns=[query_id, row_id, "score"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks come one after another, each with its rows first."""
        now, held = None, []
        for b in batches:
            keys = b[["_b", "_ask"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for i, j in zip(np.append(0, cuts), np.append(cuts, len(b))):
                if i == j:
                    continue
                if keys[i][0] != now:
                    now, held = keys[i][0], []
                if not keys[i][1]:
                    held.append(b.iloc[i:j])
                    continue
                if len(held) > 1:
                    held = [pd.concat(held)]
                for at in range(i, j if held else i, query_block):
                    yield best(held[0], b.iloc[at:min(j, at + query_block)])

    found = (data.unionByName(asked).repartition("_b").sortWithinPartitions("_b", "_ask")
             .mapInPandas(run, f"{query_id} {kinds[query_id]}, {row_id} {kinds[row_id]}, score double"))
    return top_k(found, query_id, "score", row_id, k).select(query_id, "rank", row_id, "score")


def _cosines(vec_col: str, query_vec: str):
    def score(r: pd.DataFrame, q: pd.DataFrame) -> np.ndarray:
        x, y = (np.stack([np.asarray(v, dtype=np.float64) for v in c]) for c in (r[vec_col], q[query_vec]))
        size = np.sqrt((x ** 2).sum(axis=1))[:, None] * np.sqrt((y ** 2).sum(axis=1))[None, :]
        return np.divide(x @ y.T, size, out=np.zeros_like(size), where=size > 0)
    return score


def cosine_topk(corpus: DataFrame, queries: DataFrame, k: int = TOP_K, id_col: str = "vec_id",
                vec_col: str = "embedding", query_id: str = "query_id", query_vec: str = "vector",
                row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Exact top-k cosine neighbours of each query vector (ties by id)."""
    return _blocked(corpus.select(id_col, vec_col).where(F.col(vec_col).isNotNull()),
                    queries.select(query_id, query_vec).where(F.col(query_vec).isNotNull()),
                    id_col, query_id, k, _cosines(vec_col, query_vec), row_block, query_block)


def rag_prompt(hits: DataFrame, corpus: DataFrame, question: Column, group: str = "query_id",
               id_col: str = "vec_id") -> DataFrame:
    """Retrieved ids -> records (equi-join on the id), records as JSON lines in
    rank order, then the reference's prompt layout."""
    recs = hits.select(group, "rank", id_col, "score").join(
        corpus.select(id_col, "label"), id_col)
    line = F.concat(F.lit('{"vec_id": '), F.col(id_col).cast("string"), F.lit(', "label": '),
                    F.col("label").cast("string"), F.lit(', "similarity": '),
                    F.col("score").cast("string"), F.lit("}"))
    ctx = recs.groupBy(group).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("j")))), lambda s: s["j"]), "\n").alias("context"))
    ctx = ctx.withColumn("question", question)
    prompt = F.concat(F.lit("Use the following context to answer the question:\n\nContext:\n"), F.col("context"),
                      F.lit("\n\nQuestion: "), F.col("question"), F.lit("\n\nAnswer:"))
    return ctx.select(group, "question", prompt.alias("prompt"))


def kb_prompt(hits: DataFrame, records: DataFrame, questions: DataFrame, query_id: str, row_id: str,
              fields: tuple[str, ...]) -> DataFrame:
    """The retrieval prompt of each question, with the retrieved records as JSON
    lines in rank order: `records` has a JSON value text per field."""
    line = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{f}": '), F.col(f)) for f in fields]), F.lit("}"))
    found = hits.join(records.select(row_id, line.alias("_line")), row_id)
    ctx = found.groupBy(query_id).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "_line"))), lambda x: x["_line"]), "\n").alias("context"))
    return ctx.join(questions, query_id).select(query_id, "question", F.concat(
        F.lit("Use the following context to answer the question:\n\nContext:\n"), F.col("context"),
        F.lit("\n\nQuestion: "), F.col("question"), F.lit("\n\nAnswer:")).alias("prompt"))


# ---------------------------------------------------------------- TF-IDF

def tfidf_retrieve(corpus: DataFrame, queries: DataFrame, k: int = TOP_K, corpus_id: str = "doc_id",
                   query_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """Top-k corpus documents per query text by TF-IDF cosine, of those that
    share a term, over an inverted index made for it (`textindex`)."""
    return textindex.search(textindex.build(corpus, corpus_id, text_col), queries, query_id, k, text_col)


# ---------------------------------------------------------------- LSH

def signature(vec: Column, dim: int, bits: int) -> Column:
    """Signs of the dot products with `bits` fixed planes, as a bit mask.  The
    planes' components are digits of md5('plane:index'), so that any engine can
    rebuild them."""
    mask = F.lit(0).cast("long")
    for j in range(bits):
        plane = F.array(*[F.lit(int(hashlib.md5(f"{j}:{i}".encode()).hexdigest()[:8], 16) / 4294967296.0 - 0.5)
                          for i in range(1, dim + 1)])
        side = F.aggregate(F.zip_with(vec, plane, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
        mask = mask + F.when(side >= 0, F.lit(1 << j)).otherwise(F.lit(0))
    return mask


def lsh_topk(corpus: DataFrame, queries: DataFrame, k: int = TOP_K, bits: int = 8) -> DataFrame:
    """Top-k by cosine among rows of near signatures: for each query the least
    Hamming radius whose buckets hold k rows (all rows, if there are fewer), so
    a query always gets k.  Bucket sizes are 2^bits rows at most; candidates
    come by an equi-join on the signature."""
    dim = corpus.where("embedding IS NOT NULL").select(F.size("embedding").alias("n")).first()
    sign = lambda c: signature(F.col(c), dim["n"] if dim else 0, bits)
    rows = corpus.select("vec_id", "embedding", sign("embedding").alias("sig"))
    asked = queries.select("query_id", "vector", sign("vector").alias("own"))
    sizes = rows.groupBy("sig").agg(F.count("*").alias("n"))
    near = asked.select("query_id", "own", F.explode(F.sequence(F.lit(0), F.lit((1 << bits) - 1)).cast("array<bigint>")).alias("sig"))
    near = near.join(sizes, "sig").withColumn("dist", F.bit_count(F.col("own").bitwiseXOR(F.col("sig"))))
    upto = Window.partitionBy("query_id").orderBy("dist")
    whole = Window.partitionBy("query_id")
    held = near.withColumn("held", F.sum("n").over(upto))
    reach = F.min(F.when(F.col("held") >= k, F.col("dist"))).over(whole)
    probes = held.withColumn("reach", reach).where(F.coalesce(F.col("dist") <= F.col("reach"), F.lit(True)))
    scored = (probes.select("query_id", "sig").join(asked.select("query_id", "vector"), "query_id").join(rows, "sig")
              .select("query_id", "vec_id", r6(cosine("embedding", "vector")).alias("score")))
    return top_k(scored, "query_id", "score", "vec_id", k)


# ---------------------------------------------------------------- cells

CELL_SAMPLE = 50_000   # rows that cells are fitted on, about
CELL_SHARE = 0.08      # of the rows that a query looks at, at most about


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x ** 2).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def fit_cells(vectors: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres by spherical k-means."""
    x = _unit(vectors)
    centres = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[i:i + 4_096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4_096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = ~sums.any(axis=1)
        sums[empty] = centres[empty]
        centres = _unit(sums)
    return centres


def cells_topk(corpus: DataFrame, queries: DataFrame, k: int = TOP_K, share: float = CELL_SHARE,
               sample: int = CELL_SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score, candidates): approximate top-k by cosine in
    an inverted file.

    About 2 sqrt(N) cells are fitted on about `sample` rows; every row goes to
    the cell of its nearest centre.  A query probes cells by their centre's
    cosine until the cells probed hold `share` of the rows (and k rows); the cells
    grow slower than the rows, and so do the rows of one.  Candidates meet by an
    equi-join on the cell; a cell of many rows is dealt into parts, and its
    queries go to each."""
    rows = materialize(corpus.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).select(id_col, vec_col), "cells-rows")
    n = rows.count()
    if not n:
        empty = queries.select("query_id").limit(0)
        return empty.select("query_id", F.lit(0).alias("rank"), F.lit(None).cast(corpus.schema[id_col].dataType).alias(id_col),
                            F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("candidates"))
    cells = max(1, int(2 * n ** 0.5))
    every = -(-n // sample)
    some = rows.where(F.pmod(F.xxhash64(id_col, F.lit(3)), F.lit(every)) == 0).select(vec_col).toPandas()[vec_col]
    if not len(some):
        some = rows.limit(1).toPandas()[vec_col]
    centres = fit_cells(np.stack([np.asarray(v, dtype=np.float64) for v in some]), min(cells, max(1, len(some) // 8)))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack([np.asarray(v, dtype=np.float64) for v in b[vec_col]])
                yield b.assign(cell=(x @ centres.T).argmax(axis=1))

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    placed = materialize(rows.mapInPandas(nearest, f"{id_col} {kind(rows, id_col)}, {vec_col} {kind(rows, vec_col)}, cell int"), "cells")
    # One row a cell.
    held = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    size = np.array([held.get(c, 0) for c in range(len(centres))])
    parts = np.maximum(1, -(-size // ROW_BLOCK))
    enough = max(k, share * n)

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for query, vector in zip(b["query_id"], b["vector"]):
                order = np.argsort(-(centres @ np.asarray(vector, dtype=np.float64)), kind="stable")
                before = np.append(0, size[order].cumsum()[:-1])
                # The first cell, and further ones while they fit into the share.
                use = order[(before < k) | (before + size[order] <= enough)]
                cell = np.repeat(use, parts[use])
                part = np.concatenate([np.arange(p) for p in parts[use]])
                yield pd.DataFrame({"query_id": query, "vector": [vector] * len(cell), "cell": cell, "part": part,
                                    "candidates": int(size[use].sum())})

    asked = queries.select("query_id", "vector").where("vector IS NOT NULL").mapInPandas(
        probes, f"query_id {kind(queries, 'query_id')}, vector {kind(queries, 'vector')}, cell int, part int, candidates long")
    width = F.element_at(F.lit([int(p) for p in parts]), F.col("cell") + 1)
    data = placed.withColumn("part", F.pmod(F.xxhash64(id_col), width).cast("int"))
    scored = data.join(asked, ["cell", "part"]).select("query_id", id_col, r6(cosine(vec_col, "vector")).alias("score"), "candidates")
    return top_k(scored, "query_id", "score", id_col, k).select("query_id", "rank", id_col, "score", "candidates")


def recall(found: DataFrame, exact: DataFrame, row_id: str = "vec_id", query_id: str = "query_id") -> DataFrame:
    """(query_id, k, recall): the share of each query's exact hits that were
    found; a found row that scores as high as the last exact one counts."""
    last = exact.groupBy(query_id).agg(F.count("*").alias("k"), F.min("score").alias("_least"))
    hits = found.join(last, query_id).where(F.col("score") >= F.col("_least")).groupBy(query_id).agg(F.count("*").alias("_hits"))
    return last.join(hits, query_id, "left").select(
        query_id, "k", (F.least(F.coalesce("_hits", F.lit(0)), F.col("k")) / F.col("k")).alias("recall"))
