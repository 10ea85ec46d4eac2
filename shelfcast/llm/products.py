"""Exact top-k by inner product, over vectors in descending length.

Vectors are integers here: each component x becomes floor(scale * x), and
scores are exact integer inner products.

Vectors are sorted by descending length and cut into blocks of nearby lengths,
one table row a vector.  Every query first meets the block of longest vectors
(of its dimension), which gives it a score that its k-th best reaches at least.
It then goes only to the blocks whose longest vector can reach that score by
Cauchy-Schwarz.  Within a block, vectors and queries are rotated onto the
principal axes (the singular vectors of a sample of `SAMPLE` vectors at about
that many; any rotation gives the same results), so that the first coordinates
hold most of the length.  Chunks of vectors, longest first, are scored on a
growing number of coordinates; a pair is left as soon as its partial sum and the
product of the two rests' lengths stay below the query's k-th best.  Pairs that
remain are scored exactly.

A vector is dealt once to its block, and a task holds one block and streams the
queries that come to it, so that no vector is copied a query; queries are copied
once a block that they can still score in.

Defined results.  A vector that is null or that holds a null, NaN or infinite
component (after scaling) takes no part; nor does a null vec_id.  Zero and empty
vectors take part.  Vectors of another dimension than the query's are no candidates.
Repeated rows: each is a candidate (for its double, too) and a query of its own,
with equal results.  Fewer than k candidates: all of them.  Scores beyond 64
bits rank by their exact values and are returned as the nearest long.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.session import materialize

SCALE = 1024
K = 10
SAMPLE = 4_096
BLOCK = (8_192, 131_072)  # least and most vectors a block
BLOCKS = 64  # blocks that a table is cut into while they are of neither size
BLOCK_BYTES = 2 ** 26
CHUNK = 2_048
QUERIES = 512
EXACT = 2.0 ** 52  # sums below this are exact in double precision
SLACK = 1e-9  # of the lengths' product, for rounding
LONG = 2 ** 63 - 1


def _valid(vector: str) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def axes(vectors: np.ndarray) -> np.ndarray:
    """Orthonormal columns, the direction of largest spread about zero first."""
    if not len(vectors) or not np.isfinite((vectors ** 2).sum()):
        return np.eye(vectors.shape[1])
    return np.linalg.svd(vectors, full_matrices=True)[2].T


class Block:
    """Vectors of one block, longest first, on the principal axes."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, basis: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            length = np.sqrt((vectors ** 2).sum(axis=1))
        by = np.lexsort((ids, -length))
        self.ids, self.rows, self.vectors, self.length = ids[by], rows[by], vectors[by], length[by]
        self.most = float(np.abs(vectors).max(initial=0.0))
        self.turned = self.vectors @ basis
        dim = vectors.shape[1]
        self.steps = sorted({max(1, dim * p // 16) for p in (2, 4, 8)}) if dim > 4 else []
        self.rests = [_rest(self.turned, m) for m in self.steps]


def _rest(turned: np.ndarray, m: int) -> np.ndarray:
    return np.sqrt((turned[:, m:] ** 2).sum(axis=1))


def search(block: Block, queries: np.ndarray, own: np.ndarray, least: np.ndarray, basis: np.ndarray,
           k: int) -> list[tuple[np.ndarray, list]]:
    """Of each query: places in the block of its best k at or above `least`,
    and their scores (Python integers), best first, ties to smaller ids."""
    best: list[tuple[np.ndarray, list]] = [(np.zeros(0, np.int64), [])] * len(queries)
    dim = queries.shape[1]
    if block.most * float(np.abs(queries).max(initial=0.0)) * max(dim, 1) >= EXACT:
        return [_in_integers(block, q, o, k) for q, o in zip(queries, own)]
    turned = queries @ basis
    length = np.sqrt((queries ** 2).sum(axis=1))
    rests = [_rest(turned, m) for m in block.steps]
    bar = least.copy()  # the k-th best so far, or what it is known to reach
    for i in range(0, len(block.ids), CHUNK):
        part = slice(i, i + CHUNK)
        # Lengths descend, so the chunk's first vector bounds it.
        open_ = np.flatnonzero(length * block.length[i] * (1 + SLACK) >= bar)
        if not len(open_):
            break
        slack = SLACK * np.outer(length[open_], block.length[part])
        alive = np.ones(slack.shape, dtype=bool)
        score, done = np.zeros(slack.shape), 0
        for m, of_query, of_data in zip(block.steps, rests, block.rests):
            score += turned[open_, done:m] @ block.turned[part, done:m].T
            done = m
            alive = score + np.outer(of_query[open_], of_data[part]) + slack >= bar[open_, None]
            rows = alive.any(axis=1)
            if not rows.any():
                break
            if not rows.all():
                open_, score, slack, alive = open_[rows], score[rows], slack[rows], alive[rows]
        if not alive.any():
            continue
        if alive.mean() > 0.05:
            exact = queries[open_] @ block.vectors[part].T
            alive &= exact >= bar[open_, None]
        else:
            qi, di = np.nonzero(alive)
            exact = np.zeros(alive.shape)
            exact[qi, di] = np.einsum("ij,ij->i", queries[open_[qi]], block.vectors[part][di])
            alive &= exact >= bar[open_, None]
        for r in np.flatnonzero(alive.any(axis=1)):
            q = open_[r]
            at = np.flatnonzero(alive[r])
            scores = exact[r, at]
            at = at + i
            keep = block.rows[at] != own[q]
            at, scores = np.append(best[q][0], at[keep]), np.append(np.array(best[q][1], dtype=float), scores[keep])
            by = np.lexsort((block.ids[at], -scores))[:k]
            best[q] = (at[by], scores[by])
            if len(by) == k:
                bar[q] = max(bar[q], scores[by[-1]])
    return [(at, [int(x) for x in scores]) for at, scores in best]


def _in_integers(block: Block, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, list]:
    """Where sums may pass double precision: Python's integers."""
    asked = [int(x) for x in query]
    scores = [sum(x * int(y) for x, y in zip(asked, v)) for v in block.vectors.tolist()]
    every = sorted((-s, block.ids[i], i) for i, s in enumerate(scores) if block.rows[i] != own)[:k]
    return np.array([i for _, _, i in every], dtype=np.int64), [-s for s, _, _ in every]


def _array(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if dim else np.zeros((len(column), 0))


def top_products(rows: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows `is_query` against all."""
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * float(scale))
    # From 2^53 on, doubles have no fractions (and may pass a long).
    floored = F.transform("_v", lambda x: F.when(F.abs(x) < 2.0 ** 53, F.floor(x).cast("double")).otherwise(x))
    usable = (rows.select("vec_id", whole.alias("_v"), is_query.alias("_q"))
              .where(F.col("vec_id").isNotNull() & _valid("_v")).withColumn("_v", floored)
              .withColumns({"_row": F.monotonically_increasing_id(), "_dim": F.size("_v"),
                            "_len": F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))}))
    staged = materialize(usable, "products")
    size = staged.agg(F.count("*").alias("n"), F.max("_dim").alias("dim")).first()
    total = size["n"]
    block = max(1, min(max(BLOCK[0], total // BLOCKS), BLOCK[1], BLOCK_BYTES // (8 * max(1, size["dim"] or 1))))
    cut = (staged.repartitionByRange(max(1, -(-total // block)), F.col("_dim"), F.col("_len").desc(), F.col("_row"))
           .withColumn("_block", F.spark_partition_id()))
    vectors = materialize(cut, "products-blocks")
    # One row a block and dimension; the longest vector of each.
    edges = vectors.groupBy("_dim", "_block").agg(F.max("_len").alias("longest")).toPandas()
    edges = edges.sort_values(["_dim", "_block"])
    blocks = {int(d): (g["_block"].to_numpy(), g["longest"].to_numpy()) for d, g in edges.groupby("_dim")}

    every = -(-total // SAMPLE) or 1
    bases: dict[int, np.ndarray] = {}
    sample = vectors.where(F.pmod(F.xxhash64("_row"), F.lit(every)) == 0).select("_dim", "_v").toPandas()
    for dim, part in sample.groupby("_dim"):
        bases[int(dim)] = axes(_array(part["_v"], int(dim)))

    def basis(dim: int) -> np.ndarray:
        return bases[dim] if dim in bases else np.eye(dim)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks come one after another, each with its vectors first."""
        now, held, index = None, [], None
        for b in batches:
            keys = b[["_dim", "_block", "_ask"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for i, j in zip(np.append(0, cuts), np.append(cuts, len(b))):
                if i == j:
                    continue
                dim, number, ask = (int(x) for x in keys[i])
                if now != (dim, number):
                    now, held, index = (dim, number), [], None
                some = b.iloc[i:j]
                if not ask:
                    held.append(some[["vec_id", "_row", "_v"]])
                    continue
                if index is None:
                    own = pd.concat(held)
                    index = Block(own["vec_id"].to_numpy(), own["_row"].to_numpy(), _array(own["_v"], dim), basis(dim))
                    held = []
                for at in range(0, len(some), QUERIES):
                    q = some.iloc[at:at + QUERIES]
                    found = search(index, _array(q["_v"], dim), q["_row"].to_numpy(), q["_least"].to_numpy(), basis(dim), k)
                    out = [(row, query_id, index.ids[p], str(s)) for row, query_id, (places, scores) in
                           zip(q["_row"], q["vec_id"], found) for p, s in zip(places, scores)]
                    yield pd.DataFrame(out, columns=["_row", "query_id", "vec_id", "exact"])

    columns = ["_dim", "_block", "_row", "vec_id", "_v"]
    asking = "_dim int, _block int, _row long, vec_id long, _v array<double>, _least double"

    def routed(of: slice, prune: bool):
        """Queries once for each block of `of` that they can still score in."""
        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for dim, some in b.groupby("_dim"):
                    for n, top in zip(*(x[of] for x in blocks[int(dim)])):
                        out = ~(some["_len"] * top * (1 + SLACK) < some["_least"]) if prune else slice(None)
                        yield some.loc[out].assign(_block=int(n))[[*columns, "_least"]]
        return route

    def scored(data: DataFrame, asked: DataFrame) -> DataFrame:
        both = data.select(*columns, F.lit(0).alias("_ask"), F.lit(0.0).alias("_least")).unionByName(
            asked.select(*columns, F.lit(1).alias("_ask"), "_least"))
        return (both.repartition("_dim", "_block").sortWithinPartitions("_dim", "_block", "_ask")
                .mapInPandas(run, "_row long, query_id long, vec_id long, exact string"))

    queries = vectors.where("_q").select("_dim", "_row", "vec_id", "_v", "_len")
    # One row a dimension.
    heads = vectors.sparkSession.createDataFrame(
        [(d, int(n[0])) for d, (n, _) in blocks.items()], "_dim int, _head int")
    placed = vectors.join(heads, "_dim")
    asked = queries.withColumn("_least", F.lit(float("-inf"))).mapInPandas(routed(slice(0, 1), False), asking)
    first = materialize(scored(placed.where("_block = _head"), asked), "products-head")
    # The k-th best in the head block, if there are k.
    kth = first.groupBy("_row").agg(F.count("*").alias("_n"), F.min(F.col("exact").cast("double")).alias("_kth"))
    known = queries.join(kth, "_row", "left").select(
        "_dim", "_row", "vec_id", "_v", "_len",
        F.when(F.col("_n") >= k, F.col("_kth") - F.abs("_kth") * SLACK).otherwise(F.lit(float("-inf"))).alias("_least"))
    rest = scored(placed.where("_block <> _head"), known.mapInPandas(routed(slice(1, None), True), asking))
    found = first.unionByName(rest)
    # Integers as text rank by sign, digits and value: exact at any size.
    digits = F.length(F.ltrim(F.col("exact"), F.lit("-")))
    negative = F.col("exact").startswith("-")
    by_value = Window.partitionBy("_row").orderBy(
        F.when(negative, -digits).otherwise(digits).desc(),
        F.when(~negative, F.col("exact")).desc(), F.when(negative, F.col("exact")).asc(), "vec_id")
    score = F.coalesce(F.col("exact").try_cast("long"), F.when(negative, F.lit(-LONG - 1)).otherwise(F.lit(LONG)))
    return found.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", score.alias("score"))
