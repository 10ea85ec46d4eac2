"""Nearest neighbours by collision-counting hashing.

Each vector is projected on `PROJECTIONS` random lines, and every line keeps
its projections as one sorted array.  A query opens a window around its own
projection on every line; a vector collides with it on the lines whose window
holds the vector.  Virtual rehashing widens all windows together, from a small
radius R on: a vector at distance R or less collides on a line with
probability P1 at least, whatever R, so vectors with `threshold` collisions or
more are verified by their true inner product.  The search ends at the first
radius that reaches the k-th best distance found; the last radius is that
distance itself, not beyond it.  Nothing limits the number of candidates.
Narrow windows are counted by the vectors that they take in; wide ones, as those
of vectors without clusters are, by comparing all places on a line with the
window's ends, which costs less a vector.  The counts are the same.

Inner products become distances by one more coordinate, which gives all vectors
of a block the same norm (that of the longest).

Vectors are dealt into blocks by hash, each once; a task builds the sorted
arrays of a block once and streams all queries past it.  The k best of each block
are merged by query.  All rows are indexed.  Projections depend on the dimension
and a seed only.  Vectors are scaled by powers of two before their norms are
taken, so that no finite component overflows; a score that does is infinite, and
null where infinities of both signs meet.

Defined results.  A vector that is null or zero, or that holds a null, NaN or
infinite component, takes no part; nor does a null vec_id.  Vectors of another
dimension than the query's are no candidates for it.  Repeated rows: each is a
candidate (for its double, too) and a query of its own, with equal results.
Fewer than k candidates: all of them.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.session import materialize

PROJECTIONS = 64
HALF_WINDOW = 0.96  # of a radius
WIDEN = 1.3
FIRST_RADIUS = 0.6  # of the typical distance
MISS = 1.6  # standard deviations below the mean of a vector at the radius
BLOCK = (8_192, 65_536)  # least and most vectors a block
BLOCKS = 64  # blocks that a table is cut into while they are of neither size
SEED = 77
TOGETHER = 64  # queries that are searched together in a block
DENSE = 64  # windows that take in less than this part of a block are counted by their members
COLUMNS = 8_192  # vectors whose places are compared together

P1 = 0.6629  # probability that a standard normal variable is within HALF_WINDOW


def threshold(lines: int) -> int:
    return int(np.floor(P1 * lines - MISS * np.sqrt(P1 * (1 - P1) * lines)))


class Index:
    """Sorted projections of one block of vectors."""

    def __init__(self, originals: np.ndarray, lines: int = PROJECTIONS) -> None:
        self.originals, (self.n, dim) = originals, originals.shape
        # Components near one, by a power of two, so that squares stay finite.
        self.vectors = vectors = _scaled(originals)
        squares = (vectors ** 2).sum(axis=1)
        self.norm = float(np.sqrt(squares.max()))
        extra = np.sqrt(np.maximum(self.norm ** 2 - squares, 0))
        rng = np.random.default_rng([SEED, dim])
        self.directions = rng.standard_normal((lines, dim + 1))
        projected = self.directions[:, :dim] @ vectors.T + self.directions[:, dim:] * extra
        self.order = np.argsort(projected, axis=1).astype(np.int32)
        self.sorted = np.take_along_axis(projected, self.order, axis=1)
        # A vector's place on each line.
        self.place = np.empty(projected.shape, dtype=np.uint16 if self.n < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, self.order, np.arange(self.n, dtype=self.place.dtype)[None, :], axis=1)
        # The projections' spread is that of half the typical squared distance.
        self.typical = float(np.sqrt(2 * projected.var(axis=1).mean()))
        self.need = threshold(lines)

    def search(self, original: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and inner products of the candidates that may be among
        the k best; the positions `own` are left out."""
        return self.search_all([original], [own], k)[0]

    def search_all(self, originals: list[np.ndarray], owns: list[np.ndarray], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """`search` of several queries, whose windows are widened round by round."""
        live = [_Query(self, x, own, k) for x, own in zip(originals, owns)]
        every = live
        low = high = self._places(np.array([q.at for q in live]), "left")
        while keep := [i for i, q in enumerate(live) if not q.done]:
            live, low, high = [live[i] for i in keep], low[keep], high[keep]
            at, half = np.array([q.at for q in live]), np.array([[HALF_WINDOW * q.radius] for q in live])
            new_low, new_high = self._places(at - half, "left"), self._places(at + half, "right")
            added = ((low - new_low) + (new_high - high)).sum(axis=1)
            for q, n, *windows in zip(live, added.tolist(), new_low, low, high, new_high):
                if n * DENSE < self.place.size:
                    hit = np.concatenate([o[slice(*w)] for o, a, b, c, d in zip(self.order, *(x.tolist() for x in windows))
                                          for w in ((a, b), (c, d))])
                    q.count += np.bincount(hit, minlength=self.n).astype(q.count.dtype)
                else:
                    self._collisions(windows[0], windows[-1], q.count)
                q.verify(bool((windows[-1] - windows[0] == self.n).all()))
            low, high = new_low, new_high
        return [q.best() for q in every]

    def _places(self, values: np.ndarray, side: str) -> np.ndarray:
        """Where the queries' values on each line fall among the sorted ones."""
        return np.stack([s.searchsorted(x, side) for s, x in zip(self.sorted, values.T)], axis=1)

    def _collisions(self, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> None:
        """Count anew on how many lines each vector's place is in [low, high):
        places below `low` wrap around to beyond the width."""
        first, width = (x.astype(self.place.dtype)[:, None] for x in (low, high - low))
        for i in range(0, self.n, COLUMNS):
            near = self.place[:, i:i + COLUMNS] - first < width
            np.add.reduce(near.view(np.uint8), axis=0, dtype=count.dtype, out=count[i:i + COLUMNS])


class _Query:
    """One query's collisions and candidates in a block."""

    def __init__(self, index: Index, original: np.ndarray, own: np.ndarray, k: int) -> None:
        self.index, self.original, self.query = index, original, _scaled(original)
        self.length = float(np.sqrt((self.query ** 2).sum()))
        self.at = index.directions[:, :-1] @ (self.query * (index.norm / self.length))
        self.count = np.zeros(index.n, dtype=np.uint8 if len(index.sorted) < 256 else np.int64)
        self.seen = np.zeros(index.n, dtype=bool)
        self.seen[own] = True
        self.found, self.scores = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        # Never zero, as in a block of one vector: it is widened by a factor.
        self.radius = max(FIRST_RADIUS * index.typical, 1e-6 * index.norm)
        self.k = min(k, index.n - len(own))
        self.worst = np.inf
        self.done = not self.k

    def verify(self, whole: bool) -> None:
        """Take the vectors of enough collisions as candidates, and end or widen
        the search; `whole`: the windows hold all vectors."""
        index, k = self.index, self.k
        some = np.flatnonzero((self.count >= index.need) & ~self.seen)
        self.seen[some] = True
        if len(some):
            self.found.append(some)
            self.scores.append(np.einsum("ij,j->i", index.vectors.take(some, axis=0), self.query))
        every = np.concatenate(self.scores)
        if len(every) >= k:
            best = np.partition(every, len(every) - k)[len(every) - k]
            self.worst = float(np.sqrt(max(0.0, 2 * index.norm ** 2 - 2 * best * index.norm / self.length)))
        if self.worst <= self.radius or whole:
            self.done = True
        elif self.worst > self.radius:
            self.radius = min(self.radius * WIDEN, self.worst)

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        ids, every, k = np.concatenate(self.found), np.concatenate(self.scores), self.k
        if len(every) > k:
            keep = every >= np.partition(every, len(every) - k)[len(every) - k] - 1e-9 * self.index.norm * self.length
            ids = ids[keep]
        return ids, inner(self.index.originals[ids], self.original)


def _scaled(x: np.ndarray) -> np.ndarray:
    return np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))


def inner(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, summed in the order of the components: equal vectors
    have equal ones."""
    total = np.zeros(len(vectors))
    for x, y in zip(vectors.T, query):
        total += x * y
    return total


def _valid(vector: str) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(rows: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows `is_query` against all."""
    usable = materialize(
        rows.select("vec_id", F.col("embedding").cast("array<double>").alias("_v"), is_query.alias("_q"))
        .where(F.col("vec_id").isNotNull() & _valid("_v"))
        .withColumns({"_row": F.monotonically_increasing_id(), "_dim": F.size("_v")}), "ann")
    total = usable.count()
    blocks = max(1, -(-total // max(BLOCK[0], min(BLOCK[1], total // BLOCKS))))
    columns = ["_dim", "_block", "_ask", "_row", "vec_id", "_v"]
    data = usable.withColumns({"_block": F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int"), "_ask": F.lit(0)})
    asked = usable.where("_q").withColumns({"_block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "_ask": F.lit(1)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks come one after another, each with its vectors first: a block
        is indexed once, and all queries are streamed past it."""
        now, held, index = None, [], None
        for b in batches:
            keys = b[["_dim", "_block", "_ask"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for i, j in zip(np.append(0, cuts), np.append(cuts, len(b))):
                if i == j:
                    continue
                block = tuple(keys[i][:2].tolist())
                if now != block:
                    now, held, index = block, [], None
                if not keys[i][2]:
                    held.append(b.iloc[i:j])
                    continue
                if index is None:
                    if not held:
                        continue
                    own = pd.concat(held).sort_values("_row")
                    ids, own_rows, held = own["vec_id"].to_numpy(), own["_row"].to_numpy(), [None]
                    index = Index(np.stack(own["_v"].to_numpy()))
                out = []
                for part in range(i, j, TOGETHER):
                    asks = b.iloc[part:min(j, part + TOGETHER)]
                    owns = [np.flatnonzero(own_rows == row) for row in asks["_row"]]
                    hits = index.search_all([np.asarray(v) for v in asks["_v"]], owns, k)
                    for row, query_id, (at, scores) in zip(asks["_row"], asks["vec_id"], hits):
                        best = np.lexsort((ids[at], -scores))[:k]
                        out += [(row, query_id, ids[at[x]], scores[x]) for x in best]
                yield pd.DataFrame(out, columns=["_row", "query_id", "vec_id", "score"])

    found = (data.select(columns).unionByName(asked.select(columns)).repartition("_dim", "_block")
             .sortWithinPartitions("_dim", "_block", "_ask")
             .mapInPandas(run, "_row long, query_id long, vec_id long, score double"))
    best = Window.partitionBy("_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
