"""Spelling variants by k-d trees over letter counts.

`vocabulary` counts the words of whole texts.  `pairs` finds all words that are
one inserted, deleted or replaced code point apart.  Each word is a vector of
letter counts.  One edit changes it little: a replacement adds at most one
letter and takes at most one away (L1 distance at most two), and a longer
neighbour has one letter more and none less.  So the words of a length are
searched by words of that length and of the next shorter one only, each pair of
lengths in a k-d tree whose boxes are pruned by these bounds.  The letters' order
is then compared on the words that are left.

The upper levels of the trees are fitted on a sample of `SAMPLE` words' vectors
at about that many, whatever the table's size; they only deal the words out into
cells, as many as there are words for them.  A word goes to its own cell, and
asks all cells within reach.  A cell that still holds more words than `CELL` is
dealt by hash into parts, and its queries go to each part.  A task builds the
lower levels of one part's tree and streams the queries past it, so that it
holds one part and one batch of queries.  Any sample gives the same pairs.

Defined results.  Null or empty text: no words.  Null doc_id: the empty text in
the hash.  Repeated rows: all their words count.  A word's length has no bound:
cells hold fewer of the longer words.  Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.session import materialize

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
MUTATE = 199
SAMPLE = 100_000
CELL = 2_048
CELL_BYTES = 4_000_000
LEAF = 8
BATCH = 2_048
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OTHERS = 6  # dimensions for the letters beyond a to z, A to Z


def _dimensions() -> np.ndarray:
    """Dimension of each code point below 256.  Letters that share a dimension
    only bring vectors nearer, so that the bounds hold."""
    of = np.zeros(256, dtype=np.int64)
    for i in range(256):
        c = i | 32 if 65 <= i <= 90 else i
        of[i] = c - 97 if 97 <= c <= 122 else 26 + i % OTHERS
    return of


DIMENSION = _dimensions()
DIMENSIONS = 26 + OTHERS


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
               mutate: int = MUTATE) -> DataFrame:
    """(word, n) of the words with `least_length` code points and `least_count`
    occurrences.  A word is a run of letters in a text, A-Z lower-cased; where
    `mutate` divides the run's hash with its document, without one letter."""
    # A greedy match of at least so many letters is a maximal run.
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(
        F.col("text"), F.lit("([A-Za-z\\u00C0-\\u00FF]{%d,})" % least_length), 1)).alias("_run"))
    low = runs.select("_id", F.when(F.lower("_run") == F.col("_run"), F.col("_run")).otherwise(
        F.translate("_run", UPPER, LOWER)).alias("_run"))
    hashed = low.select("_run", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")).alias("_h"))
    at = F.pmod(F.col("_h"), F.length("_run")).cast("int")
    shorter = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    return (hashed.select(F.when(F.col("_h") % mutate == 0, shorter).otherwise(F.col("_run")).alias("word"))
            .where(F.length("word") >= least_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count))


def letters(words: list[str], length: int) -> np.ndarray:
    """(words, length) code points of words of one length."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), length)


def counts(points: np.ndarray) -> np.ndarray:
    """Letter-count vectors."""
    n, length = points.shape
    kind = np.int16 if length < 2 ** 14 else np.int32
    out = np.empty((n, DIMENSIONS), dtype=kind)
    step = max(1, 4_000_000 // max(1, length))
    for i in range(0, n, step):
        part = points[i:i + step]
        cells = DIMENSION[part] + np.arange(len(part))[:, None] * DIMENSIONS
        out[i:i + step] = np.bincount(cells.ravel(), minlength=len(part) * DIMENSIONS).reshape(-1, DIMENSIONS)
    return out


class Tree:
    """A k-d tree: boxes of nodes, children, and the points of leaves.  Its
    boxes are those of the points (`tight`), or the half-spaces of the cuts,
    which also hold points that the tree has not seen."""

    def __init__(self, vectors: np.ndarray, leaf: int, tight: bool) -> None:
        self.order = np.arange(len(vectors))
        low, high, left, begin, end = [], [], [], [], []
        far = np.iinfo(vectors.dtype).max // 4
        whole = (np.full(DIMENSIONS, -far, vectors.dtype), np.full(DIMENSIONS, far, vectors.dtype))

        def node(a: int, z: int, box: tuple) -> int:
            some = vectors[self.order[a:z]]
            if tight and len(some):
                box = (some.min(axis=0), some.max(axis=0))
            low.append(box[0])
            high.append(box[1])
            left.append(-1)
            begin.append(a)
            end.append(z)
            return len(left) - 1

        todo = [node(0, len(vectors), whole)]
        while todo:
            i = todo.pop()
            a, z = begin[i], end[i]
            cut = _cut(vectors[self.order[a:z]]) if z - a > leaf else None
            if cut is None:
                continue
            d, at = cut
            here = self.order[a:z]
            below = vectors[here, d] <= at
            mid = a + int(below.sum())
            self.order[a:z] = np.concatenate([here[below], here[~below]])
            high_left, low_right = high[i].copy(), low[i].copy()
            high_left[d], low_right[d] = at, at + 1
            left[i] = node(a, mid, (low[i], high_left))
            node(mid, z, (low_right, high[i]))
            todo += [left[i], left[i] + 1]
        self.low, self.high = np.array(low), np.array(high)
        self.left, self.begin, self.end = np.array(left), np.array(begin), np.array(end)

    def reach(self, queries: np.ndarray, more: int, less: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf): the leaves whose box is within `more` letters more
        and `less` letters less than a query."""
        query, node = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
        queries_out, leaves_out = [], []
        while len(query):
            near = self._within(queries[query], node, more, less)
            query, node = query[near], node[near]
            is_leaf = self.left[node] < 0
            queries_out.append(query[is_leaf])
            leaves_out.append(node[is_leaf])
            query, child = query[~is_leaf], self.left[node[~is_leaf]]
            query, node = np.concatenate([query, query]), np.concatenate([child, child + 1])
        if not queries_out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(queries_out), np.concatenate(leaves_out)

    def _within(self, q: np.ndarray, node: np.ndarray, more: int, less: int) -> np.ndarray:
        up = np.maximum(self.low[node] - q, 0).sum(axis=1)
        down = np.maximum(q - self.high[node], 0).sum(axis=1)
        return (up <= more) & (down <= less)


def _cut(some: np.ndarray) -> tuple[int, int] | None:
    """The dimension and value, next to its median, that part the points most
    evenly; None where all are equal."""
    n = len(some)
    mid = np.partition(some, n // 2, axis=0)[n // 2]
    left = np.stack([(some < mid).sum(axis=0), (some <= mid).sum(axis=0)])
    off = np.where((left > 0) & (left < n), np.abs(2 * left - n), n + 1)
    k, d = np.unravel_index(off.argmin(), off.shape)
    return None if off[k, d] > n else (int(d), int(mid[d]) - 1 + int(k))


def _one_edit(query: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Whether each query is its data word with one letter replaced, or taken out."""
    if query.shape[1] == data.shape[1]:
        return (query != data).sum(axis=1) == 1
    front = np.logical_and.accumulate(query == data[:, :-1], axis=1)
    return (front | (query == data[:, 1:])).all(axis=1)


def near(tree: Tree, data: np.ndarray, vectors: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, data word) pairs one edit apart; the queries are as long as the
    data words or one letter shorter."""
    less = 1 if query.shape[1] == data.shape[1] else 0
    asked = counts(query)
    who, leaf = tree.reach(asked, 1, less)
    found_q, found_d = [], []
    step = max(1, 4_000_000 // max(DIMENSIONS * 4, data.shape[1]) // LEAF)
    for i in range(0, len(who), step):
        q, at = who[i:i + step], leaf[i:i + step]
        n = tree.end[at] - tree.begin[at]
        # The points of all leaves, one after another.
        place = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
        d, q = tree.order[np.repeat(tree.begin[at], n) + place], np.repeat(q, n)
        for j in range(0, len(d), step * LEAF):  # a leaf of equal vectors may be large
            dj, qj = d[j:j + step * LEAF], q[j:j + step * LEAF]
            change = vectors[dj] - asked[qj]
            ok = (np.maximum(change, 0).sum(axis=1) <= 1) & (np.maximum(-change, 0).sum(axis=1) <= less)
            dj, qj = dj[ok], qj[ok]
            ok = _one_edit(query[qj], data[dj])
            found_q.append(qj[ok])
            found_d.append(dj[ok])
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_d)


def _by_length(words: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
    lengths = words.str.len().to_numpy()
    for length in np.unique(lengths):
        yield int(length), np.flatnonzero(lengths == length)


class Dealer:
    """The upper levels of each length's tree: deals words into cells."""

    def __init__(self, sample: pd.DataFrame, sizes: dict[int, int]) -> None:
        """`sample`: (length, vector) rows; `sizes`: words of each length."""
        self.trees: dict[int, Tree] = {}
        for length, part in sample.groupby("length"):
            cells = -(-sizes[int(length)] // max(1, min(CELL, CELL_BYTES // int(length))))
            vectors = np.stack([np.frombuffer(v, dtype=np.int32) for v in part["vector"]])
            if cells > 1:
                self.trees[int(length)] = Tree(vectors, max(1, len(vectors) // cells), tight=False)

    def reach(self, length: int, vectors: np.ndarray, more: int, less: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, cell): cells of the tree of `length` within reach."""
        if length not in self.trees:
            every = np.arange(len(vectors))
            return every, np.zeros(len(every), dtype=np.int64)
        return self.trees[length].reach(vectors.astype(np.int32), more, less)


def pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): the pairs of words (word, n) that are one edit
    apart, in both directions."""
    def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for length, at in _by_length(b["word"]):
                vectors = counts(letters(list(b["word"].iloc[at]), length)).astype(np.int32)
                yield pd.DataFrame({"length": length, "vector": [v.tobytes() for v in vectors]})

    # One row a length: a word of length L needs L letters of text.
    sizes = {r["_len"]: r["n"] for r in words.groupBy(F.length("word").alias("_len")).agg(F.count("*").alias("n")).collect()}
    every = -(-sum(sizes.values()) // SAMPLE) or 1
    sample = (words.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select("word")
              .mapInPandas(sampled, "length int, vector binary").toPandas())
    dealer = Dealer(sample, sizes)

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell, length_of = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            for length, at in _by_length(b["word"]):
                who, where = dealer.reach(length, counts(letters(list(b["word"].iloc[at]), length)), 0, 0)
                cell[at[who]], length_of[at] = where, length
            yield b[["word", "n"]].assign(len=length_of, cell=cell)

    placed = materialize(words.mapInPandas(homes, "word string, n long, len int, cell int"), "variant-words")
    # One row a cell, of which there are no more than sampled vectors and lengths.
    parts = {(r["len"], r["cell"]): -(-r["n"] // max(1, min(2 * CELL, 2 * CELL_BYTES // r["len"])))
             for r in placed.groupBy("len", "cell").agg(F.count("*").alias("n")).collect()}

    def asks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each word as data in its own cell, and as a query in those within
        reach; `ask` is the query's length, 0 for data."""
        for b in batches:
            hashes = pd.util.hash_array(b["word"].to_numpy(dtype=object)).astype(np.int64) & 0x7FFFFFFF
            own = np.array([parts[x] for x in zip(b["len"], b["cell"])], dtype=np.int64)
            yield b.assign(part=hashes % np.maximum(own, 1), ask=0)
            for length, at in _by_length(b["word"]):
                some, step = b.iloc[at], max(1, min(BATCH, CELL_BYTES // length))
                for k in range(0, len(some), step):
                    rows = some.iloc[k:k + step]
                    vectors = counts(letters(list(rows["word"]), length))
                    for of, less in ((length, 1), (length + 1, 0)):
                        if of not in sizes:
                            continue
                        who, cell = dealer.reach(of, vectors, 1, less)
                        n = np.array([parts.get((of, c), 0) for c in cell.tolist()], dtype=np.int64)
                        part = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
                        yield rows.iloc[np.repeat(who, n)][["word", "n"]].assign(
                            len=of, cell=np.repeat(cell, n), part=part, ask=length)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Parts come one after another, each with its data first."""
        now, held = None, []
        for b in batches:
            keys = b[["len", "cell", "part", "ask"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for i, j in zip(np.append(0, cuts), np.append(cuts, len(b))):
                if i == j:
                    continue
                length, cell, part, ask = (int(x) for x in keys[i])
                if now != (length, cell, part):
                    now, held, tree = (length, cell, part), [], None
                rows = b.iloc[i:j]
                if ask == 0:
                    held.append(rows[["word", "n"]])
                    continue
                if not held:
                    continue
                if tree is None:
                    own = pd.concat(held)
                    names, n = own["word"].to_numpy(), own["n"].to_numpy()
                    data = letters(list(names), length)
                    vectors = counts(data)
                    tree = Tree(vectors, LEAF, tight=True)
                batch = max(1, min(BATCH, CELL_BYTES // length))
                for k in range(0, len(rows), batch):
                    some = rows.iloc[k:k + batch]
                    q, d = near(tree, data, vectors, letters(list(some["word"]), ask))
                    asking, asking_n = some["word"].to_numpy()[q], some["n"].to_numpy()[q]
                    yield pd.DataFrame({"word": asking, "near": names[d], "near_n": n[d]})
                    if ask < length:
                        yield pd.DataFrame({"word": names[d], "near": asking, "near_n": asking_n})

    place = ["len", "cell", "part"]
    dealt = (placed.mapInPandas(asks, "word string, n long, len int, cell int, part int, ask int")
             .repartition(*place).sortWithinPartitions(*place, "ask"))
    return dealt.mapInPandas(search, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word in (word, form): the last form.  Each round
    doubles the length of the paths followed; forms grow in frequency, so
    that paths are short and without cycles."""
    now = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("_on")), "variant-roots")
    while now.where("_on").limit(1).count():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = materialize(now.join(ahead, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_on")), "variant-roots")
    return now.select("word", "root")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
             ratio: int = RATIO, mutate: int = MUTATE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: its most frequent
    neighbour, if that is `ratio` times as frequent, and the end of that path."""
    words = materialize(vocabulary(docs, least_length, least_count, mutate), "variant-vocabulary")
    best = (pairs(words).groupBy("word").agg(F.count("*").alias("n_near"),
                                             F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("_b")))
    table = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("_b.m") >= ratio * F.col("n"), F.col("_b")).alias("_b")), "variant-forms")
    found = table.select("word", F.col("_b.near").alias("form"), "n", "n_near", (-F.col("_b.m")).alias("form_n"))
    return found.join(roots(found.where("form IS NOT NULL").select("word", "form")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
