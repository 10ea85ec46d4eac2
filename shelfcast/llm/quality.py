"""Quality rules: gradient-boosted trees over document statistics.

`document_stats` computes the statistics of every whole text in Arrow batches.
`fit` trains boosted regression trees (logistic loss, histogram splits) on a
bounded sample of labelled rows (`max_rows`, the rows whose hashed id comes
first, so that the sample does not depend on partitioning).  Chosen features
carry a monotonic sign: a split that would order its children against the sign
is not taken, and the children's values are kept on their sides of the middle,
so the score can only fall as such a feature grows.  The trees are flattened
into NumPy arrays (feature, threshold, left, right, value) that score a batch
with one gather per level.

Defined results.  Null text: as the empty text (no words, rejected by the base
rule).  Null doc_id: kept as a row.  Repeated rows: one result each.  No
labelled rows, or labels of one class only: no trees, the base rule decides.
Other columns of the input are ignored by `quality`, and pass through
`filter_documents`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import text_bytes, text_key

# Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
         "n_upper", "n_digits", "n_alpha", "n_unique_words", "n_lines")
# Features of the trees, and the sign of their effect on quality (0: free).
FEATURES = (("mean_word", 0), ("symbols_per_word", -1), ("dup_lines_share", -1),
            ("repeat_share", -1), ("upper_share", -1), ("digit_share", -1), ("alpha_share", 1),
            ("unique_share", 0), ("words_per_line", 0))
MAX_ROWS = 4_000
# A text is rejected only below this score: labels are noisy near the border,
# and rejecting a clean text costs more than keeping a doubtful one.
KEEP_FROM = 0.2


def _repeat_words(words: np.ndarray) -> int:
    """Words that stand in a window of three words found twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids = pd.factorize(words)[0].astype(np.int64)
    pairs = pd.factorize(ids[:-1] * (ids.max() + 1) + ids[1:])[0].astype(np.int64)
    grams = pd.factorize(pairs[:-1] * (ids.max() + 1) + ids[2:])[0]
    start = (np.bincount(grams) > 1)[grams]
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k:k + n] |= start
    return int(covered.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The values of STATS for one text."""
    raw = text_bytes(text)
    if not raw:
        return (0,) * len(STATS)
    text = text or ""
    words = raw.split()
    seen = np.empty(len(words), dtype=object)
    seen[:] = words
    spaces = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    by_byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower = int(by_byte[65:91].sum()), int(by_byte[97:123].sum())
    beyond = int(by_byte[192:].sum())  # lead bytes: one for each code point over ASCII
    return (len(words), len(text) - spaces, sum(int(by_byte[ord(c)]) for c in SYMBOLS),
            len(lines) - len(set(lines)), _repeat_words(seen), upper, int(by_byte[48:58].sum()),
            upper + lower + beyond, len(set(words)), len(lines))


def features(stats: np.ndarray) -> np.ndarray:
    """Feature matrix (rows, FEATURES) of a matrix of STATS."""
    x = {k: stats[:, i].astype(np.float64) for i, k in enumerate(STATS)}
    words, chars = np.maximum(x["n_words"], 1), np.maximum(x["word_chars"], 1)
    return np.column_stack([
        x["word_chars"] / words, x["n_symbols"] / words,
        x["n_dup_lines"] / np.maximum(x["n_lines"], 1), x["n_repeat_words"] / words,
        x["n_upper"] / chars, x["n_digits"] / chars, x["n_alpha"] / chars,
        x["n_unique_words"] / words, x["n_words"] / np.maximum(x["n_lines"], 1)])


@dataclass
class Trees:
    """Boosted trees, flattened: node arrays of all trees, one after another.
    A leaf is its own child, so that every row takes `depth` steps."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row of the feature matrix."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1.0 / (1.0 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 40, depth: int = 3, rate: float = 0.2,
              bins: int = 32, l2: float = 1.0, min_hess: float = 1.0) -> Trees:
    """Boost `n_trees` trees on (x, y); FEATURES gives the monotonic signs."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    p0 = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(p0 / (1 - p0)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots, total = [], np.full(len(y), base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-gs / (hs + l2), low, high))
        me = len(nodes)
        nodes.append([0, 0.0, me, me, rate * value])
        best = (1e-6, -1, 0, 0.0)
        for f, (_, sign) in enumerate(FEATURES if level < depth else ()):
            if not len(edges[f]):
                continue
            c = codes[rows, f]
            gl = np.bincount(c, g[rows], len(edges[f]) + 1).cumsum()[:-1]
            hl = np.bincount(c, h[rows], len(edges[f]) + 1).cumsum()[:-1]
            gr, hr = gs - gl, hs - hl
            vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            gain = gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2) - gs ** 2 / (hs + l2)
            gain[(hl < min_hess) | (hr < min_hess) | (sign * (vr - vl) < 0)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k, float(vl[k] + vr[k]) / 2)
        _, f, k, middle = best
        if f >= 0:
            sign = FEATURES[f][1]
            goes_left = codes[rows, f] <= k
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)),
                      -1: ((middle, high), (low, middle))}[sign]
            nodes[me][0], nodes[me][1] = f, float(edges[f][k])
            nodes[me][2] = grow(rows[goes_left], g, h, level + 1, *bounds[0])
            nodes[me][3] = grow(rows[~goes_left], g, h, level + 1, *bounds[1])
        return me

    for _ in range(n_trees):
        p = 1.0 / (1.0 + np.exp(-total))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        grown = np.array(nodes[first:])
        one = Trees(np.array([0]), grown[:, 0].astype(int), grown[:, 1], grown[:, 2].astype(int) - first,
                    grown[:, 3].astype(int) - first, grown[:, 4], depth, 0.0)
        node = np.zeros(len(y), dtype=int)
        for _ in range(depth):
            node = np.where(x[np.arange(len(y)), one.feature[node]] <= one.threshold[node], one.left[node], one.right[node])
        total += one.value[node]
    flat = np.array(nodes)
    return Trees(np.array(roots), flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int),
                 flat[:, 3].astype(int), flat[:, 4], depth, base)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees | None:
    """Trees from at most `max_rows` labelled documents (a bounded sample: the
    labels whose hashed doc_id comes first); None where a class is missing."""
    some = (labels.select("doc_id", F.col("quality").alias("_y"))
            .where("doc_id IS NOT NULL AND _y IS NOT NULL")
            .orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(max_rows))
    # Rows that repeat count once, and the bound holds for what was joined, too.
    joined = (docs.select("doc_id", "text", text_key("doc_id", "text").alias("_key")).join(F.broadcast(some), "doc_id")
              .groupBy("doc_id", "_key", "_y").agg(F.first("text").alias("text"))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "_key", "_y").limit(max_rows))
    rows = document_stats(joined, "_y").drop("doc_id").toPandas()
    y = (rows["_y"].to_numpy() > 0).astype(float)
    if len(set(y)) < 2:
        return None
    order = np.lexsort(rows[list(STATS)].to_numpy().T)  # sums then do not depend on the order of rows
    return fit_trees(features(rows[list(STATS)].to_numpy()[order]), y[order])


def document_stats(docs: DataFrame, *carry: str) -> DataFrame:
    """(doc_id, carry columns, STATS) of every row."""
    kept = docs.select("doc_id", *carry, "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b[["doc_id", *carry]].reset_index(drop=True), _frame(b["text"])], axis=1)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text")
    return kept.mapInPandas(run, schema + "".join(f", {c} long" for c in STATS))


def _frame(texts: pd.Series) -> pd.DataFrame:
    rows = [text_stats(t) for t in texts]
    return pd.DataFrame(np.array(rows, dtype=np.int64).reshape(-1, len(STATS)), columns=list(STATS))


def _verdict(stats: pd.DataFrame, trees: Trees | None) -> pd.DataFrame:
    failed = (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])
    score = np.ones(len(stats)) if trees is None or stats.empty else trees.score(features(stats[list(STATS)].to_numpy()))
    return stats.assign(base_failed=failed, score=score, kept=~failed & (score >= KEEP_FROM))


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per document: its base statistics, `base_failed`, `kept` and the score."""
    trees = fit(docs, labels, max_rows)
    columns = ["doc_id", *re.findall(r"(\w+) (?:long|boolean|double)", OUT)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["doc_id"]].reset_index(drop=True).join(_verdict(_frame(b["text"]), trees))[columns]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, {OUT}")


def filter_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents that are kept, with all their columns."""
    trees = fit(docs, labels, max_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[_verdict(_frame(b["text"]), trees)["kept"].to_numpy()]
    return docs.mapInPandas(run, docs.schema)
