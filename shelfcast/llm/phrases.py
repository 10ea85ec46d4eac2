"""Collocations by direct-address tiling.

Words that are frequent enough get ids by descending frequency in their
language, so that the pairs of two ids form a square whose corner is dense.  The
ids are cut into bands with about equally many places in the corpus, few ids in
the first band and most in the last, and the square into tiles of two bands: as
many as give a tile some `TILE_PLACES` places.  A chunk of text counts its pairs
tile by tile, a dense tile in an array addressed by the cell (`np.bincount`), a
sparse one as sorted cells with counts; tiles of the chunks are added up the same
way.  Pairs that are frequent enough get ids by descending frequency in turn, and
the same step counts the pairs of overlapping phrases: two pairs that share a
word make a phrase of three, and so on.  A phrase is frequent only if both its
parts are, so that no phrase is lost, and each step looks only at places that the
last one has kept.

On Spark: texts become chunks of word numbers of their own (`CHUNK` words of one
language, whole texts) with their word lists; the lists are counted and ranked,
and each chunk gets back the ids of its own words, never a whole vocabulary.  The
tiles of chunks are added up `FAN` at a time, round after round, so that a dense
tile, which all chunks share, is no task that grows with the corpus.  A chunk
holds at most `CHUNK` words and the last text.

Defined results.  Null text: no words.  Null lang: `und`.  Repeated rows: all
count.  An empty table: no rows.  Texts of any length are whole; a phrase never
crosses a text, nor a piece of it.  Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import text_bytes
from shelfcast.session import materialize

LEAST = 10
LONGEST = 3
TOP = 2_000
INSIDE = (50, 100)  # a phrase goes if a longer one holds this share of it
TILE_PLACES = 2_000_000
ARRAY = 4_000_000  # most cells of a tile that is counted as an array,
FILLED = 16        # where it has one entry at least for so many cells
CHUNK = 400_000
FAN = 32
# Rows are arrays of up to a chunk: few of them in a batch between Spark and Python.
BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "16"}
SPLIT = b".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"

# Of bytes: A-Z to lower case, the characters that split pieces to a line feed, tab to space.
FOLD = bytes(10 if b in SPLIT else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Numbers(dict):
    """Numbers of words in order of their first place, from 1."""

    def __init__(self) -> None:
        super().__init__({b"": -1, b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        return n


def numbered(text: str | None, numbers: Numbers) -> np.ndarray:
    """The numbers of a text's words; 0 ends a piece."""
    tokens = (text_bytes(text).translate(FOLD) + b"\n").replace(b"\n", b" \n ").split(b" ")
    ids = np.fromiter(map(numbers.__getitem__, tokens), dtype=np.int32, count=len(tokens))
    return ids[ids >= 0]


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
    sizes: dict[str, int] = {}

    def close(lang: str) -> pd.DataFrame:
        numbers, parts = held.pop(lang)
        sizes.pop(lang)
        ids = np.concatenate(parts)
        n = np.bincount(ids, minlength=len(numbers) - 1)[1:]
        words = [w.decode("utf-8", "surrogatepass") for w in list(numbers)[2:]]
        return pd.DataFrame({"lang": [lang], "words": [words], "counts": [n.astype(np.int32)], "ids": [ids.tobytes()]})

    for b in batches:
        for lang, text in zip(b["lang"], b["text"]):
            numbers, parts = held.setdefault(lang, (Numbers(), []))
            parts.append(numbered(text, numbers))
            sizes[lang] = sizes.get(lang, 0) + len(parts[-1])
            if sizes[lang] >= CHUNK:
                yield close(lang)
            elif sum(sizes.values()) >= 4 * CHUNK:
                for each in list(held):
                    yield close(each)
    for each in list(held):
        yield close(each)


def ranked(rows: DataFrame, count: str, ties: list[str], name: str) -> DataFrame:
    """`rows` with `id`, places from 0 by descending `count` in each language,
    `before`, the sum of the counts ahead, and the language's `places` (the sum of
    all counts) and `ids`.  Rows are range-partitioned once; places and sums within
    a partition add to the language's in those before it."""
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(count).desc(), *(F.col(c) for c in ties)]
    placed = materialize(rows.repartitionByRange(n_parts, F.col(count).desc(), "lang", *ties)
                         .withColumn("_pid", F.spark_partition_id()), name, BATCH_CONF)
    sizes = placed.groupBy("lang", "_pid").agg(F.count("*").alias("_rows"), F.sum(count).alias("_sum"))
    # One row a language and partition.
    earlier = Window.partitionBy("lang").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("lang")
    ahead = sizes.select("lang", "_pid", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_rows", "_sum")),
                         F.sum("_sum").over(every).alias("places"), F.sum("_rows").over(every).alias("ids"))
    own = Window.partitionBy("lang", "_pid").orderBy(*order)
    return (placed.withColumns({"_own": F.row_number().over(own) - 1, "_upto": F.sum(count).over(
        own.rowsBetween(Window.unboundedPreceding, -1))}).join(ahead, ["lang", "_pid"])
        .withColumns({"id": F.col("_own") + F.col("_rows"), "before": F.coalesce("_upto", F.lit(0)) + F.col("_sum")})
        .drop("_pid", "_own", "_upto", "_rows", "_sum"))


def bands(level: DataFrame) -> DataFrame:
    """(lang, edges) of ranked rows: the first id of each band, and the number
    of ids at the end.  A few numbers a language."""
    n = F.ceil(F.sqrt(F.col("places") / TILE_PLACES))
    band = F.least(F.floor(F.col("before") / F.col("places") * n), n - 1)
    return (level.groupBy("lang", "ids", band.alias("_band")).agg(F.min("id").alias("_first"))
            .groupBy("lang", "ids").agg(F.sort_array(F.collect_list("_first")).alias("_firsts"))
            .select("lang", F.concat("_firsts", F.array(F.col("ids"))).alias("edges")))


# A tile's place: its bands, the first ids of both, and its columns and cells.
PLACE = ["lang", "row", "col", "left0", "right0", "width", "cells"]
PLACE_TYPE = "lang string, row int, col int, left0 long, right0 long, width long, cells long"


def tiles(first: np.ndarray, second: np.ndarray, places: np.ndarray | None, edges: np.ndarray) -> pd.DataFrame:
    """The pairs (first, second) of a chunk by tile: `steps` between its
    ascending cells, their counts, and their places one after another."""
    row, column = (np.searchsorted(edges, x, side="right") - 1 for x in (first, second))
    width = np.diff(edges)
    cell = (first - edges[row]) * width[column] + second - edges[column]
    order = np.argsort(row * len(edges) + column, kind="stable")
    cuts = np.flatnonzero((np.diff(row[order]) != 0) | (np.diff(column[order]) != 0)) + 1
    out = []
    for at in np.split(order, cuts) if len(order) else []:
        r, c, cells = int(row[at[0]]), int(column[at[0]]), cell[at]
        size = int(width[r] * width[c])
        filled = is_dense(len(at), size)
        by = np.argsort(cells, kind="stable") if places is not None or not filled else None
        found, n = dense(cells, size) if filled else sparse(cells[by], np.ones(len(at), dtype=np.int64))
        out.append((r, c, int(edges[r]), int(edges[c]), int(width[c]), size, *packed(found, n),
                    None if places is None else places[at[by]].astype(np.int32).tobytes()))
    return pd.DataFrame(out, columns=[*PLACE[1:], "steps", "counts", "places"])


def is_dense(entries: int, cells: int) -> bool:
    return cells <= ARRAY and entries * FILLED >= cells


def dense(cells: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and counts, by direct address."""
    n = np.bincount(cells, minlength=size)
    found = np.flatnonzero(n)
    return found, n[found]


def sparse(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells and their counts, from sorted ones."""
    starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    return cells[starts], np.add.reduceat(counts, starts)


def packed(cells: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    return np.diff(cells, prepend=0).astype(np.int64).tobytes(), counts.astype(np.int64).tobytes()


def unpacked(steps: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(steps, dtype=np.int64).cumsum(), np.frombuffer(counts, dtype=np.int64)


class Tile:
    """Adds up the counts of one tile of so many cells: sorted cells while they
    are few, an array of all cells from then on."""

    def __init__(self, cells: int) -> None:
        self.cells, self.size = cells, 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.array: np.ndarray | None = None

    def add(self, cells: np.ndarray, counts: np.ndarray) -> None:
        if self.array is not None:
            self.array[cells] += counts  # cells of one part are distinct
            return
        self.parts.append((cells, counts))
        self.size += len(cells)
        if is_dense(self.size, self.cells):
            self.array = np.zeros(self.cells, dtype=np.int64)
            for part in self.parts:
                self.array[part[0]] += part[1]
            self.parts = []

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        if self.array is not None:
            found = np.flatnonzero(self.array)
            return found, self.array[found]
        cells = np.concatenate([c for c, _ in self.parts])
        by = np.argsort(cells, kind="stable")
        return sparse(cells[by], np.concatenate([n for _, n in self.parts])[by])


def _added(names: list[str], result):
    """A function over rows (names, steps, counts) in the order of names: adds
    up each run of equal names, and yields what `result` makes of it."""
    size = names.index("cells")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tile = None, None
        for b in batches:
            for key, steps, counts in zip(zip(*(b[c] for c in names)), b["steps"], b["counts"]):
                if key != now:
                    if now is not None:
                        yield result(now, *tile.counted())
                    now, tile = key, Tile(key[size])
                tile.add(*unpacked(steps, counts))
        if now is not None:
            yield result(now, *tile.counted())
    return _gathered(run)


def _gathered(run, rows: int = 65_536):
    """Small frames of `run` joined to larger ones."""
    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for part in run(batches):
            held.append(part)
            size += len(part) + 100
            if size >= rows:
                yield pd.concat(held)
                held, size = [], 0
        if held:
            yield pd.concat(held)
    return whole


def frequent(counted: DataFrame, least: int, chunks: int) -> DataFrame:
    """(lang, row, col, cell, left, right, a) of the pairs with `least` places
    in all chunks."""
    def part(key: tuple, cells: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame([(*key, *packed(cells, counts))], columns=[*PLACE, "grp", "steps", "counts"])

    def whole(key: tuple, cells: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        lang, row, col, left0, right0, width, _ = key
        some = counts >= least
        cells = cells[some]
        return pd.DataFrame({"lang": lang, "row": row, "col": col, "cell": cells, "left": left0 + cells // width,
                             "right": right0 + cells % width, "a": counts[some]})

    now = counted.select(*PLACE, F.col("chunk").alias("grp"), "steps", "counts")
    groups = chunks
    while groups > FAN:
        groups = -(-groups // FAN)
        grouped = now.withColumn("grp", F.pmod(F.xxhash64("grp"), F.lit(groups)))
        now = materialize(grouped.repartition("lang", "row", "col", "grp").sortWithinPartitions(*PLACE, "grp").mapInPandas(
            _added([*PLACE, "grp"], part), f"{PLACE_TYPE}, grp long, steps binary, counts binary"), "phrase-tiles", BATCH_CONF)
    return now.drop("grp").repartition("lang", "row", "col").sortWithinPartitions(*PLACE).mapInPandas(
        _added(PLACE, whole), "lang string, row int, col int, cell long, left long, right long, a long")


def _sequence_tiles(sequence: dict[str, list], keep: bool) -> Iterator[pd.DataFrame]:
    """Tiles of (chunk, lang, edges, places, ids): pairs of ids at places side by side."""
    for chunk, lang, edges, places, ids in zip(*(sequence[c] for c in ("chunk", "lang", "edges", "places", "ids"))):
        by = np.argsort(places, kind="stable")
        places, ids = places[by], ids[by]
        at = np.flatnonzero(places[1:] == places[:-1] + 1)
        yield tiles(ids[at], ids[at + 1], places[at] if keep else None, np.asarray(edges)).assign(chunk=chunk, lang=lang)[TILE_COLUMNS]


TILES = f"chunk long, {PLACE_TYPE}, steps binary, counts binary, places binary"
TILE_COLUMNS = ["chunk", *PLACE, "steps", "counts", "places"]


def _word_tiles(keep: bool):
    """Tiles of chunks (chunk, lang, edges, ids, at, of), where `of` are the ids
    of the words numbered `at`; other words are skipped."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for chunk, lang, edges, raw, at, of in zip(*(b[c] for c in ("chunk", "lang", "edges", "ids", "at", "of"))):
                numbers = np.frombuffer(raw, dtype=np.int32)
                to = np.full(int(numbers.max(initial=0)) + 1, -1, dtype=np.int64)
                to[at] = of
                ids = to[numbers]
                places = np.flatnonzero(ids >= 0)
                yield from _sequence_tiles({"chunk": [chunk], "lang": [lang], "edges": [edges], "places": [places],
                                            "ids": [ids[places]]}, keep)
    return run


def _phrase_tiles(keep: bool):
    """Tiles of rows (chunk, lang, edges, places, ids) in the order of chunks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []

        def close() -> Iterator[pd.DataFrame]:
            if held:
                chunk, lang, edges = now
                yield from _sequence_tiles({"chunk": [chunk], "lang": [lang], "edges": [edges], "places": [np.concatenate(
                    [p for p, _ in held])], "ids": [np.concatenate([i for _, i in held])]}, keep)

        for b in batches:
            for chunk, lang, edges, places, ids in zip(*(b[c] for c in ("chunk", "lang", "edges", "places", "ids"))):
                if now is None or now[0] != chunk:
                    yield from close()
                    now, held = (chunk, lang, edges), []
                held.append((np.frombuffer(places, dtype=np.int32), np.frombuffer(ids, dtype=np.int64)))
        yield from close()
    return run


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places of the frequent cells (`often`, ascending, with `ids`) in each tile."""
    for b in batches:
        out = []
        for chunk, lang, steps, counts, places, often, ids in zip(*(b[c] for c in (
                "chunk", "lang", "steps", "counts", "places", "often", "ids"))):
            found, n = unpacked(steps, counts)
            at = np.minimum(np.searchsorted(often, found), len(often) - 1)
            hit = often[at] == found
            if hit.any():
                each = np.repeat(np.where(hit, ids[at], -1), n)
                out.append((chunk, lang, np.frombuffer(places, dtype=np.int32)[each >= 0].tobytes(),
                            each[each >= 0].astype(np.int64).tobytes()))
        yield pd.DataFrame(out, columns=["chunk", "lang", "places", "ids"])


def _score(a: str, prefix: str, suffix: str, m: int) -> Column:
    """The cut with the least score: struct (score, k, l, r)."""
    each = [F.expr(f"""struct(CAST(1000000 AS DECIMAL(7,0)) * CAST({a} AS DECIMAL(18,0)) * CAST({a} AS DECIMAL(18,0))
              DIV (CAST({prefix}[{k - 1}] AS DECIMAL(18,0)) * CAST({suffix}[{m - k - 1}] AS DECIMAL(18,0))) AS score,
              {k} AS k, {prefix}[{k - 1}] AS l, {suffix}[{m - k - 1}] AS r)""") for k in range(1, m)]
    return F.array_min(F.array(*each))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each
    language with 2 to `longest` words and `least` places."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")
    chunked = texts.mapInPandas(_chunks, "lang string, words array<string>, counts array<int>, ids binary")
    chunks = materialize(chunked.withColumn("chunk", F.monotonically_increasing_id()), "phrase-chunks")
    n_chunks = chunks.count()
    lists = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("_at", "_w")).select(
        "chunk", "lang", (F.col("_at") + 1).alias("at"), F.col("_w.words").alias("text"), F.col("_w.counts").cast("long").alias("n"))
    words = lists.groupBy("lang", "text").agg(F.sum("n").alias("a"))
    totals = lists.groupBy("lang").agg(F.sum("n").alias("n"))
    level = materialize(ranked(words.where(F.col("a") >= least), "a", ["text"], "phrase-words").select(
        "lang", "id", "a", "before", "places", "ids", "text", F.col("text").alias("last"), F.array("a").alias("prefix"), F.array("a").alias("suffix")),
        "phrase-level")

    # A chunk's list is no longer than the chunk.
    own = (lists.select("chunk", "lang", "at", "text").join(level.select("lang", "text", "id"), ["lang", "text"])
           .groupBy("chunk").agg(F.collect_list(F.struct("at", "id")).alias("_o"))
           .select("chunk", F.col("_o.at").alias("at"), F.col("_o.id").alias("of")))
    # Chunks meet their language's bands by key: no chunk is dealt by language.
    edges = lambda of: chunks.select("chunk", "lang").join(bands(of), "lang").select("chunk", "edges")
    counted = materialize(chunks.select("chunk", "lang", "ids").join(own, "chunk").join(edges(level), "chunk").mapInPandas(
        _word_tiles(longest > 2), TILES), "phrase-pairs", BATCH_CONF)

    found = None
    tile = ["lang", "row", "col"]
    for m in range(2, longest + 1):
        pairs = ranked(frequent(counted, least, n_chunks), "a", ["left", "right"], f"phrase-{m}")
        part = lambda side: level.select(
            "lang", *(F.col(c).alias(f"{side}_{c}") for c in ("text", "last", "prefix", "suffix")), F.col("id").alias(side))
        longer = materialize(pairs.join(part("left"), ["lang", "left"]).join(part("right"), ["lang", "right"]).select(
            "lang", "id", "a", "before", "places", "ids", "row", "col", "cell", "left", "right",
            F.concat_ws(" ", "left_text", "right_last").alias("text"),
            F.col("right_last").alias("last"), F.concat("left_prefix", F.array("a")).alias("prefix"),
            F.concat("right_suffix", F.array("a")).alias("suffix")), "phrase-level")
        if m > 2:
            # Those inside a phrase with enough of their places go.
            inside = (longer.select("lang", F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("_in"))
                      .groupBy("lang", "id").agg(F.max("_in").alias("_in")))
            kept = level.join(inside, ["lang", "id"], "left").where(
                F.col("_in").isNull() | (F.col("_in") * INSIDE[1] < F.col("a") * INSIDE[0]))
            found = _scored(kept, m - 1, found)
        level = longer
        if m == longest:
            break
        # A tile has a bounded number of places, and fewer frequent cells.
        cells = (longer.groupBy(*tile).agg(F.sort_array(F.collect_list(F.struct("cell", "id"))).alias("_c"))
                 .select(*tile, F.col("_c.cell").alias("often"), F.col("_c.id").alias("ids")))
        places = counted.join(cells, tile).select("chunk", "lang", "steps", "counts", "places", "often", "ids").mapInPandas(
            _kept, "chunk long, lang string, places binary, ids binary")
        counted = materialize(places.repartition("chunk").join(edges(longer), "chunk").sortWithinPartitions("chunk").mapInPandas(
            _phrase_tiles(m + 1 < longest), TILES), "phrase-pairs", BATCH_CONF)
    found = _scored(level, longest, found)

    best = Window.partitionBy("lang").orderBy(F.col("_s.score").desc(), F.col("a").desc(), "phrase")
    first = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a",
                                             F.col("_s.l").alias("l"), F.col("_s.r").alias("r"), "n",
                                             F.col("_s.score").cast("long").alias("score"))


def _scored(level: DataFrame, m: int, before: DataFrame | None) -> DataFrame:
    rows = level.select("lang", F.col("text").alias("phrase"), "a", _score("a", "prefix", "suffix", m).alias("_s"))
    return rows if before is None else before.unionByName(rows)
