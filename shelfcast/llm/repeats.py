"""Exact repeats over all texts: a run-length index of the repetitive parts.

Every byte covered by a `MIN_LEN`-byte string (a window) that also starts
elsewhere is removed; windows do not cross texts.

1. Anchors.  A window's key is the least hash of its `GRAM`-byte strings, so
   equal windows have equal keys, and consecutive windows mostly share one: a
   run.  Only runs whose key has another place in the corpus stay.  The same
   with a shorter span (`SPAN`) then drops windows in which a part is unique:
   what is left is repeated almost everywhere, however common a short line in
   unlike texts may be.
2. Index.  The strings of the remaining runs meet by key, equal ones counted
   as one.  A chunk of strings is sorted by suffix, its Burrows-Wheeler
   transform is cut into runs of equal characters, and only the suffixes at run
   ends are sampled with the length they share with the next suffix in order.
   Everywhere else that length is the one at the text position before, less one
   (the transform's characters are equal there), so one pass over the strings
   streams the matching statistics: the longest match elsewhere, at every
   position.  A window is repeated where that is `MIN_LEN` or more, or its
   string occurred twice.
3. Cover.  Repeated windows return to their texts and cover bytes.

Keys are hashes of content; those of a group of copies are counted before the
shuffle, and their strings become one.  A key whose distinct strings exceed
`GROUP_BYTES` is split: its windows are keyed by a hash of the whole window, so
that equal ones still meet.

Defined results.  Null text: as the empty text.  Texts shorter than `MIN_LEN`:
nothing is removed.  Null doc_id: takes part.  Repeated rows: each counts as a
text, so a long text that is there twice is removed in both.  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.session import materialize

MIN_LEN = 200
GRAM = 32
SPAN = 96
CHUNK_BYTES = 1 << 17
GROUP_BYTES = 8 << 20
# First sorting depth of suffixes; doubled until it exceeds the longest string,
# MIN_LEN bytes for the first window and one more for each further window.
DEPTH = 7
MOST_WINDOWS = MIN_LEN - GRAM + 1


def gram_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each position."""
    n = len(raw) - GRAM + 1
    words = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    h = np.full(n, 0x9E3779B97F4A7C15, dtype=np.uint64)
    for k in range(0, GRAM, 8):
        h ^= words[k:k + n]
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def runs(raw: bytes, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts of `span`-byte strings that share their least gram hash:
    key, end (exclusive; the next run begins there), and 2 where the key's gram
    stands twice or more within the run's reach, else 1."""
    if len(raw) < span:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.int32), none.astype(np.int32)
    h, width = gram_hashes(raw), span - GRAM + 1
    least = _window_min(h, width)
    ends = np.append(np.flatnonzero(least[1:] != least[:-1]) + 1, len(least))
    starts = np.append(0, ends[:-1])
    keys = least[starts]
    # Occurrences of the key among the grams of the run's strings: those that
    # begin a string, and those after the start of the last string, which has
    # some only if a smaller key ends the run (or the text does).
    count = np.add.reduceat((h[:len(least)] == least).astype(np.int32), starts)
    more = np.flatnonzero(np.append(keys[1:] < keys[:-1], True))
    count[more] += (h[ends[more, None] + np.arange(width - 1)] == keys[more, None]).sum(axis=1)
    return keys.view(np.int64), ends.astype(np.int32), np.minimum(count, 2).astype(np.int32)


def _keyed(docs: DataFrame) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    # Hashes skip nulls, so that these are told apart by flags.
    parts = ["doc_id", F.isnull("doc_id"), "text", F.isnull("text")]
    return docs.select("doc_id", F.xxhash64(*parts).alias("_k1"), F.xxhash64(F.lit(7), *parts).alias("_k2"), raw.alias("_raw"))


def _run_table(rows: DataFrame, column: str, carry: list[str], span: int, name: str) -> DataFrame:
    """(carry, hs, ends, ns, _row) of each row with a string of `span` bytes."""
    kept = rows.where(F.octet_length(column) >= span).select(*carry, F.col(column).alias("_of"))
    out = [*carry, "hs", "ends", "ns"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [runs(raw, span) for raw in b["_of"]]
            for k, c in enumerate(("hs", "ends", "ns")):
                b[c] = [f[k] for f in found]
            yield b[out]
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept.schema if f.name != "_of")
    made = kept.mapInPandas(run, schema + "hs array<long>, ends array<int>, ns array<int>")
    return materialize(made.withColumn("_row", F.monotonically_increasing_id()), name)


def _shared(table: DataFrame) -> DataFrame:
    """(_row, js): the runs of a row whose key has another place."""
    again = (table.select(F.explode(F.arrays_zip("hs", "ns")).alias("r")).groupBy(F.col("r.hs").alias("h"))
             .agg(F.sum("r.ns").alias("_n")).where("_n > 1").select("h"))
    every = table.select("_row", F.posexplode("hs").alias("j", "h"))
    # A row's runs are as many as its text is long.
    return every.join(again, "h", "left_semi").groupBy("_row").agg(F.collect_list("j").alias("js"))


def regions(docs: DataFrame) -> DataFrame:
    """(_k1, _k2, start, raw, keys, ends): stretches of texts all whose windows
    have a key with another place, and the runs of these windows."""
    first = _run_table(_keyed(docs), "_raw", ["_k1", "_k2"], MIN_LEN, "repeat-runs")
    alive = (first.join(_shared(first), "_row").groupBy("_k1", "_k2")  # equal rows have equal runs
             .agg(F.first(F.struct("hs", "ends", "js")).alias("r")).select("_k1", "_k2", "r.*"))
    both = _keyed(docs).drop("doc_id").join(alive, ["_k1", "_k2"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k1, k2, raw, hs, ends, js in zip(b["_k1"], b["_k2"], b["_raw"], b["hs"], b["ends"], b["js"]):
                js = np.sort(js)
                for group in np.split(js, np.flatnonzero(np.diff(js) > 1) + 1):
                    start = int(ends[group[0] - 1]) if group[0] else 0
                    rows.append((k1, k2, start, raw[start:int(ends[group[-1]]) - 1 + MIN_LEN],
                                 hs[group], ends[group] - start))
            yield pd.DataFrame(rows, columns=["_k1", "_k2", "start", "raw", "keys", "kends"])
    return materialize(both.mapInPandas(
        run, "_k1 long, _k2 long, start int, raw binary, keys array<long>, kends array<int>"), "repeat-regions")


def _alive_windows(ends: np.ndarray, js: np.ndarray) -> np.ndarray:
    """Whether each window's shorter strings all lie in runs of `js`."""
    dead = np.ones(len(ends), dtype=bool)
    dead[js] = False
    by_start = np.repeat(dead, np.diff(ends, prepend=0))
    seen = np.append(0, by_start.cumsum())
    width = MIN_LEN - SPAN + 1
    return seen[width:] == seen[:-width]


def strings(found: DataFrame) -> DataFrame:
    """(key, s, s1, s2, _k1, _k2, start): the strings of the windows left."""
    second = _run_table(found, "raw", ["_k1", "_k2", "start", "raw", "keys", "kends"], SPAN, "repeat-spans")
    both = second.drop("hs", "ns").join(_shared(second), "_row")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k1, k2, start, raw, keys, kends, ends, js in zip(*(b[c] for c in (
                    "_k1", "_k2", "start", "raw", "keys", "kends", "ends", "js"))):
                alive = _alive_windows(ends, js)
                owner = np.repeat(np.arange(len(keys)), np.diff(kends, prepend=0))
                owner = np.where(alive, owner, -1)
                cuts = np.append(0, np.flatnonzero(owner[1:] != owner[:-1]) + 1)
                stops = np.append(cuts[1:], len(owner))
                for a, z in zip(cuts[owner[cuts] >= 0], stops[owner[cuts] >= 0]):
                    for k in range(a, z, MOST_WINDOWS):
                        rows.append((keys[owner[a]], raw[k:min(z, k + MOST_WINDOWS) - 1 + MIN_LEN], k1, k2, start + k))
            yield pd.DataFrame(rows, columns=["key", "s", "_k1", "_k2", "start"])
    made = both.mapInPandas(run, "key long, s binary, _k1 long, _k2 long, start int")
    return materialize(made.withColumns({"s1": F.xxhash64("s"), "s2": F.xxhash64(F.lit(7), "s")}), "repeat-strings")


def matching_statistics(texts: list[bytes], least: int = 0) -> list[np.ndarray]:
    """For each position of each text, the length of the longest match that
    starts there and at another place of the texts, from a run-length index.
    Lengths under `least` may come out too small."""
    lengths = np.array([len(t) for t in texts])
    total = int(lengths.sum())
    chars = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64) + 1
    first = np.append(0, lengths.cumsum()[:-1])
    end = np.repeat((first + lengths).astype(np.int32), lengths)
    at = np.arange(total, dtype=np.int32)

    # Suffixes by their first characters; 0 stands beyond a text's end.
    key = chars.copy()
    for k in range(1, DEPTH):
        key <<= 9
        key[:total - k] += np.where(at[:total - k] + k < end[:total - k], chars[k:], 0)
    order = np.argsort(key, kind="stable").astype(np.int32)
    in_order = key[order]
    new = np.append(True, in_order[1:] != in_order[:-1])
    # A suffix's rank is the place of the first one that equals it so far.
    rank = np.empty(total, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    ranks, depth = [(DEPTH, rank)], DEPTH
    tied = at[~(new & np.append(new[1:], True))]
    while True:
        # Only ties that go on within their texts are sorted further.
        who = order[tied]
        tied = tied[end[who] - who >= depth]
        if not len(tied):
            break
        who = order[tied]
        ahead = who + depth
        key = rank[who].astype(np.int64) << 32 | np.where(ahead < end[who], rank[np.minimum(ahead, total - 1)] + 1, 0)
        by_key = np.argsort(key, kind="stable")
        order[tied] = who[by_key]
        key = key[by_key]
        new = np.append(True, key[1:] != key[:-1])
        rank = rank.copy()
        # Ties of one rank are side by side, so places count on from theirs.
        rank[order[tied]] = np.maximum.accumulate(np.where(new, tied, 0))
        depth *= 2
        ranks.append((depth, rank))
        tied = tied[~(new & np.append(new[1:], True))]
    # The transform: the character before each suffix in order; -1 at a text's
    # start, which equals no other.
    before = np.append(0, chars[:-1]).astype(np.int16)
    before[first] = -1
    bwt = before[order]
    same = (bwt[1:] == bwt[:-1]) & (bwt[1:] >= 0)
    heads = np.flatnonzero(~np.append(False, same))
    ends = np.flatnonzero(~np.append(same, False))

    def shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common prefix lengths of suffixes x and y, by their ranks."""
        done = np.zeros(len(x), dtype=np.int32)
        some = np.arange(len(x))
        for d, r in ranks:
            if d <= least:  # most neighbours differ here, and are not looked at further
                some = some[r[x[some]] == r[y[some]]]
        x, y = x[some], y[some]
        most, got = np.minimum(end[x] - x, end[y] - y), np.zeros(len(x), dtype=np.int32)
        for d, r in reversed(ranks):
            open_ = np.flatnonzero(got < most)
            open_ = open_[r[x[open_] + got[open_]] == r[y[open_] + got[open_]]]
            got[open_] += d
        # What is left differs within the first sorting depth.
        for _ in range(DEPTH):
            open_ = np.flatnonzero(got < most)
            open_ = open_[chars[x[open_] + got[open_]] == chars[y[open_] + got[open_]]]
            got[open_] += 1
        done[some] = np.minimum(got, most)
        return done

    def stream(places: np.ndarray, other: int) -> np.ndarray:
        """Match lengths with the neighbour in order at `other`, from the
        samples at run ends, along the texts."""
        sampled = np.full(total, -1, dtype=np.int32)
        sampled[order[places]] = 0
        some = places[(places + other >= 0) & (places + other < total)]
        sampled[order[some]] = shared(order[some], order[some + other])
        last = np.maximum.accumulate(np.where(sampled >= 0, at, 0))
        return sampled[last] - (at - last)

    longest = np.maximum(stream(heads, -1), stream(ends, 1))
    return np.split(longest, first[1:])


def repeated_windows(texts: list[bytes], counts: np.ndarray) -> list[np.ndarray]:
    """For each text, from/to pairs of its windows that have another place."""
    out = []
    for text, count, longest in zip(texts, counts, matching_statistics(texts, MIN_LEN)):
        hit = (longest[:len(text) - MIN_LEN + 1] >= MIN_LEN) | (count > 1)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
        out.append(edge.astype(np.int32))
    return out


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Index chunks of whole keys, which come in order."""
    held: list[pd.DataFrame] = []
    size = 0

    def flush() -> Iterator[pd.DataFrame]:
        if held:
            b = pd.concat(held) if len(held) > 1 else held[0]
            b = b.assign(spans=repeated_windows(list(b["s"]), b["n"].to_numpy()))
            yield b.loc[b["spans"].map(len) > 0, ["s1", "s2", "off", "spans"]]

    for b in batches:
        if b.empty:
            continue
        lengths, keys = b["s"].map(len).to_numpy(), b["key"].to_numpy()
        if held and held[-1]["key"].iloc[-1] != keys[0] and size >= CHUNK_BYTES:
            yield from flush()
            held, size = [], 0
        begin = 0
        for k in np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(b)):
            # At a change of key: close the chunk if it is full.
            if size + lengths[begin:k].sum() >= CHUNK_BYTES and k < len(b):
                held.append(b.iloc[begin:k])
                yield from flush()
                held, size, begin = [], 0, k
        held.append(b.iloc[begin:])
        size += int(lengths[begin:].sum())
    yield from flush()


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The windows of strings, each a string of its own."""
    for b in batches:
        for s1, s2, s, n in zip(b["s1"], b["s2"], b["s"], b["n"]):
            offs = np.arange(len(s) - MIN_LEN + 1)
            yield pd.DataFrame({"s": [s[k:k + MIN_LEN] for k in offs], "s1": s1, "s2": s2, "off": offs, "n": n})


def marks(every: DataFrame) -> DataFrame:
    """(s1, s2, off, spans): repeated windows of the distinct strings."""
    distinct = materialize(every.groupBy("key", "s", "s1", "s2").agg(F.count("*").alias("n")), "repeat-distinct")
    large = distinct.groupBy("key").agg(F.sum(F.octet_length("s")).alias("_size")).where(F.col("_size") > GROUP_BYTES)
    few = distinct.join(large, "key", "left_anti").withColumn("off", F.lit(0))
    many = (distinct.join(large, "key", "left_semi").mapInPandas(_windows, "s binary, s1 long, s2 long, off int, n long")
            .withColumn("key", F.xxhash64("s")))
    columns = ["key", "s", "s1", "s2", "off", "n"]
    dealt = few.select(columns).unionByName(many.select(columns)).repartition("key").sortWithinPartitions("key")
    return dealt.mapInPandas(_index, "s1 long, s2 long, off int, spans array<int>")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row: `kept` is the
    text's bytes that are left."""
    every = strings(regions(docs))
    covered = (every.select("s1", "s2", "_k1", "_k2", "start").join(marks(every), ["s1", "s2"])
               .select("_k1", "_k2", F.transform("spans", lambda x: x + F.col("start") + F.col("off")).alias("at"))
               # A set: equal rows bring equal spans, however many they are.
               .groupBy("_k1", "_k2").agg(F.flatten(F.collect_set("at")).alias("at")))
    both = _keyed(docs).join(materialize(covered, "repeat-cover"), ["_k1", "_k2"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([_cover(*x) for x in zip(b["doc_id"], b["_raw"], b["at"])],
                               columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.select("doc_id", "_raw", "at").mapInPandas(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def _cover(doc_id, raw: bytes, at: np.ndarray | None) -> tuple:
    if at is None:
        return doc_id, len(raw), 0, 0, raw
    edges = np.zeros(len(raw) + 1, dtype=np.int64)
    np.add.at(edges, at[0::2], 1)
    np.add.at(edges, at[1::2] - 1 + MIN_LEN, -1)
    gone = edges[:-1].cumsum() > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
    return doc_id, len(raw), int(gone.sum()), spans, kept
