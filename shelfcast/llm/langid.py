"""Language identification by cross-parsing entropy.

A suffix automaton of a bounded sample of each language's labelled text
(`sample_chars` characters a language, `total_chars` over all languages)
accepts exactly the substrings of that sample.  A text is parsed left to right
into longest matches: a phrase ends where the automaton has no transition.
The number of phrases times log2 of the sample's length, per character, is the
cross-parsing estimate of the entropy; the language with the least one wins.

Every character of the samples has a number of its own, whatever the scripts
and however many there are.  The automata are one sparse table (state,
character), so its size follows the samples' length and not their alphabet,
and a batch of texts is parsed in step: texts are cut into segments of `segment`
characters, which all advance by one character at a time, each in every
language's automaton.  A phrase ends with its segment; whole texts are parsed.

The sample of a language is its distinct texts, in the order of a hash, until
they fill the language's share of characters: copies count once, and a language
of short texts is learned from as many of them as it takes.

Defined results.  Null text, or no letter in it: `und` with score 0.  Without
learned languages every text is `und`.  Null doc_id: not learned from, not held
out.  Repeated rows: one result each.  Ties go to the first language by code
point.  Other columns of the input are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_CHARS = 40_000
TOTAL_CHARS = 320_000
SEGMENT = 512
# Segments parsed together: bounds the memory of a step.
TOGETHER = 8192


def _class(*categories: str, top: int = sys.maxunicode) -> str:
    """The code points up to `top` of some general categories (their first
    letters), as the ranges of a character class."""
    points = [c for c in range(top + 1) if unicodedata.category(chr(c))[0] in categories]
    cuts = [i for i in range(1, len(points)) if points[i] != points[i - 1] + 1]
    return "".join(f"\\U{points[a]:08x}-\\U{points[z - 1]:08x}" for a, z in zip([0, *cuts], [*cuts, len(points)]))


# A letter is of category L; numbers that look like one (superscripts, Roman or
# circled ones) are not.
LETTER = re.compile(f"[{_class('L')}]")
# All but letters and marks is one space to the automata, so that digits and symbols
# say nothing about the language, and vowel signs stay with their letters.
OTHER = re.compile(f"[^{_class('L', 'M')}]+")
# The same for texts without code points beyond 16 bits, whose class is a table.
FAR = re.compile("[\U00010000-\U0010ffff]")
OTHER_NEAR = re.compile(f"[^{_class('L', 'M', top=0xFFFF)}]+")


def plain(text: str) -> str:
    low = text.lower()
    return (OTHER if FAR.search(low) else OTHER_NEAR).sub(" ", low)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Moves:
    """Transitions (state, code) -> state as a sparse table: a state's row of
    codes is laid over the others' from the slot `base` on, where its own
    codes' slots are free, so a look-up is one place and a check of its owner."""

    #: Slots a transition, and tries to find a row's place among the others.
    ROOM, TRIES = 2, 32

    def __init__(self, states: int, codes: int, source: np.ndarray, code: np.ndarray, to: np.ndarray) -> None:
        """Transitions come in the order of their sources."""
        degree = np.bincount(source, minlength=states)
        first = np.cumsum(degree) - degree
        room = self.ROOM * len(source) + 1
        base, rng = np.zeros(states, dtype=np.int32), np.random.default_rng(0)
        owner, places = np.full(room + codes, -1, dtype=np.int32), np.zeros(len(source), dtype=np.int64)
        # Rows of similar length together, the longest first.
        rank = np.where(degree > 0, np.int64(np.log2(np.maximum(degree, 1))), -1)
        for k in range(int(rank.max(initial=-1)), -1, -1):
            left = np.flatnonzero(rank == k)
            for _ in range(self.TRIES):
                if not len(left):
                    break
                n = degree[left]
                edges = np.repeat(first[left] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                base[left] = rng.integers(0, room, size=len(left))
                slots = base[source[edges]] + code[edges]
                free = owner[slots] < 0
                owner[slots[free]] = source[edges][free]  # of two rows, the last one's
                lost = np.zeros(states, dtype=bool)
                lost[source[edges][~free | (owner[slots] != source[edges])]] = True
                back = lost[source[edges]] & (owner[slots] == source[edges]) & free
                owner[slots[back]] = -1
                left = left[lost[left]]
            # Rows that found no place go behind all others.
            base[left] = len(owner) + codes * np.arange(len(left))
            owner = np.concatenate([owner, np.full(codes * len(left), -1, dtype=np.int32)])
            for s in left:
                owner[base[s] + code[first[s]:first[s] + degree[s]]] = s
        places = base[source] + code
        self.base, self.owner, self.to = base, owner, np.zeros(len(owner), dtype=np.int32)
        assert (owner[places] == source).all()
        self.to[places] = to

    def __getitem__(self, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The states that (states, codes) lead to; -1 where there is no move."""
        state, code = at
        slots = self.base[state] + code
        return np.where(self.owner[slots] == state, self.to[slots], -1)


def transitions(text: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix automaton of a text of codes: its number of states, and the
    source, code and target of each transition, in the order of the sources."""
    size = 2 * len(text) + 2
    move: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        me = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in move[p]:
            move[p][c] = me
            p = link[p]
        if p != -1:
            q = move[p][c]
            if length[p] + 1 == length[q]:
                link[me] = q
            else:
                twin = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and move[p].get(c) == q:
                    move[p][c] = twin
                    p = link[p]
                link[q] = link[me] = twin
        last = me
    assert len(move) <= size
    source = np.repeat(np.arange(len(move), dtype=np.int32), [len(out) for out in move])
    code = np.array([c for out in move for c in out], dtype=np.int32)
    to = np.array([t for out in move for t in out.values()], dtype=np.int32)
    return len(move), source, code, to


def automaton(text: np.ndarray, classes: int) -> Moves:
    """The suffix automaton of a text of codes (1 .. classes-1; 0 matches
    nothing), by (state, code); -1 where there is no move."""
    states, source, code, to = transitions(text)
    return Moves(states, classes, source, code, to)


class Parser:
    """The languages' automata in one table, and the parse of batches."""

    def __init__(self, samples: tuple[tuple[str, str], ...], segment: int = SEGMENT) -> None:
        self.segment = segment
        self.langs = [k for k, _ in samples]
        texts = [plain(t) for _, t in samples]
        # All characters of the samples, which are bounded.
        self.points = np.array(sorted({ord(c) for t in texts for c in t}), dtype=np.uint32)
        self.kind = np.min_scalar_type(len(self.points))
        found, roots, at = [], [], 0
        for t in texts:
            states, source, code, to = transitions(self._codes(t))
            found.append((source + at, code, to + at))
            roots.append(at)
            at += states
        self.moves = Moves(at, len(self.points) + 1, *(np.concatenate(x) for x in zip(*found)))
        self.roots = np.array(roots, dtype=np.int32)
        self.bits = np.log2(np.maximum([len(t) for t in texts], 2))

    def _codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, at + 1, 0).astype(self.kind)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text in each language's automaton."""
        codes = [self._codes(plain(t)) for t in texts]
        owner = np.repeat(np.arange(len(codes)), [-(-len(c) // self.segment) for c in codes])
        segments = [c[k:k + self.segment] for c in codes for k in range(0, len(c), self.segment)]
        found = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        order = np.argsort([-len(s) for s in segments], kind="stable")
        for k in range(0, len(order), TOGETHER):
            some = order[k:k + TOGETHER]
            np.add.at(found, owner[some], self._parse([segments[i] for i in some]))
        return found

    def _parse(self, segments: list[np.ndarray]) -> np.ndarray:
        """Segments come longest first, so that those still running lead."""
        sizes = np.array([len(s) for s in segments])
        steps = np.zeros((int(sizes[0]), len(segments)), dtype=np.int32)
        for i, s in enumerate(segments):
            steps[:len(s), i] = s
        running = np.searchsorted(-sizes, -np.arange(1, len(steps) + 1), side="right")
        start = np.repeat(self.roots[:, None], len(segments), axis=1)
        state, count = start.copy(), np.zeros(start.shape, dtype=np.int64)
        for codes, n in zip(steps, running):
            c = codes[:n]
            nxt = self.moves[state[:, :n], c]
            lost = nxt < 0
            again = self.moves[start[:, :n][lost], np.broadcast_to(c, lost.shape)[lost]]
            # A character that the sample lacks is a phrase of its own, beside
            # the one that it may end.
            count[:, :n] += lost
            count[:, :n][lost] += (again < 0) & (state[:, :n][lost] != start[:, :n][lost])
            nxt[lost] = np.where(again < 0, start[:, :n][lost], again)
            state[:, :n] = nxt
        return (count + (state != start)).T

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        given = [t or "" for t in texts]
        cost = self.phrases(given) * self.bits
        best = cost.argmin(axis=1)
        rows = np.arange(len(given))
        least = cost[rows, best]
        others = cost.copy()
        others[rows, best] = np.inf
        second = others.min(axis=1) if cost.shape[1] > 1 else 2 * least + 1
        sure = np.clip(1 - least / np.maximum(second, 1e-9), 0, 1)
        known = np.array([bool(LETTER.search(t)) for t in given])
        return [self.langs[b] if k else "und" for b, k in zip(best, known)], np.where(known, sure, 0.0)


@lru_cache(maxsize=2)
def _parser(samples: tuple[tuple[str, str], ...], segment: int) -> Parser:
    return Parser(samples, segment)


def samples(docs: DataFrame, sample_chars: int = SAMPLE_CHARS, total_chars: int = TOTAL_CHARS) -> tuple[tuple[str, str], ...]:
    """A bounded sample of labelled text per language, in the order of the
    languages' code points: of documents that are not held out, the distinct texts
    whose hash comes first, up to the language's share of characters."""
    from shelfcast.session import materialize
    known = docs.select("doc_id", "text", "lang").where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}"))
    langs = known.select("lang").distinct().count()
    size = min(sample_chars, total_chars // max(1, langs))
    hashes = known.select("lang", F.length("text").alias("_n"), F.xxhash64("text").alias("_h"), F.xxhash64("text", F.lit(1)).alias("_h2"))
    distinct = hashes.groupBy("lang", "_h", "_h2").agg(F.min("_n").alias("_n"))
    order = Window.partitionBy("lang").orderBy("_h", "_h2")
    # A text has a character at least, so that as many texts as characters do;
    # they are ranked by hash alone, and fetched after.
    first = distinct.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= size)
    ahead = Window.partitionBy("lang").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("_left", F.lit(size) - F.coalesce(F.sum("_n").over(ahead), F.lit(0))).where("_left > 0")
    picked = (known.withColumns({"_h": F.xxhash64("text"), "_h2": F.xxhash64("text", F.lit(1))})
              .join(F.broadcast(first.select("lang", "_h", "_h2", "_r", "_left")), ["lang", "_h", "_h2"])
              .groupBy("lang", "_r").agg(F.first(F.substring("text", F.lit(1), F.col("_left").cast("int"))).alias("text")))
    texts: dict[str, list[str]] = {}
    for row in materialize(picked, "langid").orderBy("lang", "_r").collect():  # size characters a language
        texts.setdefault(row["lang"], []).append(row["text"])
    return tuple((k, "\n".join(texts[k])[:size]) for k in sorted(texts))


def identify(docs: DataFrame, sample_chars: int = SAMPLE_CHARS, total_chars: int = TOTAL_CHARS,
             segment: int = SEGMENT) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    learned = samples(docs, sample_chars, total_chars)
    shared = docs.sparkSession.sparkContext.broadcast(learned)  # bounded by total_chars

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(b["text"])
            if shared.value:
                lang, score = _parser(shared.value, segment).predict(texts)
            else:
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
            yield b[["doc_id", "held_out"]].assign(lang_pred=lang, score=score)
    kept = docs.select("doc_id", held_out().alias("held_out"), "text")
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
