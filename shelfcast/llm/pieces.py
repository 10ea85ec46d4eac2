"""SentencePiece segmentations, sampled without replacement, and their decoding.

The pieces of a public SentencePiece model span a lattice over a text: a path
is a segmentation, its probability the product of its pieces' (Zipf's law over
the model's order of pieces, to the power `alpha`), normalised over all paths.
A character that is no piece is spelled in the model's byte pieces.

`encode` returns the `k` segmentations of the largest Gumbel-perturbed
log-probabilities, a sample without replacement.  The search is best first over
the lattice, from a perturbed bound: the root's is a Gumbel variable, the best
child of a node inherits the node's, and all other children together, whose
largest perturbation is again one Gumbel variable truncated at the node's, wait
on the agenda.  The agenda's best entry becomes the next segmentation: it
follows the earlier one up to that node, takes another child, and from there on
draws anew.  With kappa the bound of the agenda after the k-th, a segmentation's
inclusion score is 1 - exp(-exp(log p - kappa)).

No piece crosses from a non-space to a space, so the lattice of a text is the
product of its words' lattices.  A batch's distinct words are matched against
the piece trie, summed forward, and all occurrences draw their paths backward
together, one piece a step, in NumPy.  Uniform variables are a hash of the row
key, the segmentation, the word's number and the step, so results do not depend
on batches or partitions.

Defined results.  Null or empty text: one segmentation without pieces.  Fewer
than k segmentations: all of them, with score 1.  A text decodes to itself
exactly; the space mark itself (U+2581) in a text is spelled in bytes.  Null
doc_id: kept.  Repeated rows: equal results.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# A code beyond Unicode for a mark that is part of a text.
REAL_MARK = 0x110000
# Characters that are searched together: bounds the memory of a step, some 100
# bytes a character.
TOGETHER = 2_000_000
# -log(-log u) of the largest uniform variable: no perturbation exceeds its
# location by more.
MOST_GUMBEL = 38.0
# Steps of a path that are looked at together.
STEPS = 80


class Pieces:
    """The pieces of a model: a trie in sorted arrays, log-probabilities, bytes."""

    def __init__(self, path: str, alpha: float) -> None:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        names = {i: model.id_to_piece(i) for i in plain}
        order = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-model.get_score(i), i)))}
        weight = np.zeros(n)
        weight[plain] = [-np.log(10 + order[i]) for i in plain]
        self.bytes_ = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        weight[self.bytes_] = -np.log(10 + n)
        self.logp = alpha * weight
        self.text = [b""] * n
        for i, name in names.items():
            self.text[i] = name.replace(MARK, " ").encode()
        for b, i in enumerate(self.bytes_):
            self.text[i] = bytes([b])
        edges: dict[tuple[int, int], int] = {}
        self.size = np.array([len(t) for t in self.text], dtype=np.int32)
        self.start = (self.size.cumsum() - self.size).astype(np.int32)
        self.flat = np.frombuffer(b"".join(self.text), dtype=np.uint8)
        ends = [-1]
        for i, name in names.items():
            state = 0
            for c in name:
                nxt = edges.setdefault((state, ord(c)), len(ends))
                if nxt == len(ends):
                    ends.append(-1)
                state = nxt
            ends[state] = i
        self.terminal = np.array(ends, dtype=np.int32)
        # Characters of pieces by number, others 0; edges by (state, character)
        # in an open hash table.
        points = sorted({c for _, c in edges})
        self.number = np.zeros(REAL_MARK + 1, dtype=np.int32)
        self.number[points] = np.arange(1, len(points) + 1)
        self.shift = len(points).bit_length()
        keys = np.array([s << self.shift | self.number[c] for s, c in edges], dtype=np.int32)
        self.bits = len(keys).bit_length() + 2
        self.keys = np.full((1 << self.bits) + len(keys), -1, dtype=np.int32)
        self.child = np.zeros(len(self.keys), dtype=np.int32)
        for slot, key, c in zip(self._slot(keys).tolist(), keys.tolist(), edges.values()):
            while self.keys[slot] >= 0:
                slot += 1
            self.keys[slot], self.child[slot] = key, c
        # The states after a first character, by its number.
        self.root = np.full(len(points) + 1, -1, dtype=np.int32)
        for (state, c), child in edges.items():
            if not state:
                self.root[self.number[c]] = child

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int32)

    def step(self, state: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The trie's states after one more character; -1 where it has none."""
        key = state << self.shift | number
        slot = self._slot(key)
        seen = self.keys[slot]
        out = np.where(seen == key, self.child[slot], np.int32(-1))
        left = np.flatnonzero((seen != key) & (seen >= 0))
        while len(left):
            slot[left] += 1
            seen = self.keys[slot[left]]
            hit = seen == key[left]
            out[left[hit]] = self.child[slot[left[hit]]]
            left = left[~hit & (seen >= 0)]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids."""
        return self.spell(ids)[0].tobytes().decode("utf-8", "surrogatepass").removeprefix(" ")

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of piece ids, one after another, and the end of each."""
        size = self.size[ids]
        total = int(size.sum(dtype=np.int64))
        ends = size.cumsum(dtype=np.int32 if total < 1 << 31 else np.int64)
        at = np.repeat(self.start[ids] - (ends - size), size)
        at += np.arange(total, dtype=at.dtype)
        return self.flat.take(at), ends


@lru_cache(maxsize=2)
def pieces(path: str, alpha: float) -> Pieces:
    return Pieces(path, alpha)


def _hash(*parts: np.ndarray | int) -> np.ndarray:
    """64-bit hashes of the parts (splitmix64)."""
    with np.errstate(over="ignore"):
        h = np.uint64(0x243F6A8885A308D3)
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(30)
            h = h * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(27)
    return h


def _uniform(base: np.ndarray, part: np.ndarray | int) -> np.ndarray:
    """Uniform variables in (0, 1) from hashes and one more part."""
    with np.errstate(over="ignore"):
        h = (base ^ (np.asarray(part).astype(np.uint64) * np.uint64(0x94D049BB133111EB))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(30)
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0


class Lattice:
    """The lattices of distinct words, the longest first.

    Node (w, p) lies before the p-th character of word w.  Nodes are numbered
    place by place, those of one place by word, so that all sums forward are
    over ranges.  Arcs are sorted by the node they end at, the widest first;
    `run` accumulates a node's arcs' probabilities."""

    def __init__(self, p: Pieces, codes: np.ndarray, lengths: np.ndarray) -> None:
        """`codes`: the characters of the words, one word after another;
        `lengths` descend."""
        longest, self.words = int(lengths.max()), len(lengths)
        count = np.searchsorted(-lengths, -np.arange(longest + 2), side="right").astype(np.int32)  # words of a length
        off = np.append(0, count.cumsum()).astype(np.int32)  # first node of a place
        char = np.append(0, count[1:].cumsum()).astype(np.int32)  # first character of a place
        size = lengths.astype(np.int32)
        word = np.repeat(np.arange(self.words, dtype=np.int32), size)
        place = np.arange(len(codes), dtype=np.int32) - np.repeat((size.cumsum() - size).astype(np.int32), size)
        numbers = np.empty(len(codes), dtype=np.int32)
        numbers[char[place] + word] = p.number[codes]
        self.end = off[size] + np.arange(self.words, dtype=np.int32)
        n_nodes = int(off[longest + 1])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # heads, tails, piece ids
        single = np.zeros(len(codes), dtype=bool)
        w, at, state, depth = word, place, None, 0
        while len(w):
            state = p.step(state, numbers[char[at + depth] + w]) if depth else p.root[numbers[char[at] + w]]
            ok = state >= 0
            w, at, state, depth = w[ok], at[ok], state[ok], depth + 1
            piece = p.terminal[state]
            done = piece >= 0
            ww, pp = w[done], at[done]
            found.append((off[pp + depth] + ww, off[pp] + ww, piece[done]))
            if depth == 1:
                single[char[pp] + ww] = True
            inside = w < count[at + depth + 1]
            w, at, state = w[inside], at[inside], state[inside]
        # Spelled characters: their id is the number of the code, from below 0.
        some = np.flatnonzero(~single[char[place] + word])
        spelling, number = np.unique(codes[some], return_inverse=True)
        self.spelled = [p.bytes_[list(chr(ord(MARK) if c == REAL_MARK else c).encode("utf-8", "surrogatepass"))]
                        for c in spelling.tolist()]
        self.spelled_size = np.array([len(x) for x in self.spelled], dtype=np.int64)
        self.spelled_start = self.spelled_size.cumsum() - self.spelled_size
        self.spelled_ids = np.concatenate([*self.spelled, np.zeros(0, dtype=np.int32)])
        found.insert(0, (off[place[some] + 1] + word[some], off[place[some]] + word[some], (-1 - number).astype(np.int32)))
        into = np.zeros(n_nodes, dtype=np.int32)
        for head, _, _ in found:
            into[head] += 1  # a node has one arc of a width
        self.first = np.append(0, into.cumsum()).astype(np.int32)
        free = self.first[1:].copy()
        arcs = int(self.first[-1])
        self.tail, self.piece, self.logp = np.empty(arcs, np.int32), np.empty(arcs, np.int32), np.empty(arcs)
        costs = np.concatenate([p.logp, [p.logp[x].sum() for x in reversed(self.spelled)]])
        for head, tail, piece in found:
            free[head] -= 1
            where = free[head]
            self.tail[where], self.piece[where] = tail, piece
            self.logp[where] = costs[piece]
        # Forward sums, place by place; every node but the first ones has an arc.
        alpha, self.share = np.zeros(n_nodes), np.empty(arcs)
        for a, z in zip(off[1:longest + 1].tolist(), off[2:longest + 2].tolist()):
            i, j = int(self.first[a]), int(self.first[z])
            value = alpha[self.tail[i:j]] + self.logp[i:j]
            alpha[a:z] = np.logaddexp.reduceat(value, self.first[a:z] - i)
            self.share[i:j] = value
        self.alpha = alpha
        self.share -= np.repeat(alpha, into)
        np.exp(self.share, out=self.share)
        # Node by node, so that no node's sums depend on those before it.
        self.run, j = self.share.copy(), 1
        nodes = np.flatnonzero(into > 1)
        while len(nodes):
            at = self.first[nodes] + j
            self.run[at] += self.run[at - 1]
            j += 1
            nodes = nodes[into[nodes] > j]
        self.run[self.first[1:][into > 0] - 1] = np.inf  # the last arc takes what rounding leaves

    def draw(self, nodes: np.ndarray, key: np.ndarray, which: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Paths back from `nodes` to their words' starts: counts of arcs by
        occurrence, and the arcs, one occurrence after another."""
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        live, at, step = np.flatnonzero(nodes >= self.words).astype(np.int32), nodes[nodes >= self.words], 0
        hashes = _hash(key, which, number)
        while len(live):
            u = _uniform(hashes[live], step)
            arc = self.first[at]
            over = np.flatnonzero(u > self.run[arc])
            while len(over):
                arc[over] += 1
                over = over[u[over] > self.run[arc[over]]]
            taken.append((live, arc))
            at, step = self.tail[arc], step + 1
            open_ = at >= self.words
            live, at = live[open_], at[open_]
        counts = np.zeros(len(nodes), dtype=np.int32)
        for live, _ in taken:
            counts[live] += 1
        offset = np.append(0, counts.cumsum())
        arcs = np.empty(int(offset[-1]), dtype=np.int32)
        for step, (live, arc) in enumerate(taken):
            arcs[offset[live] + step] = arc
        return counts, arcs

    def ids(self, arcs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of arcs that come word by word, each word's from its end;
        and the number of ids before each arc, and in all."""
        stop = counts.cumsum()
        mirror = np.repeat((2 * stop - counts - 1).astype(np.int32), counts) - np.arange(len(arcs), dtype=np.int32)
        found = self.piece[arcs[mirror]]
        spelled = np.flatnonzero(found < 0)
        if not len(spelled):
            return found, np.arange(len(arcs) + 1)
        kind = -1 - found[spelled]
        width = np.ones(len(arcs), dtype=np.int64)
        width[spelled] = self.spelled_size[kind]
        before = np.append(0, width.cumsum())
        out = np.repeat(found, width)
        size = width[spelled]
        step = np.arange(int(size.sum())) - np.repeat(size.cumsum() - size, size)
        out[np.repeat(before[spelled], size) + step] = self.spelled_ids[np.repeat(self.spelled_start[kind], size) + step]
        return out, before


class _Search:
    """The search in one text: its paths so far and the agenda."""

    def __init__(self, lat: Lattice, types: np.ndarray, key: int, logs: float) -> None:
        self.lat, self.types, self.key, self.logs = lat, types, key, logs
        self.paths: list[tuple[np.ndarray, np.ndarray, float]] = []  # counts, arcs, bound
        self.agenda: list[tuple[float, int, int, frozenset, float]] = []  # bound, path, step, arcs out, log mass before

    def take(self) -> tuple[float, int, int, frozenset, float]:
        """The agenda's best entry, taken off."""
        entry = max(self.agenda)
        self.agenda.remove(entry)
        return entry

    def branch(self, entry: tuple[float, int, int, frozenset, float], first: int, end: int, u: float,
               v: float) -> tuple[int, int, int, float, float]:
        """An entry, whose node has the arcs from `first` to `end`, as (path,
        step, new arc, bound, log mass after that arc); what it leaves goes back."""
        bound, which, step, out, mass = entry
        arcs = [a for a in range(first, end) if a not in out]
        share = self.lat.share[arcs]
        # The best child of those left, then what remains beside it.
        total = share.sum()
        k = int(min(share.cumsum().searchsorted(u * total), len(arcs) - 1))
        arc = arcs[k]
        rest = total - share[k]
        if len(arcs) > 1 and rest > 0:
            left = mass + float(np.log(rest))
            g = left - float(np.log(np.exp(left - bound) - np.log(v)))
            self.agenda.append((g, which, step, out | {arc}, mass))
        return which, step, arc, bound, mass + float(np.log(share[k]))

    def kappa(self) -> float:
        return max(self.agenda)[0] if self.agenda else -np.inf


def _branches(lat: Lattice, searches: list[_Search], which: int) -> list[tuple[int, tuple]]:
    """(text, branch) of the best agenda entries of all texts with `which` paths."""
    some = [d for d, s in enumerate(searches) if len(s.paths) == which and s.agenda]
    entries = [searches[d].take() for d in some]
    steps = np.array([e[2] for e in entries], dtype=np.int64)
    nodes = lat.first.searchsorted([int(searches[d].paths[e[1]][1][e[2]]) for d, e in zip(some, entries)], side="right") - 1
    base = _hash(np.array([searches[d].key for d in some], dtype=np.int64), -1000 - which, steps)
    given = zip(some, entries, lat.first[nodes].tolist(), lat.first[nodes + 1].tolist(), _uniform(base, 1).tolist(), _uniform(base, 2).tolist())
    return [(d, searches[d].branch(*x)) for d, *x in given]


def _note(lat: Lattice, searches: list[_Search], found: list[tuple], k: int) -> None:
    """Note new paths (text, counts, arcs, bound, first step, log mass of the
    node there), and put the children that they pass onto the agendas: of each
    agenda the k + 1 best are kept, as no others are ever taken."""
    which = np.array([len(searches[d].paths) for d, *_ in found])
    for d, counts, arcs, bound, _, _ in found:
        searches[d].paths.append((counts, arcs, bound))
    flat = np.concatenate([arcs for _, _, arcs, *_ in found] or [np.zeros(0, dtype=np.int64)])
    size = np.array([len(arcs) for _, _, arcs, *_ in found], dtype=np.int64)
    offset = size.cumsum() - size
    bound = np.array([x[3] for x in found])
    step = np.array([x[4] for x in found], dtype=np.int64)
    before = np.array([x[5] for x in found], dtype=np.float64)
    keys = np.array([searches[x[0]].key for x in found], dtype=np.int64)
    base = _hash(keys, -1 - which)
    live = np.flatnonzero(step < size)
    while len(live):
        col = step[live, None] + np.arange(STEPS)
        there = col < size[live, None]
        arcs = flat[np.where(there, offset[live, None] + col, offset[live, None])]
        share = np.where(there, np.minimum(lat.share[arcs], 1.0), 1.0)
        with np.errstate(divide="ignore"):
            logs = np.log(share)
            sums = before[live, None] + logs.cumsum(axis=1)
            mass = sums - logs
            rest = mass + np.log1p(-share)
            u = _uniform(base[live, None], col)
            bounds = np.where(rest > -np.inf, rest - np.log(np.exp(rest - bound[live, None]) - np.log(u)), -np.inf)
        most = min(k, STEPS - 1)  # of one step, all that there are
        top = np.argpartition(-bounds, most, axis=1)[:, :most + 1]
        best = (np.take_along_axis(x, top, 1).tolist() for x in (bounds, col, arcs, mass))
        more, left = [], sums[:, -1].tolist()
        for row, end, entries in zip(live.tolist(), left, zip(*best)):
            agenda, me = searches[found[row][0]].agenda, int(which[row])
            agenda += [(g, me, j, frozenset((x,)), m) for g, j, x, m in zip(*entries) if g > -np.inf]
            if len(agenda) > k + 1:
                agenda.sort(reverse=True)
                del agenda[k + 1:]
            worst = agenda[-1][0] if len(agenda) > k else -np.inf
            if step[row] + STEPS < size[row] and end + MOST_GUMBEL > worst:
                more.append(row)
                step[row] += STEPS
                before[row] = end
        live = np.array(more, dtype=np.int64)


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts, each text with a space before it: numbers of the
    distinct words, text after text; words of each text; and the characters and
    lengths of the distinct words, the longest first.  A word is a run of spaces
    and of what follows up to the next space."""
    given = [" " + t if t else "" for t in texts]
    size = np.array([len(t) for t in given], dtype=np.int64)
    codes = np.frombuffer("".join(given).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    space = codes == 32
    begins = space & ~np.append(True, space[:-1])
    first = (size.cumsum() - size)[size > 0]
    begins[first] = True
    start = np.flatnonzero(begins)
    length = np.diff(np.append(start, len(codes)))
    text_of = np.repeat(np.arange(len(texts)), size)[start]
    sizes = np.bincount(text_of, minlength=len(texts))
    codes = np.where(codes == ord(MARK), np.int32(REAL_MARK), np.where(space, np.int32(ord(MARK)), codes))
    if not len(start):
        return start, sizes, codes, length
    place = np.arange(len(codes), dtype=np.int32) - np.repeat(start.astype(np.int32), length)
    seed = 0
    while True:
        # Distinct by a hash of characters and places, checked in full below.
        with np.errstate(over="ignore"):
            h = (codes.astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) + np.uint64(seed)
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            h = np.add.reduceat(h, start) + length.astype(np.uint64)
        flat, distinct = pd.factorize(h)
        one = np.empty(len(distinct), dtype=np.int64)
        one[flat[::-1]] = np.arange(len(flat) - 1, -1, -1)
        same = codes[np.repeat(start[one][flat].astype(np.int32), length) + place] == codes
        if same.all() and (length[one][flat] == length).all():
            break
        seed += 1
    longest = np.argsort(-length[one], kind="stable")
    rank = np.empty(len(one), dtype=np.int32)
    rank[longest] = np.arange(len(one), dtype=np.int32)
    one, flat = one[longest], rank[flat]
    kept = length[one]
    at = np.repeat(start[one] - np.append(0, kept.cumsum()[:-1]), kept) + np.arange(int(kept.sum()))
    return flat, sizes, codes[at], kept


def sample(texts: list[str | None], keys: np.ndarray, k: int, p: Pieces) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its segmentations as (ids, log p, perturbed, inclusion)."""
    flat, sizes, codes, lengths = _words(texts)
    if not len(flat):
        return [[(np.zeros(0, dtype=np.int32), 0.0, 0.0, 1.0)] for _ in texts]
    lat = Lattice(p, codes, lengths)
    keys = keys.astype(np.int64)
    word_at = np.append(0, sizes.cumsum())
    types = [flat[a:z] for a, z in zip(word_at[:-1], word_at[1:])]
    masses = lat.alpha[lat.end[flat]]
    searches = [_Search(lat, t, x, float(masses[a:z].sum())) for t, x, a, z in zip(types, keys.tolist(), word_at[:-1], word_at[1:])]
    # The first path of every text at once.
    owner = np.repeat(np.arange(len(types)), sizes)
    number = np.arange(len(flat)) - word_at[owner]
    counts, arcs = lat.draw(lat.end[flat], keys[owner], 0, number)
    roots = -np.log(-np.log(_uniform(_hash(keys), -7)))
    arc_at = np.append(0, counts.cumsum())[word_at]
    _note(lat, searches, [(d, counts[word_at[d]:word_at[d + 1]], arcs[arc_at[d]:arc_at[d + 1]], float(roots[d]), 0, 0.0)
                          for d in range(len(texts))], k)
    for which in range(1, k):
        _extend(lat, searches, _branches(lat, searches, which), keys, which, k)
    out: list[list[tuple]] = [[] for _ in texts]
    for which in range(k):
        rows = [d for d, s in enumerate(searches) if len(s.paths) > which]
        if not rows:
            break
        arcs = np.concatenate([searches[d].paths[which][1] for d in rows])
        ids, before = lat.ids(arcs, np.concatenate([searches[d].paths[which][0] for d in rows]))
        cut = np.append(0, np.cumsum([len(searches[d].paths[which][1]) for d in rows]))
        weight = lat.logp[arcs]
        for d, a, z in zip(rows, cut[:-1].tolist(), cut[1:].tolist()):
            s = searches[d]
            logp = float(weight[a:z].sum()) - s.logs
            score = float(-np.expm1(-np.exp(min(50.0, logp - s.kappa()))))
            out[d].append((ids[before[a]:before[z]], logp, s.paths[which][2], score))
    return out


def _extend(lat: Lattice, searches: list[_Search], jobs: list[tuple], keys: np.ndarray, which: int, k: int) -> None:
    """The next path of each text of `jobs`: the words after the branch, and the
    rest of the branch's word, are drawn anew, all texts together."""
    plans, nodes, owners, numbers = [], [], [], []
    for d, (old, step, arc, bound, after) in jobs:
        counts, arcs, _ = searches[d].paths[old]
        word = int(np.searchsorted(counts.cumsum(), step, side="right"))
        later = searches[d].types[word + 1:]
        plans.append((d, counts[:word], arcs[:step], arc, step - int(counts[:word].sum()) + 1, bound, after, len(later) + 1))
        nodes += [lat.tail[arc:arc + 1], lat.end[later]]
        owners.append(np.full(len(later) + 1, d))
        numbers.append(np.arange(word, word + len(later) + 1))
    if not plans:
        return
    owner = np.concatenate(owners)
    counts, arcs = lat.draw(np.concatenate(nodes), keys[owner], which, np.concatenate(numbers))
    at, word, found = np.append(0, counts.cumsum()), 0, []
    for d, counts_before, arcs_before, arc, in_word, bound, after, n in plans:
        new = counts[word:word + n].copy()
        new[0] += in_word
        path = np.concatenate([arcs_before, [arc], arcs[at[word]:at[word + n]]])
        found.append((d, np.concatenate([counts_before, new]), path, bound, len(arcs_before) + 1, after))
        word += n
    _note(lat, searches, found, k)


def encode(docs: DataFrame, k: int = 2, alpha: float = 1.0, model: str = MODEL, together: int = TOGETHER) -> DataFrame:
    """(doc_id, rank, ids, log_prob, perturbed, inclusion, exact) of every row:
    `exact` tells that the ids were decoded to the row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model, alpha)
        for b in batches:
            every = b.column("text").to_pylist()
            for i, j in _parts(every, together):
                texts = every[i:j]
                found = sample(texts, b.column("_key")[i:j].to_numpy(), k, p)
                paths = [x for f in found for x in f]
                count = [len(f) for f in found]
                ends = np.cumsum([0, *(len(x[0]) for x in paths)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([x[0] for x in paths]), pa.int32()))
                columns = [b.column("doc_id").take(pa.array(np.repeat(np.arange(i, j), count))),
                           pa.array([rank for n in count for rank in range(1, n + 1)], pa.int32()), ids,
                           *(pa.array([x[c] for x in paths], pa.float64()) for c in (1, 2, 3)), pa.array(_exact(texts, found, p), pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "rank", "ids", "log_prob", "perturbed", "inclusion", "exact"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_key")).mapInArrow(
        run, f"doc_id {kind}, rank int, ids array<int>, log_prob double, perturbed double, inclusion double, exact boolean")


def _exact(texts: list[str | None], found: list[list[tuple]], p: Pieces) -> list[bool]:
    """Whether each segmentation's ids decode to its text, all decoded at once."""
    every = [ids for paths in found for ids, *_ in paths]
    raw, ends = p.spell(np.concatenate(every))
    cut = np.append(0, ends)[np.append(0, np.cumsum([len(ids) for ids in every]))].tolist()
    want = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    return [raw[a:z].tobytes() == w for a, z, w in zip(cut[:-1], cut[1:], (w for w, paths in zip(want, found) for _ in paths))]


def _parts(texts: list[str | None], together: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `together` characters; a longer text is a part of
    its own."""
    group = np.cumsum([len(t) if t else 0 for t in texts], dtype=np.int64) // together
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    return ((i, j) for i, j in zip(cuts[:-1], cuts[1:]) if i < j)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """`encoded` with the text of its `ids`, as column `text`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(model, 1.0)
        for b in batches:
            yield b.assign(text=[None if x is None else p.decode(np.asarray(x)) for x in b["ids"]])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInPandas(run, fields + ", text string")
