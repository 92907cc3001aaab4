"""SentencePiece encoding and decoding, and Gumbel top-k segmentation sampling without replacement.

``encode`` and ``decode`` are the library's. ``sample_segmentations`` draws ``k`` distinct segmentations of a
whole text from the lattice of the model's pieces. A piece's log-probability is Zipf's law over its rank in
the vocabulary; characters without a piece are one edge each at ``UNKNOWN`` and become their byte pieces.

A lattice edge never crosses a word boundary (no piece of the model holds a space mark after another
character), so the lattice is a chain of word lattices and equal words share one: a task builds each
distinct word's lattice once, with backward sums, by numpy over all new words of a batch together, and forgets them all
when they have more than ``CACHE_EDGES`` edges.

Sampling is a perturbed A-star search over the chain. A path is drawn forward from the backward sums, which
is the perturbed maximum of everything below the root; the perturbed value is Gumbel. At every step, all
untaken edges together have a known mass, so the maximum below them is a Gumbel variable cut off at the value
of the path: one number per step. The best of these over all paths found so far is the next one in
descending order of perturbed value: the search goes on there, and nowhere else. All documents of a batch move
in step. Every random number is a hash of (seed, row key, path, step), so results do not depend on batches.

The value below the k-th is the threshold: a segmentation's inclusion score is the probability that its
perturbed value exceeds it, 1 - exp(-exp(log_prob - threshold)); it is 1 where fewer than k + 1 exist.

Defined results: a null or empty text has one empty segmentation of log-probability 0; texts with fewer than
``k`` segmentations return all they have; rows that repeat a key and a text get equal samples; runs of spaces
are single space marks; a very long text is sampled whole, in memory that follows its length; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_value, mix64, uniform

MARK = 0x2581
UNKNOWN = -16.0
_ONE = float(1 << 32)
BATCH_CHARS = 3_000_000
#: Ids in one result batch.
OUT_IDS = 500_000
GROUP_CHARS = 400_000
CACHE_EDGES = 4_000_000
#: Masses of untaken edges as whole numbers, so that their sums are alike in any order.
_FINE = float(1 << 52)


class Pieces:
    """The model's pieces as a trie over code points, in sorted arrays."""

    SLOTS = 18

    def __init__(self, blob: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        pieces = []
        for i in range(sp.get_piece_size()):
            if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i)):
                text = sp.id_to_piece(i)
                if len(text) == 1 or set(text) != {chr(MARK)}:
                    pieces.append((text, i))
        if any(chr(MARK) in text[1:] for text, _ in pieces):
            raise ValueError("a piece crosses word boundaries; the lattice is no chain of words")
        harmonic = float(np.log(np.sum(1.0 / np.arange(1, len(pieces) + 1))))
        nodes: dict[tuple[int, int], int] = {}
        score, ids = {}, {}
        for rank, (text, i) in enumerate(pieces, 1):
            at = 0
            for ch in text:
                at = nodes.setdefault((at, ord(ch)), len(nodes) + 1)
            score[at], ids[at] = -float(np.log(rank)) - harmonic, i
        # transitions in an open hash table; an empty slot holds no key
        self.keys, self.to = np.full(1 << self.SLOTS, -1, np.int64), np.full(1 << self.SLOTS, -1, np.int64)
        for (a, c), to in nodes.items():
            at = int(self._slot(np.array([(a << 21) | c]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.SLOTS) - 1)
            self.keys[at], self.to[at] = (a << 21) | c, to
        self.score = np.full(len(nodes) + 1, -np.inf)
        self.ids = np.full(len(nodes) + 1, -1, np.int64)
        for at in score:
            self.score[at], self.ids[at] = score[at], ids[at]
        self.first = np.full(0x110000, -1, np.int32)  # the first step from the root, by code point
        for (a, c), to in nodes.items():
            if a == 0:
                self.first[c] = to

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def step(self, node: np.ndarray, cp: np.ndarray) -> np.ndarray:
        key = (node << 21) | cp
        at = self._slot(key)
        held = self.keys[at]
        again = np.flatnonzero((held != key) & (held >= 0))
        while len(again):
            at[again] = (at[again] + 1) & ((1 << self.SLOTS) - 1)
            held[again] = self.keys[at[again]]
            again = again[(held[again] != key[again]) & (held[again] >= 0)]
        return np.where(held == key, self.to[at], -1)


class Lattice:
    """Word lattices of many words (given without their space mark) at once. State = a position in a word; words lie end to end, each with an
    end state, so word w has states ``start[w]`` to ``start[w] + length[w]``."""

    def __init__(self, pieces: Pieces, words: list[str]):
        text = "".join([f"{chr(MARK)}{w}\0" for w in words])
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.start = np.concatenate(([0], np.cumsum(length + 1)))[:-1]
        self.end = self.start + length
        n = len(cp)
        left = (np.repeat(self.end, length + 1) - np.arange(n)).astype(np.int32)  # characters to the word's end
        found: list[tuple[np.ndarray, np.ndarray]] = []  # by length: where pieces start, and their trie nodes
        at = np.flatnonzero(left > 0).astype(np.int32)
        node = pieces.first[cp[at]]
        single = np.zeros(n, bool)
        reach = 1
        while True:
            alive = node >= 0
            at, node = at[alive], node[alive]
            if not len(at):
                break
            hit = pieces.ids[node] >= 0
            found.append((at[hit], node[hit]))
            if reach == 1:
                single[at[hit]] = True
            more = left[at] > reach
            at, node = at[more], node[more]
            node = pieces.step(node.astype(np.int64), cp[at + reach]).astype(np.int32)
            reach += 1
        lone = np.flatnonzero((left > 0) & ~single)  # a character without a piece: its bytes
        count = np.zeros(n, np.int32)
        for where, _ in found:
            count[where] += 1  # each start once
        count[lone] += 1
        self.first = np.concatenate(([0], np.cumsum(count)))
        # edges lie by source, the longest piece first
        free, total = self.first[:-1].copy(), int(self.first[-1])
        self.src, self.dst, self.ids, score = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total)
        longest = len(found)
        for size in range(longest, -1, -1):
            where, nodes = found.pop() if size else (lone, None)
            to = free[where]
            free[where] += 1
            self.src[to], self.dst[to] = where, where + max(size, 1)
            self.ids[to] = pieces.ids[nodes] if size else -1 - cp[lone]
            score[to] = pieces.score[nodes] if size else UNKNOWN
        del found, free, cp
        # backward sums from the words' ends: states equally far from the end have no edges between them
        back = np.zeros(n)
        by_left = np.argsort(left)
        cuts = np.searchsorted(left[by_left], np.arange(1, int(left.max(initial=0)) + 2))
        weight, self.cdf = np.empty(total), np.empty(total, np.float32)  # cdf: within the source state
        for a, b in zip(cuts[:-1], cuts[1:]):
            states = by_left[a:b]
            lo, hi = self.first[states], self.first[states + 1]
            count = hi - lo
            heads = np.cumsum(count) - count
            edges = np.repeat(lo - heads, count) + np.arange(int(count.sum()), dtype=np.int64)
            value = score[edges] + back[self.dst[edges]]
            top = np.maximum.reduceat(value, heads)
            part = np.exp(value - np.repeat(top, count))
            total = np.add.reduceat(part, heads)
            back[states] = top + np.log(total)
            weight[edges] = value - np.repeat(back[states], count)
            # whole numbers add up alike whatever else is in the batch
            part = np.round(part / np.repeat(total, count) * _ONE).astype(np.int64)
            run = np.cumsum(part)
            self.cdf[edges] = (run - np.repeat(run[heads] - part[heads], count)) / _ONE
        self.logp = weight  # log-probability of an edge given its source
        self.n_edges = self.first[1:] - self.first[:-1]
        ends = self.first[1:][self.n_edges > 0] - 1
        self.cdf[ends] = 2.0

    def extend(self, more: "Lattice") -> "Lattice":
        """This lattice with the words of another after its own."""
        states, edges = len(self.n_edges), len(self.ids)
        for name, shift in (("start", states), ("end", states), ("src", states), ("dst", states), ("ids", 0), ("logp", 0), ("cdf", 0), ("n_edges", 0)):
            own, other = getattr(self, name), getattr(more, name)
            if shift:
                other = other + other.dtype.type(shift)
            setattr(self, name, np.concatenate((own, other)))
        self.first = np.concatenate((self.first[:-1], more.first + edges))
        return self

    def draw(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each state by its probability; long pieces come first, so most are found at once."""
        edge = self.first[state]
        beyond = np.flatnonzero(u > self.cdf[edge])
        while len(beyond):
            edge[beyond] += 1
            beyond = beyond[u[beyond] > self.cdf[edge[beyond]]]
        return edge


def _log1mexp(x: np.ndarray) -> np.ndarray:
    """log(1 - exp(x)) for x < 0."""
    return np.log(-np.expm1(x))


def cut_gumbel(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at ``location`` given that they are below ``bound``."""
    return -np.logaddexp(-bound, np.log(-np.log(u)) - location)


class Sampler:
    """``k`` distinct segmentations for each of a group of documents, by perturbed best-first search."""

    def __init__(self, lattice: Lattice, words: list[np.ndarray], keys: np.ndarray, seed: int):
        self.lattice, self.keys = lattice, keys
        self.counts = np.array([len(w) for w in words], np.int64)
        self.tokens = np.concatenate(words) if len(words) else np.zeros(0, np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.counts)))
        self.seed = mix64(keys ^ np.uint64(seed))

    def _walk(self, doc: np.ndarray, word: np.ndarray, state: np.ndarray, path: int):
        """Finish words (one entry each, from ``state``); gives flat steps sorted by (doc, word, position)."""
        token = self.tokens[self.offset[doc] + word]
        begin, end = self.lattice.start[token], self.lattice.end[token]
        base = mix64(self.seed[doc] ^ (np.uint64(path) << np.uint64(56))) ^ (word.astype(np.uint64) << np.uint64(20))
        base -= begin.view(np.uint64)  # plus the state, a hash key of the place in the word
        length = np.zeros(len(doc), np.int64)
        found = []
        active = np.flatnonzero(state < end)
        while len(active):
            s = state[active]
            edge = self.lattice.draw(s, uniform(base[active] + s.view(np.uint64)))
            found.append((active, edge))
            s = self.lattice.dst[edge]
            state[active] = s
            length[active] += 1
            active = active[s < end[active]]
        # the t-th round holds the t-th step of each entry that has one
        first = np.cumsum(length) - length
        edges = np.empty(int(length.sum()), np.int64)
        for t, (active, edge) in enumerate(found):
            edges[first[active] + t] = edge
        return np.repeat(doc, length), np.repeat(word, length), edges

    def run(self, k: int):
        """Up to ``k`` paths of each document, best first, and the thresholds. A path is (edges, begin, logp, alive):
        document d, where alive, has edges begin[d] to begin[d + 1]."""
        lattice, n = self.lattice, len(self.counts)
        threshold = np.full(n, -np.inf)
        rounds: list[dict] = []
        doc = np.repeat(np.arange(n), self.counts)
        word = np.arange(len(doc)) - self.offset[doc]
        steps = self._walk(doc, word, lattice.start[self.tokens], 0)
        value = -np.log(-np.log(uniform(self.seed ^ np.uint64(0xF00D))))
        alive = np.ones(n, bool)
        branch = np.zeros(n, np.int64)
        for path in range(k + 1):
            if path:
                best, where, at = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
                for r, entry in enumerate(rounds):
                    own, place = entry["best"]
                    better = own > best
                    best[better], where[better], at[better] = own[better], r, place[better]
                if path == k:
                    threshold = best
                    break
                alive = np.isfinite(best)
                if not alive.any():
                    break
                value = best
                steps, branch = self._branch(rounds, np.flatnonzero(alive), where, at, path, best)
            rounds.append(self._entries(steps, value, alive, branch, path, n))
        return [(r["edge"], r["begin"], r["logp"], r["alive"]) for r in rounds], threshold

    def _entries(self, steps, value, alive, branch, path, n):
        """A path's steps with the cut-off Gumbel maximum below the untaken edges of each step."""
        doc, word, edge = steps
        lattice = self.lattice
        begin = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n))))
        logp = lattice.logp[edge]
        steps = np.round(logp * _ONE).astype(np.int64)  # exact sums, for the same reason
        whole = np.concatenate(([0], np.cumsum(steps)))
        index = np.arange(len(doc)) - begin[doc]
        gumbel = np.full(len(doc), -np.inf)
        own = np.flatnonzero((index >= branch[doc]) & (lattice.n_edges[lattice.src[edge]] > 1))  # others belong to the path it branched from
        mine = doc[own]
        mass = (whole[own] - whole[begin[mine]]) / _ONE + _log1mexp(np.minimum(logp[own], -1e-300))
        u = uniform(mix64(self.seed ^ np.uint64(0xABCD + 2 * path))[mine] ^ index[own].astype(np.uint64))
        gumbel[own] = cut_gumbel(mass, value[mine], u)
        out = {
            "doc": doc, "word": word, "edge": edge, "begin": begin, "whole": whole, "gumbel": gumbel, "alive": alive,
            "taken": np.zeros(0, np.int64), "path": path, "logp": (whole[begin[1:]] - whole[begin[:-1]]) / _ONE,
        }
        out["best"] = self._best(out, n)
        return out

    @staticmethod
    def _best(entry, n):
        best, at = np.full(n, -np.inf), np.zeros(n, np.int64)
        begin, g = entry["begin"], entry["gumbel"]
        some = np.flatnonzero(begin[1:] > begin[:-1])
        if len(some):
            best[some] = np.maximum.reduceat(g, begin[some])
            hit = np.flatnonzero((g == best[entry["doc"]]) & (g > -np.inf))
            at[entry["doc"][hit[::-1]]] = hit[::-1]
        return best, at

    def _branch(self, rounds, alive, where, at, path, value):
        """Take the chosen untaken edge of every document and finish its path from there."""
        lattice, n = self.lattice, len(self.counts)
        edges = len(lattice.ids)
        branch = np.zeros(n, np.int64)
        new_word, new_state, new_edge = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        before = []
        for r in np.unique(where[alive]).tolist():
            entry = rounds[r]
            docs = alive[where[alive] == r]
            step = at[docs]
            source = lattice.src[entry["edge"][step]]
            count = lattice.n_edges[source].astype(np.int64)
            heads = np.cumsum(count) - count
            own = np.repeat(np.arange(len(docs)), count)
            edge = np.arange(len(own)) - heads[own] + lattice.first[source][own]
            code = step[own] * edges + edge
            free = (edge != entry["edge"][step][own]) & ~np.isin(code, entry["taken"])
            mass = np.where(free, np.maximum(np.exp(lattice.logp[edge]) * _FINE, 1.0), 0.0).astype(np.uint64)
            run = np.cumsum(mass)  # may wrap around, differences do not
            run -= np.repeat(run[heads] - mass[heads], count)
            whole = run[heads + count - 1]
            u = uniform(self.seed[docs] ^ np.uint64(0x7777 + path))
            aim = np.minimum((u * whole.astype(np.float64)).astype(np.uint64), whole - np.uint64(1))
            beyond = np.add.reduceat((run <= aim[own]).astype(np.int64), heads)
            taken = heads + beyond
            entry["taken"] = np.concatenate((entry["taken"], code[taken]))
            rest = whole - mass[taken]
            some = np.add.reduceat(free.astype(np.int64), heads) > 1
            prefix = (entry["whole"][step] - entry["whole"][entry["begin"][docs]]) / _ONE
            left = np.full(len(docs), -np.inf)
            u = uniform(self.seed[docs[some]] ^ np.uint64(0x9999 + path))
            left[some] = cut_gumbel(prefix[some] + np.log(rest[some].astype(np.float64) / _FINE), value[docs[some]], u)
            entry["gumbel"][step] = left
            entry["best"] = self._best(entry, n)
            branch[docs] = step - entry["begin"][docs] + 1
            new_word[docs], new_edge[docs], new_state[docs] = entry["word"][step], edge[taken], lattice.dst[edge[taken]]
            stop = np.zeros(n, np.int64)
            stop[docs] = step
            kept = np.flatnonzero(np.arange(len(entry["doc"])) < stop[entry["doc"]])
            before.append((entry["doc"][kept], kept - entry["begin"][entry["doc"][kept]], entry["word"][kept], entry["edge"][kept]))
        # the word of the branch from its new state, and every word after it from its start
        count = self.counts[alive] - new_word[alive]
        doc = np.repeat(alive, count)
        heads = np.cumsum(count) - count
        word = new_word[doc] + np.arange(len(doc)) - np.repeat(heads, count)
        state = lattice.start[self.tokens[self.offset[doc] + word]]
        state[heads] = new_state[alive]
        d2, w2, e2 = self._walk(doc, word, state, path)
        # every part comes in order: places follow from counts
        walked = np.bincount(d2, minlength=n)
        size = branch + walked
        begin = np.cumsum(size) - size
        total = int(size.sum())
        out = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int64)
        rank = np.arange(len(d2)) - (np.cumsum(walked) - walked)[d2]
        parts = [(d, i, w, e) for d, i, w, e in before]
        parts += [(alive, branch[alive] - 1, new_word[alive], new_edge[alive]), (d2, branch[d2] + rank, w2, e2)]
        for d, i, w, e in parts:
            to = begin[d] + i
            for column, values in zip(out, (d, w, e)):
                column[to] = values
        return out, branch


class _Index(dict):
    """Numbers words as they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        return len(self) - 1


def words_of(text: str) -> list[str]:
    """Words without the space mark each of them starts with, as the model sees them; a run of spaces is that many
    marks, each but the last a word of its own."""
    return text.split(" ") if text else []


class Words:
    """The words that a task has met, numbered, with their lattices."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.index, self.lattice = pieces, _Index(), None

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """Word numbers of each text; words that are new get lattices."""
        if self.lattice is not None and len(self.lattice.ids) > CACHE_EDGES:
            self.index, self.lattice = _Index(), None
        known, out = len(self.index), []
        for text in texts:
            words = words_of(text)
            out.append(np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)))
        if len(self.index) > known:
            made = Lattice(self.pieces, list(islice(self.index, known, None)))
            self.lattice = self.lattice.extend(made) if self.lattice is not None else made
        return out


def ids_of(lattice: Lattice, pieces: Pieces, edges: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of paths that lie end to end, and where each begins; characters without a piece become their bytes."""
    ids = lattice.ids[edges]
    lone = np.flatnonzero(ids < 0)
    if not len(lone):
        return ids, begin
    cp = -1 - ids[lone]
    ids[lone[cp < 128]] = pieces.byte_id[cp[cp < 128]]
    wide = lone[cp >= 128]
    if not len(wide):
        return ids, begin
    spelt = [pieces.byte_id[list(chr(i).encode("utf-8", "surrogatepass"))] for i in cp[cp >= 128].tolist()]
    count = np.ones(len(ids), np.int64)
    count[wide] = [len(x) for x in spelt]
    place = np.concatenate(([0], np.cumsum(count)))
    out = np.repeat(ids, count)
    inside = np.zeros(len(ids), bool)
    inside[wide] = True
    out[np.repeat(inside, count)] = np.concatenate(spelt)
    return out, place[begin]


def row_key(key, text: str) -> int:
    return (int(key) if key is not None else zlib.crc32(text.encode())) % (1 << 64)


def sample_texts(pieces: Pieces, keys: list, texts: list[str], k: int, seed: int, words: Words | None = None):
    """For each text, a list of (ids, log_prob, inclusion), best perturbed value first."""
    words = words or Words(pieces)
    per_doc = words.numbers(texts)
    lattice = words.lattice
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= GROUP_CHARS):
            size += len(texts[j])
            j += 1
        if lattice is None:
            for _ in range(i, j):
                yield [(np.zeros(0, np.int32), 0.0, 1.0)]
        else:
            hashed = np.array([row_key(a, b) for a, b in zip(keys[i:j], texts[i:j])], np.uint64)
            paths, threshold = Sampler(lattice, per_doc[i:j], hashed, seed).run(k)
            made = []
            for edges, begin, logp, alive in paths:
                ids, begin = ids_of(lattice, pieces, edges, begin)
                with np.errstate(invalid="ignore", over="ignore"):
                    inclusion = -np.expm1(-np.exp(np.minimum(logp - threshold, 50.0)))
                inclusion[~np.isfinite(threshold)] = 1.0
                made.append((ids, begin.tolist(), logp.tolist(), inclusion.tolist(), alive.tolist()))
            for d in range(j - i):
                yield [(ids[begin[d] : begin[d + 1]], logp[d], inclusion[d]) for ids, begin, logp, inclusion, alive in made if alive[d]]
        i = j


def decode_ids(pieces_text: np.ndarray, byte_value: dict[int, int], is_byte: np.ndarray, ids: np.ndarray) -> str:
    """The text of piece ids: bytes are gathered to UTF-8, space marks are spaces, the first one is the model's own.
    ``pieces_text`` (objects) and ``is_byte``, whether an id is in ``byte_value``, go by id."""
    if not is_byte[ids].any():
        text = "".join(pieces_text[ids].tolist())
        return (text[1:] if text[:1] == chr(MARK) else text).replace(chr(MARK), " ")
    out, held = [], bytearray()
    for i in ids.tolist():
        if i in byte_value:
            held.append(byte_value[i])
            continue
        if held:
            out.append(held.decode("utf-8", "replace"))
            held = bytearray()
        out.append(pieces_text[i])
    if held:
        out.append(held.decode("utf-8", "replace"))
    text = "".join(out)
    return (text[1:] if text[:1] == chr(MARK) else text).replace(chr(MARK), " ")


_FULL = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("inclusion", pa.float64()), ("ids_crc32", pa.int64())]))
_FULL_SQL = "array<struct<ids: array<int>, log_prob: double, inclusion: double, ids_crc32: long>>"
_BRIEF_SQL = "array<struct<n_pieces: int, log_prob: double, inclusion: double, ids_crc32: long>>"
_BRIEF = pa.list_(pa.struct([("n_pieces", pa.int32()), ("log_prob", pa.float64()), ("inclusion", pa.float64()), ("ids_crc32", pa.int64())]))


def _sample_batches(blob: bytes, k: int, seed: int, brief: bool):
    def run(batches):
        import sentencepiece

        pieces = Pieces(blob)
        words = Words(pieces)
        sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        names = np.array([sp.id_to_piece(i) for i in range(sp.get_piece_size())], object)
        byte_value = {int(i): b for b, i in enumerate(pieces.byte_id) if b >= 128}
        for b in range(128):  # an ASCII byte is its own character
            names[pieces.byte_id[b]] = chr(b)
        is_byte = np.zeros(len(names), bool)
        is_byte[list(byte_value)] = True

        def emit(rows, exact, sizes):
            ids = [i for i, _, _ in rows]
            lengths = np.fromiter(map(len, ids), np.int32, len(ids))
            fields = [pa.array([p for _, p, _ in rows], pa.float64()), pa.array([q for _, _, q in rows], pa.float64())]
            fields.append(pa.array([zlib.crc32(i) for i in ids], pa.int64()))
            if brief:
                kind, arrays = _BRIEF, [pa.array(lengths), *fields]
            else:
                flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
                ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                kind, arrays = _FULL, [pa.ListArray.from_arrays(pa.array(ends), flat), *fields]
            made = pa.StructArray.from_arrays(arrays, fields=list(kind.value_type))
            return pa.ListArray.from_arrays(pa.array(np.array(sizes, np.int32)), made), pa.array(exact)

        def results(keys, texts):
            """(rows done, samples, round trips) whenever enough ids have come together."""
            rows, exact, sizes, held = [], [], [0], 0
            for text, paths in zip(texts, sample_texts(pieces, keys, texts, k, seed, words)):
                plain = text.replace(chr(MARK), " ")
                exact.append(all(decode_ids(names, byte_value, is_byte, ids) == plain for ids, _, _ in paths))
                sizes.append(sizes[-1] + len(paths))
                rows += paths
                held += sum(len(i) for i, _, _ in paths)
                if held >= OUT_IDS:
                    yield len(exact), *emit(rows, exact, sizes)
                    rows, exact, sizes, held = [], [], [0], 0
            if exact:
                yield len(exact), *emit(rows, exact, sizes)

        for batch in batches:
            keys, texts = batch.column("doc_id"), batch.column("text")
            i = 0
            while i < batch.num_rows:
                part, size = [], 0
                while i + len(part) < batch.num_rows and size <= BATCH_CHARS:
                    part.append(texts[i + len(part)].as_py() or "")
                    size += len(part[-1])
                for n, samples, exact in results(keys.slice(i, len(part)).to_pylist(), part):
                    yield pa.RecordBatch.from_arrays([keys.slice(i, n), samples, exact], ["doc_id", "samples", "round_trip"])
                    i += n

    return run


def sample_segmentations(docs: DataFrame, model_path: str, k: int = 2, seed: int = 7, brief: bool = False) -> DataFrame:
    """(doc_id, samples, round_trip): up to ``k`` distinct segmentations of every whole text with log-probability,
    inclusion score and the CRC-32 of the ids, and whether all of them decode to the text. ``brief`` gives lengths
    instead of the ids. No shuffle."""
    with open(model_path, "rb") as f:
        blob = f.read()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _sample_batches(blob, k, seed, brief), f"doc_id {kind}, samples {_BRIEF_SQL if brief else _FULL_SQL}, round_trip boolean"
    )


def _codec_batches(blob: bytes, decode: bool):
    def run(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        for batch in batches:
            if decode:
                out = pa.array([None if x is None else sp.decode(x) for x in batch.column("ids").to_pylist()], pa.string())
            else:
                out = pa.array(sp.encode([x or "" for x in batch.column("text").to_pylist()], num_threads=1), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], ["doc_id", "text" if decode else "ids"])

    return run


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids): the library's best segmentation of every whole text."""
    with open(model_path, "rb") as f:
        blob = f.read()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_codec_batches(blob, False), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids stay null."""
    with open(model_path, "rb") as f:
        blob = f.read()
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(_codec_batches(blob, True), f"doc_id {kind}, text string")


by_value(__name__)
