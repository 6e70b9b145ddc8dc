"""Periodic runs of words: Lyndon roots of a text, extended both ways by a suffix tree of it and one of its reversal.

A run is a stretch of words with smallest period q, of at least LEAST words and EXPONENT periods, that no word
on either side extends. Every run holds the longest Lyndon word that starts at one of its places, in one of
two opposite orders of words, as its root; so two candidates a place are enough. A root is extended to the right
by the longest common extension of two places in the text, and to the left by that in its reversal. Extensions
are the depth of a lowest common ancestor of two leaves of an Ukkonen tree, in constant time by an
Euler tour and a table of its minima.

Trees are built only for stretches that can hold a run. In a run of n words, each word comes again within n /
EXPONENT words. A word that doesn't, within its stretch, cuts it in two, until nothing changes; no run is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, EXPONENT = 6, 4
#: Words of the texts that are searched for stretches at a time; one longer text is taken by itself.
WORDS_AT_ONCE = 1 << 20


class SuffixTree:
    """Ukkonen's tree of a list of symbols from 1 on, with 0 as its end; edges are sorted by node and symbol once it is built."""

    def __init__(self, symbols: list[int]) -> None:
        self.text = [*symbols, 0]
        self.width = max(symbols, default=0) + 1
        text, width, n = self.text, self.width, len(self.text)
        start, stop, link, edges = [0], [0], [0], {}
        node = edge = length = waiting = 0  # the active point, and the suffixes that aren't leaves yet
        for i, c in enumerate(text):
            waiting += 1
            inner = 0
            while waiting:
                if not length:
                    edge = i
                key = node * width + text[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if inner:
                        link[inner] = node
                        inner = 0
                else:
                    at = start[child]
                    span = (stop[child] if stop[child] <= i else i + 1) - at
                    if length >= span:
                        node, edge, length = child, edge + span, length - span
                        continue
                    if text[at + length] == c:
                        length += 1
                        if inner:
                            link[inner] = node
                        break
                    middle = len(start)  # the edge is cut, and the new leaf hangs on the cut
                    edges[key] = middle
                    start += (at, i)
                    stop += (at + length, n)
                    link += (0, 0)
                    start[child] = at + length
                    edges[middle * width + text[at + length]] = child
                    edges[middle * width + c] = middle + 1
                    if inner:
                        link[inner] = middle
                    inner = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        keys = keys[order]
        self.children = np.fromiter(edges.values(), np.int64, len(edges))[order].tolist()
        self.opens = (keys % width).tolist()
        self.first = np.searchsorted(keys // width, np.arange(len(start) + 1)).tolist()
        self.spans = [b - a for a, b in zip(start, stop, strict=True)]

    def leaves(self, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
        """The Euler tour, cut at its leaves: suffixes in order, and the least depth between each and the one before.

        ``backwards`` takes the opposite order of symbols; an end comes first in both.
        """
        children, first, spans, n = self.children, self.first, self.spans, len(self.text)
        suffixes, between, stack, low = [], [], [(0, 0, -1)], 0
        while stack:
            node, above, parted = stack.pop()
            if parted >= 0:  # not a first child: the tour has come back to its parent
                low = parted
            a, b, depth = first[node], first[node + 1], above + spans[node]
            if a == b:
                suffixes.append(n - depth)
                between.append(low)
                continue
            below = children[a:b]
            if backwards:
                below = [below[0], *below[:0:-1]] if self.opens[a] == 0 else below[::-1]
            stack += [(child, depth, depth) for child in below[:0:-1]]
            stack.append((below[0], depth, -1))
        return np.array(suffixes), np.array(between)


class Extensions:
    """Longest common extensions of places of a text: minima of an Euler tour by a table of powers of two."""

    def __init__(self, suffixes: np.ndarray, between: np.ndarray) -> None:
        self.rank = np.empty(len(suffixes), np.int64)
        self.rank[suffixes] = np.arange(len(suffixes))
        self.table = [between.astype(np.int32)]
        while 2 << (len(self.table) - 1) <= len(between):
            last, step = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-step], last[step:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols agree from i and j on; i and j differ."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k) + 1])
        return out


def _roots(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word from each place on: up to the next smaller suffix."""
    ranks, stack = rank.tolist(), []
    ends = [0] * len(ranks)
    for i, r in enumerate(ranks):
        while stack and ranks[stack[-1]] > r:
            ends[stack.pop()] = i
        stack.append(i)
    return np.array(ends[:-1]) - np.arange(len(ranks) - 1)


def runs_of(symbols: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs of a sequence, by start and period."""
    n = len(symbols)
    symbols = (np.unique(symbols, return_inverse=True)[1] + 1).tolist()
    tree = SuffixTree(symbols)
    suffixes, between = tree.leaves(False)
    opposite = tree.leaves(True)[0]
    del tree
    ahead = Extensions(suffixes, between)
    rank = np.empty(n + 1, np.int64)
    rank[opposite] = np.arange(n + 1)
    found = []
    for period in (_roots(ahead.rank), _roots(rank)):
        at = np.flatnonzero(period * EXPONENT <= n)
        right = ahead.of(at, at + period[at])
        keep = right > 0  # a run of more than two periods has a root after which its first word comes again
        found.append(np.stack([at[keep], period[at][keep], right[keep]]))
    del ahead
    at, period, right = np.unique(np.concatenate(found, axis=1), axis=1)
    if not len(at):
        return np.empty((0, 3), np.int64)
    behind = Extensions(*SuffixTree(symbols[::-1]).leaves(False))
    # Places before i and i + period are n - i and n - i - period of the reversal.
    left = behind.of(n - at, n - at - period)
    length = left + period + right
    good = (length >= LEAST) & (length >= EXPONENT * period)
    return np.unique(np.stack([at - left, length, period], axis=1)[good], axis=0)


def stretches(ids: np.ndarray, text_of: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches that can hold a run; ``ids`` are equal for equal words of a text only."""
    at, group = np.arange(len(ids)), text_of
    while len(at):
        # Of each word, the distance to the next and the last equal one in its stretch.
        order = np.lexsort((at, ids[at], group))
        same = (ids[at][order][1:] == ids[at][order][:-1]) & (group[order][1:] == group[order][:-1])
        gap = np.where(same, at[order][1:] - at[order][:-1], len(ids) + 1)
        nearest = np.empty(len(at), np.int64)
        nearest[order] = np.minimum(np.append(gap, len(ids) + 1), np.insert(gap, 0, len(ids) + 1))
        size = np.bincount(group)[group]
        keep = (nearest * EXPONENT <= size) & (size >= LEAST)
        cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(group) > 0)) + 1
        if keep.all():
            bounds = [0, *cut.tolist(), len(at)]
            yield from ((int(at[a]), int(at[b - 1]) + 1) for a, b in zip(bounds, bounds[1:], strict=False))
            return
        kept = np.flatnonzero(keep)
        at, group = at[kept], group[kept]
        group = np.cumsum(np.insert((np.diff(at) > 1) | (np.diff(group) > 0), 0, False))


def _search(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as words."""
    ids: list[int] = []
    for words in texts:
        seen: dict[bytes, int] = {}
        base = len(ids)
        ids += [seen.setdefault(w, base + n) for n, w in enumerate(words)]
    sizes = np.array([len(words) for words in texts])
    starts, symbols = np.cumsum(sizes) - sizes, np.array(ids, np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    text_of = np.repeat(np.arange(len(texts)), sizes)
    for a, b in stretches(symbols, text_of):
        text = int(text_of[a])
        out[text] += [(a - int(starts[text]) + s, n, q) for s, n, q in runs_of(symbols[a:b]).tolist()]
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by a space."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words)


RUNS = "array<struct<start:long,length:long,period:long>>"


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs, collapsed) of each document: its runs by start and period, and its text without their repetitions.

    Words are the stretches without ASCII white space, compared byte by byte. In ``collapsed`` a word that any run
    contains after that run's first period is left out, and the others are joined by one space. Defined
    results: a null, empty or wordless text has no run and is empty; each row gives a row, repeated or not;
    a null id is kept; an empty table gives none; other columns are ignored. A task holds one text, and the tree
    of one stretch of it, some 800 bytes for each of its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def out(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            runs = _search(texts)
            flat = np.array([r for each in runs for r in each], np.int64).reshape(-1, 3)
            offsets = np.cumsum([0, *map(len, runs)])
            spans = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kind.value_type))
            collapsed = pa.array([_collapsed(w, r) for w, r in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans, type=kind), collapsed], names=["id", "runs", "collapsed"])

        for batch in batches:
            ids, texts, held = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = text.as_py().split() if text.is_valid else []
                if ids and held + len(words) > WORDS_AT_ONCE:
                    yield out(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(words)
                held += len(words)
            if ids:
                yield out(ids, texts)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id long, runs {RUNS}, collapsed string")


def with_repeats(text: Column, h: Column) -> Column:
    """The text, or for one in ten values of h a text whose words repeat with one period from some place on.

    With g = h // 10, n words, a = g % n and p = 1 + (n - a) // (3 + g % 8), word i >= a becomes word a + (i - a) % p.
    """
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (g % 8 + 3))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    # The words are an argument of a function, so that they are split once.
    words = F.filter(F.array(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), lambda w: F.size(w) > 0)
    return F.when(h % 10 == 0, F.coalesce(F.get(F.transform(words, repeated), F.lit(0)), text)).otherwise(text)
