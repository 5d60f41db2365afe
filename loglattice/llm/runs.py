"""Periodic runs of words: maximal repetitions from suffix trees and Lyndon roots.

Method. Ukkonen's algorithm builds the suffix trees of a document's words and of their reversal. An Euler tour of
a tree with range minima answers the longest common extension of two places in constant time. Under an order of
the words, or its inverse, every run holds the longest Lyndon word at one of its places as its root; those words
end at the next smaller suffix, known from the order of the leaves. So each place offers two candidates, which
are extended to the right by one tree and to the left by the other.

Before, words that can be in no run asked for are taken out: a run repeats its windows of some words one period
on, so each of its words is in a window that occurs again in the same stretch (`window` says how wide it may be).
What remains are stretches of consecutive words; a run lies in one of them. A document's
stretches share its trees, with separators that occur once and so are part of no run. Words are compared by
themselves; only the test of the windows uses hashes, where an equal hash keeps words and loses none.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import pieces

LEAST, TIMES = 6, 4
PIECE = 1 << 22  # bytes of text worked on at once
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class RangeMin:
    """Minima of ranges of an array: in blocks of 16 from both ends, and between blocks from a table of powers."""

    def __init__(self, values: np.ndarray):
        padded = np.full(-(-len(values) // 16) * 16, np.iinfo(values.dtype).max, dtype=values.dtype)
        padded[: len(values)] = values
        self.values, blocks = padded, padded.reshape(-1, 16)
        self.ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        self.behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(blocks)
        self.table = np.empty((n.bit_length(), n), dtype=values.dtype)
        self.table[0] = blocks.min(axis=1)
        for k in range(1, n.bit_length()):
            step = 1 << (k - 1)
            self.table[k] = self.table[k - 1]
            np.minimum(self.table[k - 1][:-step], self.table[k - 1][step:], out=self.table[k][: n - step])

    def query(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Minimum of values[left..right], both ends included."""
        first, last = left >> 4, right >> 4
        out = np.minimum(self.behind[left], self.ahead[right])
        far = np.flatnonzero(last - first > 1)
        if len(far):
            lo, hi = first[far] + 1, last[far] - 1
            k = np.log2(hi - lo + 1).astype(np.int64)
            out[far] = np.minimum(out[far], np.minimum(self.table[k, lo], self.table[k, hi - (1 << k) + 1]))
        same = np.flatnonzero(first == last)
        if len(same):
            at = left[same][:, None] + np.arange(16)
            inside = at <= right[same][:, None]
            out[same] = np.where(inside, self.values[np.minimum(at, len(self.values) - 1)], np.iinfo(self.values.dtype).max).min(axis=1)
        return out


def suffix_tree(text: list[int]) -> tuple[list[int], list[int], dict[int, int], int]:
    """Ukkonen's tree of a text whose last symbol occurs once: (first, last, go, width).

    Node v is entered by text[first[v]:last[v]]; go[v * width + symbol] is the child of v whose edge begins so.
    """
    n, width = len(text), max(text) + 1
    first, last, link, go = [0], [0], [0], {}
    node = edge = depth = due = 0
    for i, symbol in enumerate(text):
        due += 1
        waiting = 0
        while due:
            if not depth:
                edge = i
            key = node * width + text[edge]
            below = go.get(key)
            if below is None:
                go[key] = len(first)
                first.append(i)
                last.append(n)
                link.append(0)
                if waiting:
                    link[waiting] = node
                    waiting = 0
            else:
                begin = first[below]
                span = last[below] - begin
                if depth >= span:
                    edge += span
                    depth -= span
                    node = below
                    continue
                if text[begin + depth] == symbol:
                    if waiting:
                        link[waiting] = node
                    depth += 1
                    break
                split = len(first)
                first += (begin, i)
                last += (begin + depth, n)
                link += (0, 0)
                first[below] = begin + depth
                go[key] = split
                go[split * width + symbol] = split + 1
                go[split * width + text[begin + depth]] = below
                if waiting:
                    link[waiting] = split
                waiting = split
            due -= 1
            if node:
                node = link[node]
            elif depth:
                depth -= 1
                edge = i - due + 1
    return first, last, go, width


class Extensions:
    """Longest common extensions of a text of positive codes; `where` orders the places by their suffix."""

    def __init__(self, codes: list[int]):
        text = [*codes, 0]
        first, last, go, width = suffix_tree(text)
        n, nodes = len(text), len(first)
        keys = np.fromiter(go.keys(), np.int64, len(go))
        order = np.argsort(keys)
        kids = np.fromiter(go.values(), np.int64, len(go))[order].tolist()
        begin = np.searchsorted(keys[order] // width, np.arange(nodes + 1)).tolist()
        del go
        turn, deep, path, tour, where = begin[:-1], [0] * nodes, [0], [0], [0] * n
        while path:
            v = path[-1]
            k = turn[v]
            if k < begin[v + 1]:
                turn[v] = k + 1
                u = kids[k]
                d = deep[u] = deep[v] + last[u] - first[u]
                if begin[u] == begin[u + 1]:
                    where[n - d] = len(tour)
                    tour += (d, deep[v])
                else:
                    path.append(u)
                    tour.append(d)
            else:
                path.pop()
                if path:
                    tour.append(deep[path[-1]])
        self.where, self.low = np.array(where), RangeMin(np.array(tour, dtype=np.int64))

    def longest(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and from j on; i and j differ and may be the end of the text."""
        a, b = self.where[i], self.where[j]
        return self.low.query(np.minimum(a, b), np.maximum(a, b))


def lyndon_ends(rank: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each place the next one with a smaller suffix, and the next one with a greater one."""
    n = len(rank)
    smaller, greater = [n] * n, [n] * n
    for i in range(n - 2, -1, -1):
        own, j, k = rank[i], i + 1, i + 1
        while j < n and rank[j] > own:
            j = smaller[j]
        while k < n and rank[k] < own:
            k = greater[k]
        smaller[i], greater[i] = j, k
    return np.array(smaller), np.array(greater)


def maximal_runs(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of the runs of positive codes, by start, then period."""
    n = len(codes)
    if n < least:
        return np.zeros((0, 3), dtype=np.int64)
    text = codes.tolist()
    forth, back = Extensions(text), Extensions(text[::-1])
    ends = lyndon_ends(forth.where.tolist())
    start = np.concatenate([np.arange(n + 1)] * 2)
    period = np.concatenate(ends) - start
    fits = (start + period <= n) & (times * period <= n)
    start, period = start[fits], period[fits]
    right = forth.longest(start, start + period)
    left = back.longest(n - start, n - start - period)
    length = left + period + right
    long = length >= np.maximum(least, times * period)
    found = np.stack([start - left, period, length], axis=1)[long]
    return np.unique(found, axis=0)[:, [0, 2, 1]] if len(found) else np.zeros((0, 3), dtype=np.int64)


def window(least: int, times: int) -> int:
    """Widest window of which each one in a run occurs again in the run, one period before or behind."""
    return max(k for k in range(1, least) if k == 1 or all(max(least, times * q) >= 2 * q + k - 1 for q in range(1, 2 * least)))


def stretches(codes: np.ndarray, owner: np.ndarray, width: int, rounds: int = 4) -> np.ndarray:
    """True for words in a window of `width` words that occurs again in the same stretch of the same owner.

    Each round looks into what the one before has left; any number of rounds keeps all words of runs.
    """
    kept = np.arange(len(codes))
    weights = np.random.default_rng(12).integers(1, 1 << 62, width + 1, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    wide = codes.astype(np.uint64)
    stretch = owner.astype(np.int64)
    for _ in range(rounds):
        if len(kept) < width:
            break
        m = len(kept) - width + 1
        whole = stretch[width - 1 :] == stretch[:m]
        key = stretch[:m].astype(np.uint64) * weights[width]
        for i in range(width):
            mixed = (wide[kept[i : i + m]] + np.uint64(i + 1)) * weights[i]
            key += mixed ^ (mixed >> np.uint64(29))
        ordered = np.sort(key[whole])
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return np.zeros(len(codes), dtype=bool)
        again = whole & (twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key)
        edge = np.zeros(len(kept) + 1, dtype=np.int64)
        np.add.at(edge, np.flatnonzero(again), 1)
        np.add.at(edge, np.flatnonzero(again) + width, -1)
        inside = np.cumsum(edge[:-1]) > 0
        if inside.all():
            break
        old, kept = stretch, kept[inside]
        # a new stretch wherever words were left out between, or the owner changes
        stretch = np.cumsum(np.concatenate([[True], (np.diff(kept) > 1) | (np.diff(old[inside]) != 0)]))
    out = np.zeros(len(codes), dtype=bool)
    if len(kept) >= width:
        out[kept] = True
    return out


def find_runs(documents: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """Rows (start, length, period) of each document's runs, by start, then period."""
    number: defaultdict[bytes, int] = defaultdict(count(1).__next__)
    sizes = np.array([len(d) for d in documents])
    codes = np.fromiter((number[w] for d in documents for w in d), np.int64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    marked = stretches(codes, np.repeat(np.arange(len(documents)), sizes), window(least, times))
    out = []
    for begin, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        at = np.flatnonzero(marked[begin : begin + size])
        if len(at) < least:
            out.append(np.zeros((0, 3), dtype=np.int64))
            continue
        # the stretches of the document, one behind the other with a code of its own after each
        breaks = np.concatenate([[0], np.cumsum(np.diff(at) > 1)])
        place = np.arange(len(at)) + breaks
        small = np.unique(codes[begin + at], return_inverse=True)[1] + 1
        text = np.zeros(place[-1] + 1, dtype=np.int64)
        text[place] = small
        text[text == 0] = small.max() + 1 + np.arange(breaks[-1])
        found = maximal_runs(text, least, times)
        origin = np.zeros(len(text), dtype=np.int64)
        origin[place] = at
        found[:, 0] = origin[found[:, 0]]
        out.append(found)
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one blank, without those that a run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, runs, collapsed) per row of `docs`.

    runs holds (start, length, period) of every stretch of words with smallest period q and at least
    max(least, times * q) words that no neighbour extends, by start, then period; start counts words from 0.
    collapsed is the text without repeats: its words, joined by one blank, but those that a run holds after its
    first q words. Words are what stands between blanks (space, and \\t to \\r). Null text counts as empty and
    gives no run and an empty text. Each row is read by itself: ties, repeated rows and other columns change
    nothing, an empty table gives an empty result, and a text of any length is read whole. least > 2, times > 1.
    """
    if least < 3 or times < 2:
        raise ValueError("least must be 3 or more, times 2 or more")

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
            for begin, end in pieces(sizes, PIECE):
                words = [(t or b"").split() for t in texts.slice(begin, end - begin).to_pylist()]
                found = find_runs(words, least, times)
                left = pa.array([collapsed(w, r) for w, r in zip(words, found, strict=True)], pa.binary()).cast(pa.string())
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]), pa.int32())
                flat = np.concatenate(found)
                runs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.ListArray.from_arrays(offsets, runs), left], names=["doc_id", "runs", "collapsed"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, runs {RUNS}, collapsed string")
