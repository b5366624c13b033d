"""Periodic runs: stretches of words that repeat themselves three times or more, by an enhanced suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, byte_slices

RUN = "start long, length long, period long"


class SuffixArrays:
    """Suffix arrays of many sequences at once, by doubling: ``sa``, its inverse ``isa``, and the ranks of every level.

    The symbols of each sequence are its own, so the suffixes of one sequence are neighbours and no prefix is shared
    across sequences. ``levels[k][i]`` is equal for two places exactly if the 2^k symbols from there on are equal (a
    suffix shorter than that equals no other). Only groups that still tie are sorted again. From length ``reach`` on, sequences in
    which nothing of that length repeats are left out; ``live`` tells which are complete.
    """

    def __init__(self, symbols: np.ndarray, first: np.ndarray, reach: int = 1):
        n = len(symbols)
        rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.ends = np.append(np.repeat(first[1:], np.diff(first)), n)
        self.begins = np.append(np.repeat(first[:-1], np.diff(first)), n)
        key = rows * (int(symbols.max()) + 1 if n else 1) + symbols
        sa = np.argsort(key, kind="stable")
        rank = np.full(n + 1, -1, dtype=np.int64)
        rank[sa] = self._groups(key[sa], np.arange(n))
        self.levels, self.live = [], np.ones(len(first) - 1, dtype=bool)
        width = 1
        while n:
            self.levels.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
            own = rank[sa]
            tied = np.zeros(n, dtype=bool)
            tied[1:] = own[1:] == own[:-1]
            tied[:-1] |= tied[1:].copy()
            if width <= reach:
                self.live = np.zeros(len(first) - 1, dtype=bool)
                self.live[rows[sa[tied]]] = True
            slots = np.flatnonzero(tied & self.live[rows[sa]])
            if not len(slots):
                break
            place = sa[slots]
            after = np.where(place + width < self.ends[place], rank[np.minimum(place + width, n)], -1)
            key = rank[place] * (n + 1) + after + 1
            order = np.argsort(key, kind="stable")
            sa[slots] = place[order]
            rank[place[order]] = self._groups(key[order], slots)
            width *= 2
        self.sa, self.isa = sa, np.full(n + 1, -1, dtype=np.int64)
        self.isa[sa] = np.arange(n)

    @staticmethod
    def _groups(key: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Of each sorted key the slot of the first equal one."""
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        return slots[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))] if len(key) else slots

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from ``a`` and ``b`` (different places of one sequence) on agree."""
        length = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            length += (level[a + length] == level[b + length]).astype(np.int64) << k
        return length

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols just before ``a`` and ``b``, ``a`` < ``b``, agree."""
        length, begin = np.zeros(len(a), dtype=np.int64), self.begins[a]
        for k in range(len(self.levels) - 1, -1, -1):
            at = a - length - (1 << k)
            inside = at >= begin
            at = np.where(inside, at, 0)
            length += (inside & (self.levels[k][at] == self.levels[k][np.where(inside, b - length - (1 << k), 0)])).astype(np.int64) << k
        return length


def lcp_intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(boundaries, lefts, rights) of the LCP intervals: of each boundary with a positive value the slots its interval spans.

    ``lcp[x]`` lies between the slots x - 1 and x. The nearest smaller values to both sides are found by halving steps
    over a table of minima, for all boundaries together.
    """
    at = np.flatnonzero(lcp > 0)
    depth, n = lcp[at], len(lcp)
    minima = [lcp]
    while 2 << (len(minima) - 1) <= n:
        last, half = minima[-1], 1 << (len(minima) - 1)
        minima.append(np.minimum(last[:-half], last[half:]))
    left, right = at.copy(), at + 1
    for k in range(len(minima) - 1, -1, -1):
        table, step = minima[k], 1 << k
        inside = left - step >= 0
        left = left - step * (inside & (table[np.where(inside, left - step, 0)] >= depth))
        inside = right + step <= n
        right = right + step * (inside & (table[np.where(inside, right, 0)] >= depth))
    return at, left - 1, right - 1


def branching_squares(arrays: SuffixArrays, symbols: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of every square that the next symbol does not prolong, among the suffixes in ``slots`` (ascending).

    In each LCP interval of depth d, all children but the largest hand out their suffixes; a suffix i forms a square with i + d or
    i - d if that one's slot lies in the interval. Whichever child is left out, one end of each branching square is in another.
    """
    sa = arrays.sa[slots]
    lcp = np.zeros(len(slots), dtype=np.int64)
    same = np.flatnonzero(arrays.begins[sa[1:]] == arrays.begins[sa[:-1]]) + 1
    lcp[same] = arrays.common(sa[same - 1], sa[same])
    at, left, right = lcp_intervals(lcp)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((at, right, left))
    at, left, right, depth = at[order], left[order], right[order], lcp[at[order]]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    last = np.append(new[1:], True)
    # children: before each boundary the piece since the one before it, and the piece behind the last one
    begin = np.concatenate([np.where(new, left, np.concatenate([[0], at[:-1]])), at[last]])
    end = np.concatenate([at, right[last] + 1])
    group = np.cumsum(new) - 1
    group = np.concatenate([group, group[last]])
    low, high, depth = (np.concatenate([x, x[last]]) for x in (left, right, depth))
    order = np.lexsort((begin - end, group))
    largest = np.ones(len(order), dtype=bool)
    largest[1:] = group[order][1:] != group[order][:-1]
    small = order[~largest]
    size = (end - begin)[small]
    child = np.repeat(small, size)
    place = sa[begin[child] + np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size)]
    low, high, depth = slots[low[child]], slots[high[child]], depth[child]
    found = []
    for shift in (1, -1):
        other = place + shift * depth
        fits = (other >= arrays.begins[place]) & (other < arrays.ends[place])
        slot = arrays.isa[np.where(fits, other, 0)]
        fits &= (slot >= low) & (slot <= high)
        start, period = np.minimum(place, other)[fits], depth[fits]
        over = start + 2 * period
        stop = over == arrays.ends[start]
        stop |= symbols[start + period] != symbols[np.where(stop, 0, over)]
        found.append(np.stack([start[stop], period[stop]]))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    return pairs[0], pairs[1]


def find_runs(symbols: np.ndarray, first: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in the row, length, period) of all runs, by row, start, period.

    A run of period p has its first length - p words again p words later, and with the given least length and exponent that overlap
    has at least min_length * (exponent - 1) / exponent words. Rows in which nothing of that length repeats need no intervals.
    """
    reach = max(1, -(-min_length * (min_exponent - 1) // min_exponent))
    arrays = SuffixArrays(symbols, first, reach)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    slots = np.flatnonzero(arrays.live[rows[arrays.sa]]) if len(symbols) else np.zeros(0, np.int64)
    if not len(slots):
        return (np.zeros(0, np.int64),) * 4
    place, period = branching_squares(arrays, symbols, slots)
    # rotate each square to the left as far as its period holds; squares of one stretch meet in the same run
    start = place - arrays.common_before(place, place + period)
    end = place + 2 * period
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    keep = np.ones(len(start), dtype=bool)  # the smallest period of each stretch
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    keep &= end - start >= np.maximum(min_length, min_exponent * period)
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    row = rows[start]
    return row, start - first[row], end - start, period


def collapse_runs(docs: DataFrame, min_length: int = 24, min_exponent: int = 3, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` reduced to the words outside the repetitions of its runs (joined by one space), ``n_words`` and ``runs``.

    Words are runs of anything but ASCII blanks, unchanged. A run is a stretch of consecutive words of one text with smallest
    period p and at least max(``min_length``, ``min_exponent`` * p) words that no neighbouring word extends keeping p. ``runs`` lists
    start (word number from 0), length and period, by start, then period. A word goes if any run contains it after that run's
    first p words. Each row is judged by itself, so repeated rows get equal results; a null or blank text has no words, no runs and an empty
    text. Other columns pass through; input columns named ``n_words`` or ``runs`` are replaced.

    Rows never meet, so there is no shuffle; a task holds some 2 MB of texts, or one longer text, with about log2(longest repeat)
    numbers a word. Time is n log n in the words of a text, whatever it repeats.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError("min_exponent must be 2 at least, min_length 1")
    keep = [c for c in docs.columns if c not in ("n_words", "runs")]
    rows = docs.select(F.struct(*[F.col(c) for c in keep if c != text], F.lit(0).alias("__pad")).alias("__rest"), F.col(text).alias("text"))
    schema = rows.withColumns({"n_words": F.lit(0).cast("long"), "runs": F.array().cast(f"array<struct<start: bigint, length: bigint, period: bigint>>")}).schema
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                words = Words(batch.column("text"))
                first = np.asarray(words.first, dtype=np.int64)
                row, start, length, period = find_runs(words.ids(), first, min_length, min_exponent)
                gone = np.zeros(len(words.hashes) + 1, dtype=np.int64)
                np.add.at(gone, first[row] + start + period, 1)
                np.add.at(gone, first[row] + start + length, -1)
                stay = np.cumsum(gone)[:-1] == 0
                raw, kept = words.data.tobytes(), []
                for r in range(batch.num_rows):
                    own = first[r] + np.flatnonzero(stay[first[r] : first[r + 1]])
                    kept.append(b" ".join([raw[s:e] for s, e in zip(words.starts[own].tolist(), words.ends[own].tolist(), strict=True)]))
                at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                runs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(kind))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__rest"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(at), runs)],
                    names=["__rest", "text", "n_words", "runs"],
                )

    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col("text").alias(c) if c == text else F.col(f"__rest.`{c}`") for c in keep], "n_words", "runs")
