"""Runs of words: maximal periodic stretches, by the Lyndon arrays of both orders of the words.

A run of period q is the repetition of its Lyndon root, which is the longest Lyndon word at its first place in one of the
two orders (words ascending or descending). So for each order a pass from left to right finds, of every place, the next
smaller suffix; a place and its next smaller suffix that agree far enough are a root and its repetition, and reach as far
to the left as the words agree.

Suffixes are compared word by word, but a comparison never reads again what an earlier one matched: the matched stretch
that ends farthest right is kept, and a place inside it takes the length it agrees on from its mirror place, as the pairs
that were compared there left theirs in the arrays. Only words beyond the farthest end are compared. No suffix array, no
longest-common-prefix table and no hash of a stretch of words is made; words are only told apart and put in an order.

Words too rare to lie in a run cut the text first: a run of exponent x repeats each of its words x times within the
stretch, so words found less often in the text, and then in a stretch, are in none and can't extend one.

Defined cases: a null or empty text has no words, no run and an empty collapsed text; a null id is carried; rows that
repeat are read each on their own; a very long text is one task's work, in memory in proportion to its words; an empty
table gives no row. The columns of docs stay, ones named like a result are replaced."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qsolake.llm.common import short_batches, tidied

#: A run has at least this many words and this many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
RESULTS = ("runs", "collapsed")


def roots(w: list[int], periods: float) -> Iterator[tuple[int, int, int]]:
    """(place, period, words matched at that distance) of places whose next smaller suffix agrees for periods - 2 periods."""
    n = len(w)
    nxt, matched = [n] * n, [0] * n  # next smaller suffix, and how far both agree
    prev, back = [-1] * n, [0] * n  # the same of the place before that is smaller
    lo = hi = end = 0  # w[hi:end] is known to equal the words from lo on, and ends farthest right
    waiting: list[int] = []
    for r in range(n):
        c = w[r]
        while waiting:
            left = waiting[-1]
            x = w[left]
            if x < c:
                prev[r] = left
                break
            if x > c:
                nxt[left] = r
                waiting.pop()
                continue
            k, fixed = 1, False
            if r < end:
                mirror, other = r - hi + lo, left - hi + lo if left >= hi else left
                if mirror == other:
                    k = end - r
                elif nxt[other] == mirror or prev[mirror] == other:
                    k = matched[other] if nxt[other] == mirror else back[mirror]
                    fixed = r + k < end
                    if not fixed:
                        k = end - r
            if not fixed:
                while r + k < n and w[left + k] == w[r + k]:
                    k += 1
                if r + k > end:
                    lo, hi, end = left, r, r + k
            if r + k == n or w[r + k] < w[left + k]:
                nxt[left], matched[left] = r, k
                waiting.pop()
            else:
                prev[r], back[r] = left, k
                break
        waiting.append(r)
    for left, k in enumerate(matched):
        if k and k >= (periods - 2) * (nxt[left] - left):
            yield left, nxt[left] - left, k


def runs_of(w: list[int], least: int = LEAST_WORDS, periods: float = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least these words and periods (2 or more), by start, then period."""
    found = set()
    for words in (w, [-x for x in w]):
        for i, p, k in roots(words, periods):
            e = 0
            while e < p and i > e and w[i - e - 1] == w[i - e - 1 + p]:
                e += 1
            # A root that repeats the one before it has been looked at there.
            if e < p and e + p + k >= max(least, periods * p):
                found.add((i - e, e + p + k, p))
    return sorted(found, key=lambda run: (run[0], run[2]))


def stretches(w: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Stretches (start, end) of at least least words, each found times times in the text and then in its stretch."""
    label = np.zeros(len(w), np.int64)
    for _ in range(2):
        _, inverse, counts = np.unique(label * (int(w.max(initial=0)) + 1) + w, return_inverse=True, return_counts=True)
        kept = (counts[inverse] >= times) & (label >= 0)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], kept, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= least
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return []
        label = np.full(len(w), -1)
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            label[a:b] = i
    return list(zip(starts.tolist(), ends.tolist()))


def text_runs(words: list, least: int = LEAST_WORDS, periods: float = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """The runs of a list of words."""
    if len(words) < least:
        return []
    numbers: dict = {}
    w = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, len(words))
    found = []
    for a, b in stretches(w, least, math.floor(periods)):
        found += [(a + s, n, p) for s, n, p in runs_of(w[a:b].tolist(), least, periods)]
    return found


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """words without those that a run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return list(compress(words, (np.cumsum(gone[:-1]) == 0).tolist()))


def periodic_runs(docs: DataFrame, *, text_col: str = "text", least: int = LEAST_WORDS, periods: float = LEAST_PERIODS) -> DataFrame:
    """docs with runs (array of start, length, period, in words from 0; by start, then period) and collapsed: the words
    [^\\x20\\x09-\\x0D]+ without repetitions, joined by one space. periods may be 2 or more."""
    if periods < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    own = [c for c in docs.columns if c not in RESULTS]
    names = [f"_in_{i}" for i in range(len(own))]
    given = short_batches(docs).select(*[F.col(c).alias(n) for c, n in zip(own, names)], F.col(text_col).cast("string").alias("_text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([pa.field(n, pa.int64(), False) for n in RUN.names]))
        for batch in batches:
            texts = batch.column(len(own))
            every, kept = [], []
            for text in texts.cast(pa.large_binary()):
                words = (text.as_py() or b"").split()  # of bytes, at \x20 and \x09-\x0D alone
                runs = text_runs(words, least, periods)
                every.append([dict(zip(RUN.names, run)) for run in runs])
                kept.append(b" ".join(collapsed(words, runs)))
            made = [pa.array(every, kind), pa.array(kept, pa.large_binary()).cast(texts.type)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *made], [*names, *RESULTS])

    fields = [T.StructField(n, docs.schema[c].dataType) for c, n in zip(own, names)]
    schema = T.StructType([*fields, T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])
    return given.mapInArrow(tidied(find), schema).select(*[F.col(n).alias(c) for c, n in zip(own, names)], *RESULTS)
