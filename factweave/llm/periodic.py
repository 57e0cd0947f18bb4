"""Periodic run detection after Kolpakov and Kucherov, over the words of each document.

A run is a stretch of words with smallest period q, at least LEAST words and TIMES * q long, that no neighbouring word extends.

1. Narrowing. Inside such a run every window of LEAST - 2 * LEAST / TIMES + 1 words stands again one period on or one period back. So stretches
   of windows that stand more than once in their document hold all its runs whole, and only they go on. (A document
   without any has no runs; nothing that is left out could be part of one.)
2. LZ factorisation from a suffix automaton: each factor is a new word, or the longest that began before, overlaps allowed; the
   earliest end of an automaton's state tells where.
3. Main's algorithm: runs that cross or touch the border of two factors and end in the second one (or with the first, if they began inside it)
   reach back less than one period behind the first one's start, or that factor would have been longer. So for each
   border four arrays of common extensions (Z functions over both factors and their neighbourhood) give all runs there, in linear time.
4. All other runs lie strictly inside a factor and are copied from its earlier occurrence, by start.

Defined results: a null text has no words; words are told apart byte by byte; rows that repeat are rows of the result as often; ties of
the greatest length / period go to the smallest start, then period; an empty table gives an empty result; other columns are ignored.
Memory follows the longest text (some hundred bytes for each word of a repetitive stretch); the automaton is lists of numbers, which leave no holes behind.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm import tokens

LEAST, TIMES = 24, 3
#: (start, end, period), the end exclusive.
Run = tuple[int, int, int]


class Automaton:
    """The suffix automaton of a sequence of numbers (0 and more); state 0 is the empty word.

    Nearly all states have one transition: its letter and aim stand in two lists. Only states with several have a table of them all.
    """

    def __init__(self, w: Sequence[int]):
        self.letter, self.aim, self.more = [-1], [0], {}
        #: Where the earliest occurrence of a state's words ends.
        self.early = [-1]
        link, size, last = [-1], [0], 0
        for i, letter in enumerate(w):
            new = self._add(-1, 0, i)
            link.append(0)
            size.append(size[last] + 1)
            at, last = last, new
            while at >= 0 and self.step(at, letter) < 0:
                self._put(at, letter, new)
                at = link[at]
            if at < 0:
                continue
            to = self.step(at, letter)
            if size[to] == size[at] + 1:
                link[new] = to
                continue
            twin = self._add(self.letter[to], self.aim[to], self.early[to])
            if to in self.more:
                self.more[twin] = self.more[to].copy()
            link.append(link[to])
            size.append(size[at] + 1)
            link[to] = link[new] = twin
            while at >= 0 and self.step(at, letter) == to:
                self._put(at, letter, twin)
                at = link[at]

    def _add(self, letter: int, aim: int, early: int) -> int:
        self.letter.append(letter)
        self.aim.append(aim)
        self.early.append(early)
        return len(self.letter) - 1

    def _put(self, state: int, letter: int, aim: int) -> None:
        if state in self.more:
            self.more[state][letter] = aim
        elif self.letter[state] in (-1, letter):
            self.letter[state], self.aim[state] = letter, aim
        else:
            self.more[state] = {self.letter[state]: self.aim[state], letter: aim}
            self.letter[state] = -2

    def step(self, state: int, letter: int) -> int:
        """The state that a letter leads to; -1 for none."""
        own = self.letter[state]
        if own == letter:
            return self.aim[state]
        return self.more[state].get(letter, -1) if own == -2 else -1


def factors(w: Sequence[int]) -> Iterator[tuple[int, int, int]]:
    """(start, end, start of an earlier occurrence or -1) of the LZ factors of w."""
    found = Automaton(w)
    start, n = 0, len(w)
    while start < n:
        state, end, source = 0, start, -1
        while end < n:
            to = found.step(state, w[end])
            if found.early[to] >= end:  # its earliest occurrence is this one
                break
            state, source, end = to, found.early[to] - (end - start), end + 1
        end = max(end, start + 1)
        yield start, end, source
        start = end


def common_prefixes(s: Sequence[int]) -> list[int]:
    """For each place of s the length of the longest prefix of s that begins there (the Z function)."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    a = b = 0
    for i in range(1, n):
        k = min(b - i, z[i - a]) if i < b else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > b:
            a, b = i, i + k
    return z


def at_border(w: Sequence[int], before: int, border: int, end: int, least: int, times: int) -> dict[tuple[int, int], int]:
    """Periods by (start, end) of the runs at the border of the factors w[before:border] and w[border:end]."""
    span = end - before
    most = (span - 1) // (times - 1)  # a run reaches back less than a period behind `before`
    if most < 1 or span - 1 < least - least // times:
        return {}
    low, high = max(0, before - most), min(len(w), end + 1)  # one word more tells whether a run ends with the factor
    left, right = list(w[low:border][::-1]), list(w[border:high])
    ahead, back = min(most, len(right)), min(most, len(left))
    right_right, left_left = common_prefixes(right), common_prefixes(left)
    left_right = common_prefixes([*left, -1, *w[low : border + ahead][::-1]])
    right_left = common_prefixes([*right, -1, *w[border - back : high]])
    found: dict[tuple[int, int], int] = {}

    def add(start: int, stop: int, period: int) -> None:
        if stop <= end and stop - start >= max(least, times * period) and (stop > border or start > before):
            found[start, stop] = min(period, found.get((start, stop), period))

    for p in range(1, ahead + 1):  # w[border : border + p] lies in the run
        reach = right_right[p] if p < len(right) else 0
        add(border - left_right[len(left) + 1 + ahead - p], border + p + reach, p)
    for p in range(1, back + 1):  # w[border - p : border] does
        behind = left_left[p] if p < len(left) else 0
        add(border - p - behind, border + right_left[len(right) + 1 + back - p], p)
    return found


def runs_of_stretch(w: Sequence[int], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs of w (numbers from 0 on), by start, then period."""
    by_start: dict[int, list[tuple[int, int]]] = {}
    before = border = 0
    for start, end, source in (*factors(w), (len(w), len(w), -1)):
        for (a, b), p in at_border(w, before, border, end, least, times).items():
            by_start.setdefault(a, []).append((b, p))
        if source >= 0 and by_start:
            for at in range(source + 1, source + end - start - least):
                for b, p in by_start.get(at, ()):
                    if b < source + end - start:
                        by_start.setdefault(at + start - source, []).append((b + start - source, p))
        before, border = start, end
    return sorted({(a, b, p) for a, ends in by_start.items() for b, p in ends}, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of windows that stand more than once; equal hashes may only add to them."""
    width = least - 2 * least // times + 1
    if len(ids) < least:
        return []
    x = tokens.mix(ids.astype(np.uint64))
    rolled = np.zeros(len(ids) - width + 1, np.uint64)
    for i in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + x[i : len(x) - width + 1 + i]
    by = np.argsort(rolled, kind="stable")
    same = rolled[by[1:]] == rolled[by[:-1]]
    if not same.any():
        return []
    change = np.zeros(len(ids) + 1, np.int64)
    again = np.union1d(by[1:][same], by[:-1][same])
    np.add.at(change, again, 1)
    np.add.at(change, again + width, -1)
    covered = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= least]


def runs(words: Sequence[Hashable], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs of a sequence of words, by start, then period. times is 3 at least."""
    number: dict[Hashable, int] = {}
    ids = np.array([number.setdefault(word, len(number)) for word in words], np.int64)
    found = []
    for a, b in stretches(ids, least, times):
        # Inside a stretch all runs that are long enough are whole; only a run's neighbours outside are unknown, and those differ.
        found += [(a + s, a + e, p) for s, e, p in runs_of_stretch(ids[a:b].tolist(), least, times)]
    return found


def collapsed(words: Sequence[bytes], found: list[Run]) -> bytes:
    """The words, joined by blanks, without those that a run holds after its first period."""
    keep = np.ones(len(words), bool)
    for start, end, period in found:
        keep[start + period : end] = False
    return b" ".join(word for word, kept in zip(words, keep, strict=True) if kept) if found else b" ".join(words)


def detect(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES, edit: Callable[[list[bytes], object], list[bytes]] | None = None) -> DataFrame:
    """(id, runs, collapsed) for every row: the runs as structs of start, length, period in that order, and the text without their repeats.

    edit changes the words of a text, given its id too, before they are looked at.
    """
    assert times >= 3
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                all_runs, texts = [], []
                for own, value in zip(part.column(0), part.column(1), strict=True):
                    words = (value.as_py() or "").encode().split()  # bytes part at ASCII white space alone
                    words = edit(words, own.as_py()) if edit else words
                    found = runs(words, least, times)
                    all_runs.append([{"start": a, "length": b - a, "period": p} for a, b, p in found])
                    texts.append(collapsed(words, found).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(all_runs, run_type), pa.array(texts, pa.string())], ["id", "runs", "collapsed"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(found: Column) -> Column:
    """The run of the greatest exact length / period; ties go to the smallest start, then period. Null without runs."""

    def better(best: Column, x: Column) -> Column:
        # length / period as a product across, so that no quotient is rounded
        more, less = x["length"] * best["period"], best["length"] * x["period"]
        earlier = (x["start"] < best["start"]) | ((x["start"] == best["start"]) & (x["period"] < best["period"]))
        return F.when(best.isNull() | (more > less) | ((more == less) & earlier), x).otherwise(best)

    return F.aggregate(found, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
