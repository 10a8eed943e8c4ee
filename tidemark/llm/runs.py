"""Periodic runs of words: stretches that repeat themselves.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical), of at least max(`shortest`, 2 * q) words, that no neighbouring word
extends. A word is repetition if a run holds it behind that run's first q words.

1. Recursive frequency splitting. A word of a run stands in it twice at least, so a
   word that stands once in its segment (at first a document) is in no run there: it
   splits the segment. The parts are counted anew, until no segment changes; those of
   fewer than `shortest` words are gone. Running text falls apart in a few rounds. All
   documents of a batch are split together.
2. Lag scan. In what survives, words are compared with those q places on. Of every
   stretch of q places one is a multiple of q, and a run holds a stretch of q equal
   places, so long lags are tried at n / q places only (n log n for all of them), as
   windows of `GRAM` words, and extended where they agree. Lags are tried from short
   to long: a stretch that is known by a shorter period is not a run of the longer
   one, and places inside a run whose period divides the lag need no look.

Splitting only leaves out what cannot be in a run, so it may stop after any round
(`ROUNDS`, for texts made to split one word at a time) with the same result.

Defined cases: a null or empty text has no words, no runs and an empty rest; a null
doc_id is an id like others; rows that repeat a doc_id are judged each by its own
text; an empty table gives no rows; other columns are ignored; a text of any length
is scanned whole, in its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import slices

SHORTEST = 12
#: Words of a window that long lags compare, and the lag from which they do.
GRAM = 8
LONG = 4 * GRAM
#: Rounds of splitting; what is left then is scanned as it is.
ROUNDS = 64

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def split_segments(words: np.ndarray, segments: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """(start, end) of the segments that survive the splitting.

    `words` are numbers, `segments` the first segment of each (ascending).
    """
    place = np.arange(len(words))
    changed, done = place, []
    for _ in range(ROUNDS):
        if not len(changed):
            break
        # words that occur once in their segment
        order = np.lexsort((words[changed], segments[changed]))
        w, s = words[changed][order], segments[changed][order]
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = (w[1:] == w[:-1]) & (s[1:] == s[:-1])
        alone = np.zeros(len(order), bool)
        alone[order] = ~(same[1:] | same[:-1])
        left = changed[~alone]
        # the parts: neighbours that are left, of one segment
        new = np.ones(len(left) + 1, bool)
        new[1:-1] = (np.diff(left) != 1) | (segments[left[1:]] != segments[left[:-1]])
        starts = np.flatnonzero(new)
        lengths = np.diff(starts)
        part = np.repeat(np.arange(len(lengths)), lengths)
        # a part that is its whole segment stays as it is
        old = np.bincount(np.searchsorted(np.unique(segments[changed]), segments[changed]))
        whole = old[np.searchsorted(np.unique(segments[changed]), segments[left[starts[:-1]]])] == lengths if len(left) else np.zeros(0, bool)
        long_enough = lengths >= shortest
        done += [(int(left[at]), int(left[at]) + int(n)) for at, n in zip(starts[:-1][whole & long_enough], lengths[whole & long_enough], strict=True)]
        going = (long_enough & ~whole)[part]
        segments = segments.copy()
        segments[left] = part
        changed = left[going]
    if len(changed):
        cut = np.flatnonzero((np.diff(changed) != 1) | (segments[changed[1:]] != segments[changed[:-1]])) + 1
        done += [(int(piece[0]), int(piece[-1]) + 1) for piece in np.split(changed, cut)]
    return sorted(done)


class _Scan:
    """The runs of one array of words, found from short to long periods."""

    def __init__(self, words: np.ndarray, shortest: int):
        self.words, self.shortest = words, shortest
        self.found: dict[tuple[int, int], int] = {}
        # for every place, the run over it that ends last, and its period
        self.over_end = np.zeros(len(words), np.int64)
        self.over_period = np.ones(len(words), np.int64)

    def keep(self, start: int, end: int, period: int) -> None:
        """A stretch of words with this period that cannot be extended."""
        if end - start >= max(self.shortest, 2 * period) and (start, end) not in self.found:
            self.found[start, end] = period
            view = self.over_end[start:end]
            later = view < end
            view[later] = end
            self.over_period[start:end][later] = period

    def short(self, period: int) -> None:
        equal = np.zeros(len(self.words) - period + 2, np.int8)
        equal[1:-1] = self.words[period:] == self.words[:-period]
        edges = np.diff(equal)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + period
        for at in np.flatnonzero(ends - starts >= max(self.shortest, 2 * period)).tolist():
            self.keep(int(starts[at]), int(ends[at]), period)

    def long(self, period: int, grams: np.ndarray, first: int, last: int) -> None:
        """Stretches within the words from `first` to `last`, found at windows `period - GRAM + 1` apart."""
        at = np.arange(first, last - period - GRAM + 1, period - GRAM + 1)
        at = at[grams[at] == grams[at + period]]
        if len(at):
            inside = (self.over_end[at] >= at + period + GRAM) & (period % self.over_period[at] == 0)
            end = -1
            for place in at[~inside].tolist():
                if place >= end:
                    start, end = self._extended(place, period, first, last)
                    self.keep(start, end + period, period)

    def _extended(self, place: int, period: int, first: int, last: int) -> tuple[int, int]:
        """The stretch of places equal to those `period` on, around one of them."""
        words, step = self.words, 64
        end = place
        while end < last - period:
            stop = min(end + step, last - period)
            differ = np.flatnonzero(words[end:stop] != words[end + period : stop + period])
            if len(differ):
                end += int(differ[0])
                break
            end, step = stop, step * 2
        start, step = place, 64
        while start > first:
            stop = max(start - step, first)
            differ = np.flatnonzero(words[stop:start] != words[stop + period : start + period])
            if len(differ):
                start = stop + int(differ[-1]) + 1
                break
            start, step = stop, step * 2
        return start, end


def _grams(words: np.ndarray) -> np.ndarray:
    """Numbers of the windows of GRAM words at every place; equal windows have equal ones."""
    numbers, size = words, 1
    while size < GRAM:
        both = np.stack([numbers[: len(numbers) - size], numbers[size:]], axis=1)
        _, numbers = np.unique(both, axis=0, return_inverse=True)
        numbers = numbers.ravel()
        size *= 2
    return numbers


def scan(words: np.ndarray, segments: list[tuple[int, int]], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs in the segments of `words`, by start and period."""
    if not segments:
        return []
    # the segments one after the other, parted by numbers that occur once
    lengths = np.array([end - start for start, end in segments])
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    held = np.empty(offsets[-1], np.int64)
    for number, ((start, end), at) in enumerate(zip(segments, offsets.tolist())):
        held[at : at + end - start] = words[start:end]
        held[at + end - start] = -1 - number
    work = _Scan(held, shortest)
    longest = int(lengths.max()) // 2
    for period in range(1, min(LONG - 1, longest) + 1):
        work.short(period)
    if longest >= LONG:
        grams = _grams(held)
        for number in np.flatnonzero(lengths >= 2 * LONG).tolist():
            first, last = int(offsets[number]), int(offsets[number] + lengths[number])
            for period in range(LONG, (last - first) // 2 + 1):
                work.long(period, grams, first, last)
    shift = np.array([start for start, _ in segments]) - offsets[:-1]
    runs = []
    for (start, end), period in work.found.items():
        by = int(shift[np.searchsorted(offsets, start, "right") - 1])
        runs.append((start + by, end + by, period))
    return sorted(runs, key=lambda run: (run[0], run[2]))


def runs_of(texts: list[bytes], shortest: int = SHORTEST) -> Iterator[tuple[list[tuple[int, int, int]], list[bytes]]]:
    """(start, length, period) of the runs of each text, and the words that are no repetition."""
    numbers: dict[bytes, int] = {}
    split = [text.split() for text in texts]
    ends = np.cumsum([len(words) for words in split]) if split else np.zeros(0, np.int64)
    words = np.fromiter((numbers.setdefault(word, len(numbers)) for part in split for word in part), np.int64, int(ends[-1]) if len(ends) else 0)
    documents = np.repeat(np.arange(len(split)), [len(part) for part in split])
    found: list[list] = [[] for _ in split]
    segments = split_segments(words, documents, shortest)
    first = 0
    while first < len(segments):
        # documents of some million words at a time
        last, held = first, 0
        while last < len(segments) and held < 1 << 21:
            held += segments[last][1] - segments[last][0]
            last += 1
        for start, end, period in scan(words, segments[first:last], shortest):
            found[int(documents[start])].append((start, end, period))
        first = last
    for number, (part, runs) in enumerate(zip(split, found)):
        base = int(ends[number]) - len(part)
        if runs:
            repeated = np.zeros(len(part) + 1, np.int64)
            for start, end, period in runs:
                repeated[start - base + period] += 1
                repeated[end - base] -= 1
            kept = np.cumsum(repeated[:-1]) == 0
            part = [word for word, keep in zip(part, kept.tolist()) if keep]
        yield [(start - base, end - start, period) for start, end, period in runs], part


def periodic_runs(documents: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, runs (by start and period) and `collapsed`: the words that are no repetition, joined by blanks."""

    def find(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for some in slices(batch):
                texts = [(text or "").encode() for text in some["text"].to_pylist()]
                runs, collapsed = [], []
                for found, words in runs_of(texts, shortest):
                    runs.append([dict(zip(("start", "length", "period"), run, strict=True)) for run in found])
                    collapsed.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([some["doc_id"], pa.array(runs, kind), pa.array(collapsed, pa.string())], ["doc_id", "runs", "collapsed"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(find, f"doc_id long, runs {RUNS}, collapsed string")


def longest_run(runs: Column) -> Column:
    """The run with the greatest length; of equal ones the first, then that of the shortest period."""
    order = lambda run: F.struct(run["length"].alias("length"), (-run["start"]).alias("start"), (-run["period"]).alias("period"))
    best = F.array_max(F.transform(runs, order))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def spelled(runs: Column) -> Column:
    """A line `start,length,period` for each run."""
    line = lambda run: F.concat_ws(",", run["start"].cast("string"), run["length"].cast("string"), run["period"].cast("string"))
    return F.concat(F.array_join(F.transform(runs, line), "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))


def with_planted_repetition(documents: DataFrame) -> DataFrame:
    """Every tenth document (by a hash of its id) repeating itself from some word on.

    With h the crc32 of the id and g = h // 10: from word a = g % n on, the words are
    those of the p = 1 + (n - a) // (3 + g % 8) words from there, over and over.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def planted(held: Column) -> Column:
        n, g = F.size(held).cast("long"), F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        at = F.sequence(F.lit(0).cast("long"), n - 1)
        picked = F.transform(at, lambda i: F.get(held, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(picked, " "))

    text = F.when(h % 10 == 0, F.coalesce(F.transform(F.array(words), planted)[0], F.col("text"))).otherwise(F.col("text"))
    return documents.select("doc_id", text.alias("text"))
