"""Best-fit packing: documents into as few token sequences as possible.

Only the histogram of piece lengths (at most `capacity` numbers) reaches the
driver. There a configuration linear program is solved: a configuration is a
multiset of lengths that fits a sequence, the program asks for the fewest
(fractional) sequences that cover every length. Multiplicative weights keep a
price for each length; the pricing step finds the dearest configuration by
dynamic programming over the capacity (an unbounded knapsack). The fractional
plan is rounded down, and what it leaves over (an amount that depends on the
number of configurations, not of documents) is packed best fit, longest first.

The plan says which ranks of a length go to which place. Pieces get their rank
by counts for each task and length, so no task holds all pieces of a length.

Defined cases: a null text is an empty document of one id; rows with a null or
repeated doc_id are packed like others; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import slices
from tidemark.llm.tokens import END, encoder
from tidemark.storage import materialize

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def cut(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of each document; the first is the shorter one. `nth` counts a task's pieces of a length."""

    def pieces(batches):
        task, seen, encode = TaskContext.get().partitionId(), Counter(), encoder(tokenizer)
        for batch in batches:
            for some in slices(batch, 2 << 20):
                rows = []
                for doc_id, ids in zip(some["doc_id"].to_pylist(), encode(some["text"].to_pylist()), strict=True):
                    ids += END
                    total, start, number = len(ids) // 4, 0, 0
                    while start < total:
                        end = start + ((total - start) % capacity or capacity)
                        length = end - start
                        rows.append((doc_id, number, start, length, zlib.crc32(ids[4 * start : 4 * end]), task, seen[length]))
                        seen[length] += 1
                        start, number = end, number + 1
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(pieces, PIECES)


def price(weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of every room and a length taken for it (0: that of the next smaller room), for a price of each length."""
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    lengths = np.flatnonzero(weights > 0)
    values = weights[lengths]
    for room in range(1, capacity + 1):
        n = int(np.searchsorted(lengths, room, "right"))
        if n:
            found = best[room - lengths[:n]] + values[:n]
            k = int(np.argmax(found))
            if found[k] > best[room - 1]:
                best[room], taken[room] = found[k], lengths[k]
                continue
        best[room] = best[room - 1]
    return best, taken


def configuration(taken: np.ndarray, room: int) -> list[int]:
    """The lengths of the dearest filling of a room."""
    found = []
    while room > 0:
        if length := int(taken[room]):
            found.append(length)
            room -= length
        else:
            room -= 1
    return found


def fractional_plan(counts: np.ndarray, capacity: int, rounds: int, share: float = 0.1, rate: float = 0.5) -> dict[tuple, float]:
    """Configurations and how often each is used, by multiplicative weights.

    A length costs its part of the capacity times exp(-rate * share of its demand
    that is met), nothing once all is met. One knapsack table gives the dearest
    configuration around every length; those within a hundredth of the dearest are
    used for `share` of what their scarcest length still needs, then prices change.
    """
    demand = np.maximum(counts.astype(float), 1e-9)
    met = np.where(counts > 0, 0.0, 1.0)
    size = np.arange(len(counts)) / capacity
    plan: dict[tuple, float] = defaultdict(float)
    for _ in range(rounds):
        weights = np.where(met < 0.999, size * np.exp(-rate * met), 0.0)
        if not weights.any():
            break
        best, taken = price(weights, capacity)
        around = np.zeros(len(counts))
        lengths = np.flatnonzero(weights)
        around[lengths] = weights[lengths] + best[capacity - lengths]
        for length in lengths[around[lengths] >= 0.99 * best[capacity]].tolist():
            found = Counter(configuration(taken, capacity - length))
            found[length] += 1
            used = share * min((1 - met[k]) * demand[k] / n for k, n in found.items())
            if used > 0:
                for k, n in found.items():
                    met[k] += n * used / demand[k]
                plan[tuple(sorted(found.items(), reverse=True))] += used
    return plan


def best_fit(counts: Counter, capacity: int) -> Counter:
    """Configurations of best-fit packing, longest first; equal fillings are handled together."""
    open_bins: dict[int, Counter] = defaultdict(Counter)
    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            room = next((r for r in range(length, capacity) if open_bins.get(r)), capacity)
            if room == capacity:
                fits = capacity // length
                full, rest = divmod(todo, fits)
                for n, times in ((fits, full), (rest, 1 if rest else 0)):
                    if times:
                        open_bins[capacity - n * length][((length, n),)] += times
                todo = 0
                continue
            shape, times = next(iter(open_bins[room].items()))
            used = min(times, todo)
            open_bins[room][shape] -= used
            if not open_bins[room][shape]:
                del open_bins[room][shape]
            merged = Counter(dict(shape))
            merged[length] += 1
            open_bins[room - length][tuple(sorted(merged.items(), reverse=True))] += used
            todo -= used
    total: Counter = Counter()
    for shapes in open_bins.values():
        total.update(shapes)
    return total


def plan_sequences(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = 60) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Configurations and how many sequences use each; together they hold every piece exactly once."""
    left = counts.astype(np.int64).copy()
    out: Counter = Counter()
    for length in np.flatnonzero(left):
        if 2 * length > capacity and not left[: capacity - length + 1].any():  # nothing fits beside it
            out[((int(length), 1),)] += int(left[length])
            left[length] = 0
    fractional = fractional_plan(left, capacity, rounds)
    for shape, used in sorted(fractional.items(), key=lambda item: (-item[1], item[0])):
        if sum(length * n for length, n in shape) < 0.9995 * capacity:
            continue  # best fit may do better with what is left
        times = min(int(used + 1e-9), *(int(left[length]) // n for length, n in shape))
        if times > 0:
            out[shape] += times
            for length, n in shape:
                left[length] -= n * times
    out.update(best_fit(Counter({int(k): int(left[k]) for k in np.flatnonzero(left)}), capacity))
    return sorted(out.items())


def places(plan: list[tuple[tuple[tuple[int, int], ...], int]]) -> np.ndarray:
    """Rows (length, first rank, per sequence, first sequence, offset), sorted: where the ranks of a length go."""
    rows, ranks, sequence = [], Counter(), 0
    for shape, times in plan:
        offset = 0
        for length, n in shape:
            rows.append((length, ranks[length], n, sequence, offset))
            ranks[length] += n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    pieces = materialize(cut(documents, tokenizer, capacity), "pieces")
    by_task = materialize(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row.length] = row.n
    where = places(plan_sequences(counts, capacity))
    keys = where[:, 0] * (1 << 44) + where[:, 1]
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def put(batches):
        for batch in batches:
            if batch.num_rows:
                length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
                row = where[np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1]
                copy, slot = np.divmod(rank - row[:, 1], row[:, 2])
                kept = [batch[name] for name in ("doc_id", "piece", "start", "length", "ids_crc32")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(row[:, 3] + copy), pa.array(row[:, 4] + slot * length)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
                )

    ranked = pieces.join(bases, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")
    )
    return ranked.mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
