"""Exact top-k search by tiled matrix products.

Query vectors are packed into blocks, candidates into shards, both as matrices. A
grid of cells meets each block with each column of shards; a task multiplies its
block with one shard after another, takes each tile's best by partial selection and
merges them into the cell's list for every query. Lists of a query are then merged
as a tree, some columns at a time, so no task holds all lists.

Components are whole numbers, floor(scale * x) with x as double; scores are whole
inner products. They are computed in doubles where those are exact (below 2 ** 53),
else in 64-bit integers; a score that would not fit those is an error.

Defined cases: vectors that are null, empty or hold a null or non-finite component,
and rows without an id, take no part; vectors of another length than the query's
are no candidates for it; rows with the query's own id are never its candidates;
other repeated rows each take a rank; of query rows with one id the smallest vector
counts; equal scores go to the smaller id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import unique_name
from tidemark.storage import materialize

#: Rows of a block and of a shard at most; rows of a tile.
BLOCK, SHARD, TILE = 4096, 4096, 512
#: Cells for each query block, at least; candidates of a cell, about.
COLUMNS, COLUMN_ROWS = 48, 1 << 16
#: Lists that one step of the merging tree brings together.
FAN_IN = 16


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector has components and all of them are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def _packed(rows: DataFrame, limit: int) -> DataFrame:
    """uid, dim, ids and numbers (int64, row by row) of at most `limit` rows of one partition and length, by ascending id."""

    def pack(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for vec_id, vector in zip(batch["vec_id"].to_pylist(), batch["numbers"].to_numpy(zero_copy_only=False), strict=True):
                bucket = held.setdefault(len(vector), [])
                bucket.append((vec_id, np.asarray(vector, np.int64)))
                if len(bucket) == limit:
                    yield arrow(held.pop(len(vector)))
        for bucket in held.values():
            yield arrow(bucket)

    def arrow(bucket) -> pa.RecordBatch:
        bucket.sort(key=lambda row: row[0])
        ids = np.array([row[0] for row in bucket], np.int64).tobytes()
        numbers = np.stack([row[1] for row in bucket]).tobytes()
        columns = [[unique_name("", "")], [len(bucket[0][1])], [ids], [numbers]]
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int32()), *map(pa.array, columns[2:])], ["uid", "dim", "ids", "numbers"])

    return rows.mapInArrow(pack, "uid string, dim int, ids binary, numbers binary")


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Whole inner products, by doubles where they are exact."""
    largest = [int(np.abs(m.astype(object)).max()) if m.size and m.min() == np.iinfo(np.int64).min else int(np.abs(m).max(initial=0)) for m in (queries, candidates)]
    bound = largest[0] * largest[1] * queries.shape[1]
    if bound < 1 << 53:
        return (queries.astype(float) @ candidates.astype(float).T).astype(np.int64)
    if bound < 1 << 63:
        return queries @ candidates.T
    raise OverflowError("inner products may exceed 64 bits")


def best(scores: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best of each row; columns come by ascending id."""
    lowest = np.iinfo(np.int64).min
    own = query_ids[:, None] == ids[None, :]
    scores = np.where(own, lowest, scores)
    n = scores.shape[1]
    if n > k:
        cut = np.partition(scores, n - k, axis=1)[:, n - k]
        row, column = np.nonzero((scores >= cut[:, None]) & ~own)
    else:
        row, column = np.nonzero(~own)
    return _first(row, ids[column], scores[row, column], k)


def _first(row: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k entries of each row by score, largest first, and id."""
    order = np.lexsort((vec_id, -score, row))
    row, vec_id, score = row[order], vec_id[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
    return row[rank < k], vec_id[rank < k], score[rank < k]


def _cell_lists(k: int):
    def multiply(key, blocks: pd.DataFrame, shards: pd.DataFrame) -> Iterator[pd.DataFrame]:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "list": []}).astype("int64")]
        for ids, numbers, dim in zip(blocks["ids"], blocks["numbers"], blocks["dim"], strict=True):
            query_ids = np.frombuffer(ids, np.int64)
            queries = np.frombuffer(numbers, np.int64).reshape(-1, dim)
            kept = tuple(np.zeros(0, np.int64) for _ in range(3))
            for c_ids, c_numbers, c_dim in zip(shards["ids"], shards["numbers"], shards["dim"], strict=True):
                if c_dim != dim:
                    continue
                vec_ids, candidates = np.frombuffer(c_ids, np.int64), np.frombuffer(c_numbers, np.int64).reshape(-1, dim)
                tiles = [kept]
                for at in range(0, len(queries), TILE):
                    row, vec_id, score = best(products(queries[at : at + TILE], candidates), query_ids[at : at + TILE], vec_ids, k)
                    tiles.append((row + at, vec_id, score))
                kept = _first(*(np.concatenate(x) for x in zip(*tiles, strict=True)), k)
            out.append(pd.DataFrame({"query_id": query_ids[kept[0]], "vec_id": kept[1], "score": kept[2], "list": int(key[1])}))
        return pd.concat(out)

    return multiply


def _merged(lists: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of (vec_id, embedding) for the rows that `queries` picks by vec_id."""
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"))
    known = known.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    known = known.select("vec_id", whole_numbers(F.col("embedding"), scale).alias("numbers"))
    asked = materialize(known.where(queries).groupBy("vec_id").agg(F.min("numbers").alias("numbers")), "queries")

    n_queries = asked.count()
    blocks = max(1, -(-n_queries // BLOCK))
    columns = max(-(-COLUMNS // blocks), -(-vectors.count() // COLUMN_ROWS))
    grid = F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))
    block_rows = _packed(asked.repartition(blocks, "vec_id"), BLOCK).withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    block_rows = materialize(block_rows, "query-blocks").withColumn("column", grid)
    shards = _packed(known, min(SHARD, max(64, COLUMN_ROWS // COLUMNS))).withColumn("column", F.pmod(F.xxhash64("uid"), F.lit(columns)))
    shards = materialize(shards, "shards").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    keys = ["block", "column"]
    block_rows = block_rows.select(*(F.col(c).cast("int").alias(c) for c in keys), "ids", "numbers", "dim")
    shards = shards.select(*(F.col(c).cast("int").alias(c) for c in keys), "ids", "numbers", "dim")
    lists = block_rows.groupBy(*keys).cogroup(shards.groupBy(*keys)).applyInPandas(_cell_lists(k), "query_id long, vec_id long, score long, list long")
    while columns > FAN_IN:
        columns = -(-columns // FAN_IN)
        lists = _merged(lists.withColumn("list", F.floor(F.col("list") / FAN_IN)), k, "list").drop("rank")
    return _merged(lists, k).select("query_id", "rank", "vec_id", "score")
