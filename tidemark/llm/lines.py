"""Line deduplication by probing a sharded minimal perfect hash.

A line's key is the line without ASCII white space at its ends, A-Z in lower
case. Keys of at least `min_chars` code points that `min_documents` documents
hold lose all their lines, except in the largest doc_id that holds them.

1. Every document gives its distinct long keys once, as two 64-bit hashes; sums
   by key (partial before the shuffle) give documents and largest doc_id.
2. The keys that occur often enough are dealt into shards by hash. A task turns a
   shard into a minimal perfect hash and arrays in its order: fingerprint, number
   of documents, keeper. Each shard is a file of bounded size.
3. Documents probe the arrays: a task loads the shards that its lines fall in, one
   after another within a bound of memory, so lines are never joined or shuffled.
   A key that isn't in the index meets a foreign fingerprint (64 bits).

Defined cases: a null or empty text is one empty line, which stays; rows with
equal doc_id are documents of their own, and keep a line together if theirs is the
largest id; a null doc_id counts as the smallest; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import ASCII_SPACE, filesystem, slices, unique_name
from tidemark.storage import materialize, scratch_dir

MIN_CHARS = 20
MIN_DOCUMENTS = 3

#: Keys of a shard, on average.
SHARD_KEYS = 1 << 17
#: Bytes of loaded shards that a worker keeps.
KEPT_BYTES = 96 << 20

_SEED = 0x9E3779B97F4A7C15
_NO_ID = np.iinfo(np.int64).min


def line_key(line: bytes) -> bytes:
    return line.strip(ASCII_SPACE).lower()


def long_enough(key: bytes, min_chars: int) -> bool:
    """At least `min_chars` code points; each takes one to four bytes."""
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each key: its place and its fingerprint."""
    if not keys:
        return np.zeros(0, "u8"), np.zeros(0, "u8")
    digests = b"".join(map(xxhash.xxh3_128_digest, keys))
    both = np.frombuffer(digests, "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def mix(values: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """Hashes of hashes, another one for each seed."""
    with np.errstate(over="ignore"):
        x = values ^ (np.asarray(seed, "u8") * np.uint64(_SEED))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps each of n distinct 64-bit hashes to its own number below n (hash and displace).

    Keys fall into buckets of about four. Buckets, largest first, look for the
    smallest seed that sends all their keys to free slots; buckets of one key take
    the slots that remain. `seeds` holds a seed, or minus one minus a slot.
    """

    def __init__(self, seeds: np.ndarray, size: int):
        self.seeds, self.size = seeds, size

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        if len(np.unique(keys)) < n:
            raise ValueError("two keys share a 64-bit hash")
        buckets = max(1, n // 4)
        bucket = (mix(keys, 0) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        sizes = np.diff(starts)
        seeds = np.zeros(buckets, np.int64)
        free = np.ones(n, bool)
        for size in range(int(sizes.max(initial=0)), 1, -1):
            cls._place(keys, order, starts, np.flatnonzero(sizes == size), size, seeds, free)
        alone = np.flatnonzero(sizes == 1)
        seeds[alone] = -1 - np.flatnonzero(free)[: len(alone)]
        return cls(seeds, n)

    @staticmethod
    def _place(keys, order, starts, waiting, size, seeds, free) -> None:
        """Try the seeds 1, 2, ... for all waiting buckets of one size at once."""
        n, seed = np.uint64(len(keys)), 0
        members = keys[order[starts[waiting][:, None] + np.arange(size)]] if len(waiting) else None
        while len(waiting):
            seed += 1
            slots = (mix(members, seed) % n).astype(np.int64)
            ordered = np.sort(slots, axis=1)
            good = free[slots].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            # of buckets that want the same slot now, the first one gets it
            candidates = np.flatnonzero(good)
            _, first, own = np.unique(slots[candidates], return_index=True, return_inverse=True)
            won = (first[own.ravel()].reshape(-1, size) // size == np.arange(len(candidates))[:, None]).all(axis=1)
            placed = candidates[won]
            free[slots[placed].ravel()] = False
            seeds[waiting[placed]] = seed
            left = np.ones(len(waiting), bool)
            left[placed] = False
            waiting, members = waiting[left], members[left]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        seed = self.seeds[(mix(keys, 0) % np.uint64(len(self.seeds))).astype(np.int64)]
        slot = (mix(keys, np.maximum(seed, 0)) % np.uint64(self.size)).astype(np.int64)
        return np.where(seed < 0, -1 - seed, slot)


SHARDS = "shard int, path string, keys long"


def _save(fs, path: str, arrays: list[np.ndarray]) -> None:
    with fs.open_output_stream(path, compression=None) as sink:
        sink.write(np.array([len(a) for a in arrays], "<i8").tobytes())
        for a in arrays:
            sink.write(a.astype(a.dtype.newbyteorder("<")).tobytes())


def _load(fs, path: str) -> list[np.ndarray]:
    """seeds, fingerprints, counts and keepers of a shard."""
    with fs.open_input_file(path) as source:
        data = source.read()
    lengths = np.frombuffer(data, "<i8", 4)
    at, arrays = 32, []
    for length, kind in zip(lengths.tolist(), ("<i8", "<u8", "<i8", "<i8"), strict=True):
        arrays.append(np.frombuffer(data, kind, length, at))
        at += 8 * length
    return arrays


class LineIndex:
    """The written shards: file of each, or None where a shard has no keys."""

    def __init__(self, folder: str, paths: list[str | None]):
        self.folder, self.paths = folder, paths
        self._loaded: OrderedDict = OrderedDict()
        self._bytes = 0
        self._fs = None

    def __getstate__(self):
        return self.folder, self.paths

    def __setstate__(self, state):
        self.__init__(*state)

    def _shard(self, number: int):
        if number not in self._loaded:
            if self._fs is None:
                self._fs, _ = filesystem(self.folder)
            seeds, *arrays = _load(self._fs, self.paths[number])
            self._loaded[number] = PerfectHash(seeds, len(arrays[0])), *arrays
            self._bytes += 8 * (len(seeds) + 3 * len(arrays[0]))
            while self._bytes > KEPT_BYTES and len(self._loaded) > 1:
                _, (old, *rest) = self._loaded.popitem(last=False)
                self._bytes -= 8 * (len(old.seeds) + 3 * len(rest[0]))
        self._loaded.move_to_end(number)
        return self._loaded[number]

    def probe(self, places: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of documents (0: not in the index) and keeper of each key."""
        counts, keepers = np.zeros(len(places), np.int64), np.full(len(places), _NO_ID)
        if not len(places) or not self.paths:
            return counts, keepers
        shard = (places % np.uint64(len(self.paths))).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        numbers, starts = np.unique(shard[order], return_index=True)
        for number, rows in zip(numbers.tolist(), np.split(order, starts[1:]), strict=True):
            if self.paths[number] is not None:
                perfect, fingerprints, n, keeper = self._shard(number)
                slot = perfect(places[rows])
                known = fingerprints[slot] == prints[rows]
                counts[rows[known]] = n[slot[known]]
                keepers[rows[known]] = keeper[slot[known]]
        return counts, keepers


def build_index(documents: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> LineIndex:
    """Index the keys of (doc_id, text) that enough documents hold."""
    spark = documents.sparkSession

    def keys(batches):
        for batch in batches:
            for some in slices(batch):
                found, ids = [], []
                for doc_id, text in zip(some["doc_id"].to_pylist(), some["text"].to_pylist(), strict=True):
                    own = {key for key in map(line_key, (text or "").encode().split(b"\n")) if long_enough(key, min_chars)}
                    found.extend(own)
                    ids.extend([_NO_ID if doc_id is None else doc_id] * len(own))
                places, prints = hashes(found)
                arrays = [pa.array(places.view("i8")), pa.array(prints.view("i8")), pa.array(ids, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["place", "print", "doc_id"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = (
        texts.mapInArrow(keys, "place long, print long, doc_id long")
        .groupBy("place", "print")
        .agg(F.count(F.lit(1)).alias("documents"), F.max("doc_id").alias("keeper"))
        .where(F.col("documents") >= min_documents)
    )
    frequent = materialize(counted, "lines")
    shards = -(-frequent.count() // SHARD_KEYS)
    folder = scratch_dir(spark, "line-index")

    def build(key, group):
        places, prints = group["place"].to_numpy().view("u8"), group["print"].to_numpy().view("u8")
        perfect = PerfectHash.build(places)
        slot = perfect(places)
        arrays = [np.empty(len(slot), kind) for kind in ("u8", "i8", "i8")]
        for array, values in zip(arrays, (prints, group["documents"].to_numpy(), group["keeper"].to_numpy()), strict=True):
            array[slot] = values
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        path = f"{root}/{unique_name(f'shard-{int(key[0]):06d}', '.mph')}"
        _save(fs, path, [perfect.seeds, *arrays])
        return pd.DataFrame({"shard": [int(key[0])], "path": [path], "keys": [len(slot)]})

    if not shards:
        return LineIndex(folder, [])
    # remainder of the unsigned place
    shard = F.pmod(F.pmod(F.shiftrightunsigned("place", 1), F.lit(shards)) * 2 + F.col("place").bitwiseAND(F.lit(1)), F.lit(shards))
    built = frequent.withColumn("shard", shard.cast("int")).groupBy("shard").applyInPandas(build, SHARDS)
    paths: list[str | None] = [None] * shards
    for row in materialize(built, "line-shards").collect():  # a row a shard
        paths[row.shard] = row.path
    return LineIndex(folder, paths)


def _decide(index: LineIndex, batch: pa.RecordBatch, min_chars: int) -> Iterator[tuple[list[bytes], list[bool]]]:
    """The lines of each document of a batch and which of them stay."""
    lines = [(text or "").encode().split(b"\n") for text in batch["text"].to_pylist()]
    doc_ids = [_NO_ID if doc_id is None else doc_id for doc_id in batch["doc_id"].to_pylist()]
    keys, at, own = [], [], []
    for number, document in enumerate(lines):
        for position, line in enumerate(document):
            key = line_key(line)
            if long_enough(key, min_chars):
                keys.append(key)
                at.append((number, position))
                own.append(doc_ids[number])
    counts, keepers = index.probe(*hashes(keys))
    stays = [[True] * len(document) for document in lines]
    for k in np.flatnonzero((counts > 0) & (keepers != np.array(own, np.int64))).tolist():
        number, position = at[k]
        stays[number][position] = False
    return zip(lines, stays, strict=True)


def decisions(documents: DataFrame, index: LineIndex, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (of the lines that stay) and its SHA-256."""
    schema = "doc_id long, n_lines long, n_dropped long, text string, kept_sha256 string"

    def decide(batches):
        for batch in batches:
            for some in slices(batch):
                n, dropped, texts, digests = [], [], [], []
                for lines, stays in _decide(index, some, min_chars):
                    kept = b"\n".join([line for line, stay in zip(lines, stays, strict=True) if stay])
                    n.append(len(lines))
                    dropped.append(stays.count(False))
                    texts.append(kept)
                    digests.append(hashlib.sha256(kept).hexdigest())
                arrays = [some["doc_id"], pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(digests)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_lines", "n_dropped", "text", "kept_sha256"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(decide, schema)


def dedup_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The documents without repeated lines: text (and n_chars, where there is one) changed, all else kept."""
    index = build_index(documents, min_chars, min_documents)
    schema = documents.schema

    def rewrite(batches):
        for batch in batches:
            for some in slices(batch):
                texts = []
                for text, (lines, stays) in zip(some["text"].to_pylist(), _decide(index, some, min_chars), strict=True):
                    kept = b"\n".join([line for line, stay in zip(lines, stays, strict=True) if stay])
                    texts.append(None if text is None else kept.decode())
                columns = list(some.columns)
                names = some.schema.names
                columns[names.index("text")] = pa.array(texts, pa.string())
                if "n_chars" in names:
                    sizes = [None if text is None else len(text) for text in texts]
                    columns[names.index("n_chars")] = pa.array(sizes, some.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return documents.mapInArrow(rewrite, schema)
