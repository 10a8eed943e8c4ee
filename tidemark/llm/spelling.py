"""Spelling variants: words one edit apart, grouped under the common form.

Two words are near if they differ by exactly one inserted, deleted or replaced code
point. The form of a word is its commonest near word (ties: the smallest in
code-point order) if that is at least `times` as common; following forms leads to
the root.

1. Words (maximal runs of Latin letters) are counted by Spark, summed within the
   task first. The vocabulary holds words of at least `min_chars` code points met
   `min_count` times.
2. Blocked Bloom filters of the vocabulary, sharded by length and, where a length has
   many words, by hash: a shard holds at most about `SHARD_WORDS` words (2 bytes each)
   and is a file in the shared folder. Nothing that grows with the corpus is broadcast
   in one piece: a task reads the shards that it asks for and keeps `KEPT_BYTES` of them.
3. Every vocabulary word generates its edits, as hashes only. A word's hash is the sum
   of random numbers for (place, letter), so the hash of an edit is that of the word
   with a few terms exchanged. Deletions, and replacements by later letters, are
   enough: the other side of a pair makes the rest. They probe the filters of their
   length; those that pass are spelled out.
4. Only these shuffle to the vocabulary, and an exact join removes the false ones.
   Both ends of a pair get the other; the best one is a maximum by partial aggregation.
5. Roots by pointer doubling: counts grow `times`-fold along a chain, so chains have
   fewer links than counts have digits, and few rounds are needed.

Letters are code points up to U+00FF, so a word is as long as its Latin-1 bytes.

Defined cases: null or empty texts have no words; a null doc_id takes part (its
words never lose a letter in `with_slips`); repeated rows count as often as they are
there; an empty table or vocabulary gives no rows; other columns are ignored; words
of any length are grouped, in slices of bounded memory.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import filesystem, parallelism, slices, unique_name
from tidemark.storage import materialize, scratch_dir

MIN_CHARS = 7
MIN_COUNT = 2
TIMES = 10

#: Words of a filter shard, on average; each takes 16 bits.
SHARD_WORDS = 1 << 16
#: Lengths from here on share their shards.
LONGEST_CLASS = 40
#: Bytes of loaded shards that a worker keeps.
KEPT_BYTES = 96 << 20
#: Different words a task counts before it hands them on.
COUNTED_WORDS = 300_000
#: Edits probed at once.
EDITS = 1 << 20

_LETTERS = "A-Za-zÀ-ÿ"
#: The letters of words after lower-casing A-Z, as Latin-1 bytes.
ALPHABET = np.array([c for c in range(0x100) if 0x61 <= c <= 0x7A or c >= 0xC0], np.uint8)


# Counting --------------------------------------------------------------------

#: (doc_id, word) -> the word as counted; both are bytes, the id is None for null.
Variant = Callable[[bytes | None, bytes], bytes]


def with_slips(doc_id: bytes | None, word: bytes) -> bytes:
    """The word without one letter, for every 31st (document, word) by a hash.

    With h the crc32 of `<doc_id>:<word>`: if 31 divides h, letter h % length goes.
    """
    if doc_id is None:
        return word
    h = zlib.crc32(word, zlib.crc32(doc_id + b":"))
    if h % 31:
        return word
    letters = word.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def count_words(documents: DataFrame, min_chars: int = MIN_CHARS, variant: Variant | None = None) -> DataFrame:
    """word, n: the words of all texts of at least `min_chars` letters."""
    pattern = re.compile(f"[{_LETTERS}]{{{min_chars},}}")

    def rows(counts: Counter) -> pa.RecordBatch:
        words = [word for word in counts if len(word) >= min_chars and (word.isascii() or len(word.decode()) >= min_chars)]
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([counts[w] for w in words], pa.int64())], ["word", "n"])

    def count(batches):
        counts: Counter = Counter()
        for batch in batches:
            for some in slices(batch):
                for doc_id, text in zip(some["doc_id"].to_pylist(), some["text"].to_pylist(), strict=True):
                    if not text:
                        continue
                    key = None if doc_id is None else str(doc_id).encode()
                    for word, n in Counter(pattern.findall(text)).items():
                        # of bytes only A-Z are lower-cased; Arrow's ascii_lower shifts a cast slice
                        word = word.encode().lower()
                        counts[variant(key, word) if variant else word] += n
                if len(counts) > COUNTED_WORDS:
                    yield rows(counts)
                    counts.clear()
        yield rows(counts)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# Hashes of words and of their edits -------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def terms(places: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """A random 64-bit number for each (place, letter)."""
    key = (places.astype(np.uint64) << np.uint64(8)) | letters.astype(np.uint64)
    return _mix((key + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of words of one length, given as rows of letters."""
    return terms(np.arange(words.shape[1])[None, :], words).sum(axis=1, dtype=np.uint64)


def _as_rows(words: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(-1, length)


def edits(words: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Edits of words of one length: kind, rows, places, letters, hashes.

    Deletions take the first letter of a run of equal ones, so each result comes
    once; replacements go to later letters only.
    """
    n, length = words.shape
    places = np.arange(length)
    own = terms(places[None, :], words)
    whole = own.sum(axis=1, dtype=np.uint64)
    moved = terms(places[None, :] - 1, words) if length > 1 else own
    for at in range(length):
        rows = np.flatnonzero(words[:, at] != words[:, at - 1]) if at else np.arange(n)
        if at == 0:
            before, behind = np.zeros(n, np.uint64), moved[:, 1:].sum(axis=1, dtype=np.uint64)
        else:
            before, behind = before + own[:, at - 1], behind - moved[:, at]
        yield "delete", rows, np.full(len(rows), at), np.zeros(len(rows), np.uint8), (before + behind)[rows]
        first = np.searchsorted(ALPHABET, words[:, at], "right")
        counts = len(ALPHABET) - first
        rows = np.repeat(np.arange(n), counts)
        starts = np.cumsum(counts) - counts
        letters = ALPHABET[np.arange(len(rows)) - np.repeat(starts, counts) + np.repeat(first, counts)]
        values = terms(np.full(len(ALPHABET), at), ALPHABET)
        new = values[np.searchsorted(ALPHABET, letters)]
        yield "replace", rows, np.full(len(rows), at), letters, whole[rows] - own[rows, at] + new


def spelled(kind: str, word: bytes, at: int, letter: int) -> bytes:
    return word[:at] + (bytes([letter]) if kind == "replace" else b"") + word[at + 1 :]


# Bloom filters -----------------------------------------------------------------

def _bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block (a 64-bit word) of each hash, and its five bits there."""
    second = _mix(hashes ^ np.uint64(0xD6E8FEB86659FD93))
    mask = np.zeros(len(hashes), np.uint64)
    for k in range(5):
        mask |= np.uint64(1) << ((second >> np.uint64(6 * k)) & np.uint64(63))
    return (_mix(hashes) % np.uint64(blocks)).astype(np.int64), mask


def build_filter(hashes: np.ndarray) -> np.ndarray:
    """A blocked Bloom filter, 16 bits a word."""
    held = np.zeros(max(1, -(-len(hashes) // 4)), np.uint64)
    block, mask = _bits(hashes, len(held))
    np.bitwise_or.at(held, block, mask)
    return held


def passes(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    block, mask = _bits(hashes, len(held))
    return (held[block] & mask) == mask


def shard_class(length):
    return np.minimum(length, LONGEST_CLASS)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


class Filters:
    """The written shards: for each length class its files, by part (None: no words)."""

    def __init__(self, folder: str, paths: dict[int, list[str | None]]):
        self.folder, self.paths = folder, paths
        self._loaded: OrderedDict = OrderedDict()
        self._bytes = 0
        self._fs = None
        self.loads = 0

    def __getstate__(self):
        return self.folder, self.paths

    def __setstate__(self, state):
        self.__init__(*state)

    def _shard(self, path: str) -> np.ndarray:
        if path not in self._loaded:
            if self._fs is None:
                self._fs, _ = filesystem(self.folder)
            with self._fs.open_input_file(path) as source:
                self._loaded[path] = np.frombuffer(source.read(), "<u8")
            self.loads += 1
            self._bytes += self._loaded[path].nbytes
            while self._bytes > KEPT_BYTES and len(self._loaded) > 1:
                self._bytes -= self._loaded.popitem(last=False)[1].nbytes
        self._loaded.move_to_end(path)
        return self._loaded[path]

    def holds(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Whether words of this length may have these hashes."""
        paths = self.paths.get(int(shard_class(length)))
        found = np.zeros(len(hashes), bool)
        if not paths:
            return found
        if len(paths) == 1:
            return passes(self._shard(paths[0]), hashes) if paths[0] else found
        part = _part(hashes, len(paths))
        for number, path in enumerate(paths):
            rows = np.flatnonzero(part == number)
            if path and len(rows):
                found[rows] = passes(self._shard(path), hashes[rows])
        return found


def build_filters(vocabulary: DataFrame, shard_words: int = SHARD_WORDS) -> Filters:
    """Filter files of a vocabulary (column word)."""
    spark = vocabulary.sparkSession
    folder = scratch_dir(spark, "word-filters")
    kinds = F.least(F.char_length("word"), F.lit(LONGEST_CLASS)).alias("kind")
    counts = {row["kind"]: row["count"] for row in vocabulary.groupBy(kinds).count().collect()}
    parts = {kind: -(-n // shard_words) for kind, n in counts.items()}

    def hashed(batches):
        for batch in batches:
            kinds, numbers, values = [], [], []
            for length, words in _by_length(batch["word"].to_pylist()):
                found = word_hashes(_as_rows(words, length))
                kind = int(shard_class(length))
                kinds.append(np.full(len(found), kind))
                numbers.append(_part(found, parts[kind]))
                values.append(found.view("i8"))
            if kinds:
                arrays = [pa.array(np.concatenate(a)) for a in (kinds, numbers, values)]
                yield pa.RecordBatch.from_arrays(arrays, ["kind", "part", "hash"])

    def save(key, group: pd.DataFrame) -> pd.DataFrame:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        path = f"{path}/{unique_name(f'{key[0]}-{key[1]}', '.bloom')}"
        with fs.open_output_stream(path, compression=None) as sink:
            sink.write(build_filter(group["hash"].to_numpy().view("u8")).astype("<u8").tobytes())
        return pd.DataFrame({"kind": [key[0]], "part": [key[1]], "path": [path]})

    rows = vocabulary.select("word").mapInArrow(hashed, "kind long, part long, hash long")
    saved = materialize(rows.groupBy("kind", "part").applyInPandas(save, "kind long, part long, path string"), "word-filter-files")
    paths: dict[int, list[str | None]] = {kind: [None] * n for kind, n in parts.items()}
    for row in saved.collect():
        paths[row["kind"]][row["part"]] = row["path"]
    return Filters(folder, paths)


def _by_length(words: list[str]) -> list[tuple[int, list[bytes]]]:
    held: dict[int, list[bytes]] = {}
    for word in words:
        held.setdefault(len(word), []).append(word.encode("latin-1"))
    return sorted(held.items())


# Pairs -------------------------------------------------------------------------

def possible_pairs(words: list[str], filters: Filters) -> Iterator[tuple[list[str], list[str]]]:
    """Words and edits of them that may be in the vocabulary, each pair from one side."""
    for length, group in _by_length(words):
        step = max(1, EDITS // (len(ALPHABET) * min(length, 64)))
        for first in range(0, len(group), step):
            some = group[first : first + step]
            left, right = [], []
            for kind, rows, places, letters, hashes in edits(_as_rows(some, length)):
                for at in np.flatnonzero(filters.holds(length - (kind == "delete"), hashes)).tolist():
                    word = some[rows[at]]
                    left.append(word.decode("latin-1"))
                    right.append(spelled(kind, word, int(places[at]), int(letters[at])).decode("latin-1"))
                if len(left) * length > 1 << 23:
                    yield left, right
                    left, right = [], []
            yield left, right


def near_words(vocabulary: DataFrame, filters: Filters) -> DataFrame:
    """word, n, near, near_n: all pairs of near words of a vocabulary (word, n), both ways."""

    def probe(batches):
        for batch in batches:
            for left, right in possible_pairs(batch["word"].to_pylist(), filters):
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["word", "near"])

    # words of one length together: a task then asks for the shards of two lengths. The
    # number of tasks is given, as a few bytes of words make much work
    tasks = parallelism(vocabulary.sparkSession)
    ranged = vocabulary.select("word").repartitionByRange(tasks, F.char_length("word"), F.xxhash64("word"))
    possible = ranged.mapInArrow(probe, "word string, near string")
    right = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = materialize(possible.join(right, "near").join(vocabulary, "word").select("word", "n", "near", "near_n"), "near-words")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word that forms (word, form) lead to."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        moved = at.join(ahead, "root", "left")
        moved = materialize(moved.select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "roots")
        at = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return at


def variants(
    documents: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, times: int = TIMES,
    variant: Variant | None = None, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary."""
    counted = count_words(documents, min_chars, variant).where(F.col("n") >= min_count)
    vocabulary = materialize(counted, "vocabulary")
    pairs = near_words(vocabulary, build_filters(vocabulary, shard_words))
    # the greatest count first, then the smallest word
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = near.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    judged = vocabulary.join(near, "word", "left")
    common = F.col("form_n") >= times * F.col("n")
    judged = judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(common, F.col("form")).alias("form"), F.when(common, F.col("form_n")).alias("form_n"),
    )
    judged = materialize(judged, "word-forms")
    found = roots(judged.where("form is not null"))
    return judged.join(found, "word", "left").withColumn("root", F.coalesce("root", "word"))
