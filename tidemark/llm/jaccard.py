"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, and their groups.

Two sets link when `denominator * |intersection| >= numerator * |union|`. Then
they differ in at most d = (denominator - numerator) / numerator times the smaller
size. Sizes are banded; in a band the space of shingle hashes is cut into so many
parts that nearly every set fills more than d of them, so linked sets agree in a
part that is not empty. (Sets that fill d parts or fewer can agree in empty parts
alone; only those enter tiles for their empty parts too, and as both sets of such a
pair do, none is missed.) A tile is what shares the content of a part: (band, part,
hash of the shingles in it). Documents enter the tiles of their own band and of the
lower bands that may hold a partner.

1. Equal sets become one node (the smallest doc_id). Tiles hold hashes of sets, and a task
   gives those of a set once, so copies cost next to nothing and no wide row is joined for them.
2. In each tile every node is paired with the tile's smallest and largest node.
   Sizes, then bitmaps (bits that only one side has bound the overlap from above),
   then the exact intersection of the sorted arrays decide. This is linear in rows.
3. Connected components of those links. Only tiles of four nodes or more that still
   hold two components can hide a link: there all pairs of nodes of different
   components pass the same three tests, in blocks of bounded size.

So no link between components is lost, nothing is capped, and a tile of near copies
is never expanded into its pairs.

Defined cases: without words or text the set is empty and links with nothing; with
fewer words than a shingle the whole sequence is the one shingle; rows that repeat a
doc_id are one document for the groups; a null doc_id belongs to no group (null
component); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import parallelism, slices
from tidemark.storage import materialize

#: Nodes of a block when all pairs of a tile must be looked at.
BLOCK = 1024

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()
_NO_TILES = np.zeros(0, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)] if words else [], np.uint64)
    if len(_words) > 400_000:
        _words.clear()
    hashed = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    last = len(words) - size + 1
    total = np.zeros(last, np.uint64)
    for i in range(size):
        total += _mix(hashed[i : i + last] * np.uint64(_MULTIPLIERS[i % len(_MULTIPLIERS)]) + np.uint64(i))
    return np.unique(_mix(total))


class Bands:
    """Size bands, the parts of each, and the bitmap width of each."""

    def __init__(self, numerator: int, denominator: int):
        self.numerator, self.denominator = numerator, denominator
        self.edges = [1]
        self._parts: dict[int, int] = {}

    def band(self, size: int) -> int:
        while self.edges[-1] <= size:
            low = self.edges[-1]
            self.edges.append(max(low + 1, low * 3 // 2))
        return int(np.searchsorted(self.edges, size, "right")) - 1

    def largest(self, band: int) -> int:
        return self.edges[band + 1] - 1

    def differing(self, band: int) -> int:
        """Elements in which linked sets differ at most, if the smaller is of this band."""
        return (self.denominator - self.numerator) * self.largest(band) // self.numerator

    def parts(self, band: int) -> int:
        """The fewest parts of which the band's smallest sets fill, but for rare ones, more than may differ."""
        if band not in self._parts:
            least, smallest = self.differing(band) + 1, self.edges[band]
            number = least
            while 1 < least and number < 2 * least:
                share = smallest / number
                filled = number * (1 - np.exp(-share))
                spread = np.sqrt(number * np.exp(-share) * max(0.0, 1 - (1 + share) * np.exp(-share)))
                if filled - 3 * spread >= least:
                    break
                number += max(1, number // 50)
            self._parts[band] = number
        return self._parts[band]

    def width(self, band: int) -> int:
        """Bits of a bitmap: the power of two from twice the largest set on."""
        return max(64, 1 << (2 * self.largest(band) - 1).bit_length())

    def tiles(self, found: np.ndarray) -> np.ndarray:
        """Keys of all tiles of a set."""
        if not len(found):
            return _NO_TILES
        own = self.band(len(found))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(found + np.uint64(_MULTIPLIERS[0])), dtype=np.uint64)])
        keys = []
        for band in range(own, -1, -1):
            if band < own and self.largest(band) * self.denominator < self.numerator * len(found):
                break
            parts = self.parts(band)
            inner = ((np.arange(1, parts, dtype=np.float64) / parts) * 2.0**64).astype(np.uint64)
            ends = np.concatenate([[0], np.searchsorted(found, inner, "left"), [len(found)]])
            number = np.arange(parts, dtype=np.uint64) + np.uint64(band << 40)
            content = sums[ends[1:]] - sums[ends[:-1]]
            filled = ends[1:] > ends[:-1]
            if filled.sum() > self.differing(band):
                number, content = number[filled], content[filled]
            keys.append(_mix(_mix(content) ^ (_mix(number * np.uint64(_MULTIPLIERS[1])))))
        return np.concatenate(keys)

    def bitmap(self, found: np.ndarray) -> bytes:
        if not len(found):
            return b""
        width = self.width(self.band(len(found)))
        bits = np.zeros(width, bool)
        bits[(_mix(found ^ np.uint64(_MULTIPLIERS[2])) % np.uint64(width)).astype(np.int64)] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def sizes_fit(self, a, b):
        return self.numerator * np.maximum(a, b) <= self.denominator * np.minimum(a, b)

    def links(self, a, b, common):
        """Whether sets of sizes a and b with so many common elements link."""
        return self.denominator * common >= self.numerator * (a + b - common)


def fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of more bytes folded to `size` bytes: the same elements, fewer bits."""
    return np.bitwise_or.reduce(bitmap.reshape(-1, size), axis=0) if len(bitmap) > size else bitmap


def overlap_bound(a: np.ndarray, b: np.ndarray, size_a, size_b):
    """Upper bound of the overlap of sets by their bitmaps (rows of the last axis)."""
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(size_a - only_a, size_b - only_b)


def _sets(documents: DataFrame, words: int, bands: Bands) -> DataFrame:
    """doc_id, size, hash of the set (two longs), bitmap and tiles of each document.

    Of the equal sets of a task one has the tiles, a set with a null doc_id none.
    """

    def build(batches):
        seen = set()
        for batch in batches:
            for some in slices(batch, 4 << 20):
                rows = []
                for doc_id, text in zip(some["doc_id"].to_pylist(), some["text"].to_pylist(), strict=True):
                    found = shingles(text, words)
                    digest = xxhash.xxh3_128_digest(found.tobytes())
                    tiles = _NO_TILES
                    if doc_id is not None and digest not in seen:
                        seen.add(digest)
                        tiles = bands.tiles(found)
                    rows.append((len(found), *np.frombuffer(digest, "<i8").tolist(), bands.bitmap(found), tiles.view("i8")))
                size, high, low, bitmap, tiles = zip(*rows, strict=True)
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in tiles])]).astype("i4")
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(tiles)))
                arrays = [some["doc_id"], pa.array(size, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(bitmap, pa.binary()), listed]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "size", "high", "low", "bitmap", "tiles"])

    return documents.mapInArrow(build, "doc_id long, size long, high long, low long, bitmap binary, tiles array<long>")


def _verified(pairs: DataFrame, documents: DataFrame, words: int, bands: Bands) -> DataFrame:
    """The pairs (a, b) whose texts link, by the sorted arrays of their shingles."""

    def arrays(batches):
        for batch in batches:
            for some in slices(batch, 4 << 20):
                found = [shingles(text, words).tobytes() for text in some["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([some["doc_id"], pa.array(found, pa.binary())], ["node", "elements"])

    def intersect(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch["elements_a"], batch["elements_b"], strict=True):
                x, y = np.frombuffer(a.as_py(), "u8"), np.frombuffer(b.as_py(), "u8")
                at = np.searchsorted(x, y)
                common = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(bool(bands.links(len(x), len(y), common)))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept["a"], kept["b"]], ["a", "b"])

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = documents.join(nodes, "doc_id", "left_semi")
    elements = materialize(texts.mapInArrow(arrays, "node long, elements binary"), "elements")
    first = elements.select(F.col("node").alias("a"), F.col("elements").alias("elements_a"))
    second = elements.select(F.col("node").alias("b"), F.col("elements").alias("elements_b"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "elements_a", "elements_b")
    return both.mapInArrow(intersect, "a long, b long").distinct()


def _plausible(pairs: DataFrame, nodes: DataFrame, bands: Bands) -> DataFrame:
    """The pairs whose sizes and bitmaps allow a link."""

    def bound(batches):
        for batch in batches:
            keep = []
            for a, b, x, y in zip(*(batch[c].to_pylist() for c in ("size_a", "size_b", "bitmap_a", "bitmap_b")), strict=True):
                width = min(len(x), len(y))
                x, y = (fold(np.frombuffer(bitmap, "u1"), width) for bitmap in (x, y))
                keep.append(bool(bands.links(a, b, overlap_bound(x, y, a, b))))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept["a"], kept["b"]], ["a", "b"])

    # most sets share no tile: only those of the pairs are joined with their bitmaps
    named = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "paired-nodes")
    nodes = materialize(nodes.select("node", "size", "bitmap").join(named, "node", "left_semi"), "paired-sets")
    first, second = (
        nodes.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("bitmap").alias(f"bitmap_{side}")) for side in "ab"
    )
    largest, smallest = F.greatest("size_a", "size_b"), F.least("size_a", "size_b")
    fit = pairs.join(first, "a").join(second, "b").where(bands.numerator * largest <= bands.denominator * smallest)
    return fit.select("a", "b", "size_a", "size_b", "bitmap_a", "bitmap_b").mapInArrow(bound, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of all nodes of the links (a, b).

    Every round hooks each node to its smallest neighbour, shortens those pointers
    twice, and renames the links by them; what remains links different groups. The
    tables are written each round; only a row count reaches the driver.
    """
    links = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    labels = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while links.head(1):
        both = links.union(links.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("at"), F.least("a", "b").alias("to"))
        hooks = materialize(hooks, "hooks")
        for _ in range(2):
            further = hooks.select(F.col("at").alias("to"), F.col("to").alias("next"))
            hooks = materialize(hooks.join(further, "to").select("at", F.col("next").alias("to")), "hooks")
        labels = labels.join(hooks, labels.component == hooks.at, "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = materialize(labels, "labels")
        renamed = links.join(hooks.select(F.col("at").alias("a"), F.col("to").alias("x")), "a")
        renamed = renamed.join(hooks.select(F.col("at").alias("b"), F.col("to").alias("y")), "b")
        renamed = renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()
        links = materialize(renamed, "links")
    return labels


def _across(shared: DataFrame, nodes: DataFrame, groups: DataFrame, bands: Bands) -> DataFrame:
    """Pairs of different components that share a tile and pass sizes and bitmaps, once for each such tile."""
    labelled = shared.join(groups, "node", "left").select("tile", "node", F.coalesce("component", "node").alias("component"))
    labelled = materialize(labelled, "tile-groups")
    counted = labelled.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    still_open = counted.where("n > 3 and low < high").select("tile", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = materialize(labelled.join(still_open, "tile"), "open-tiles")
    block = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    members = members.select("tile", "node", "component", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    members = members.withColumns({"row": F.least("block", "other"), "column": F.greatest("block", "other")})
    held = nodes.select("node", "size", "bitmap").join(members.select("node").distinct(), "node", "left_semi")
    full = members.join(materialize(held, "open-sets"), "node")

    def compare(key, group: pd.DataFrame) -> pd.DataFrame:
        _, row, column = (int(k) for k in key)
        group = group.sort_values("size", kind="stable")
        size, component = group["size"].to_numpy(), group["component"].to_numpy()
        block, node = group["block"].to_numpy(), group["node"].to_numpy()
        width = min(map(len, group["bitmap"]))
        bitmap = np.stack([fold(np.frombuffer(x, "u1"), width) for x in group["bitmap"]])
        found = []
        for i in range(len(group) - 1):
            last = int(np.searchsorted(size, bands.denominator * size[i] // bands.numerator, "right"))
            if row != column:
                pick = np.flatnonzero(block[i + 1 : last] != block[i]) + i + 1
            else:
                pick = np.arange(i + 1, last)
            pick = pick[component[pick] != component[i]]
            if len(pick):
                bound = overlap_bound(bitmap[i], bitmap[pick], size[i], size[pick])
                for j in pick[bands.links(size[i], size[pick], bound)].tolist():
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return full.groupBy("tile", "row", "column").applyInPandas(compare, "a long, b long")


def groups(documents: DataFrame, words: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of (doc_id, text); five words and 0.8 unless told otherwise."""
    bands = Bands(numerator, denominator)
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = materialize(_sets(texts, words, bands), "sets")
    known = sets.where("doc_id is not null")
    # sets that stand alone are their own class and are joined with nothing
    classes = known.where("size > 0").groupBy("high", "low").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes.where("n > 1").drop("n"), "classes")
    members = known.select("doc_id", "size", "high", "low").join(classes, ["high", "low"], "left")
    members = materialize(members.withColumn("node", F.coalesce("node", "doc_id")), "members")
    nodes = known.where("size > 0").withColumnRenamed("doc_id", "node")
    # a half of the hash stands for a set in its tiles; all sets that have it are tried
    hashed = members.where("size > 0 and doc_id = node").select("high", "node")
    known_texts = texts.where("doc_id is not null")

    tiles = known.where("size > 0").select("high", F.explode("tiles").alias("tile")).repartition(parallelism(spark), "tile").distinct()
    several = tiles.groupBy("tile").agg(F.min("high").alias("first"), F.max("high").alias("last")).where("first < last")
    shared = materialize(tiles.join(several.select("tile"), "tile"), "shared-hashes")
    # most near copies are made of the smallest doc_id, so that one links more of them than any other
    shared = materialize(shared.join(hashed, "high").select("tile", "node"), "shared-tiles")
    ends = shared.groupBy("tile").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    pairs = shared.join(ends, "tile").select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("high").alias("b")))).alias("pair"))
    pairs = materialize(pairs.select("pair.*").where("a < b").distinct(), "pairs")
    tried = materialize(_plausible(pairs, nodes, bands), "plausible")
    links = materialize(_verified(tried, known_texts, words, bands), "links")

    # rows of one doc_id are one document, whatever their texts; empty ones link nothing
    filled = members.where("size > 0")
    repeated = filled.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    repeated = filled.join(repeated.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).where("a < b")
    links = links.union(repeated)
    labels = components(links)
    across = materialize(_across(shared, nodes, labels, bands).distinct().join(pairs, ["a", "b"], "left_anti"), "across")
    if across.head(1):
        labels = components(reduce(DataFrame.union, [links, _verified(across, known_texts, words, bands)]))

    labels = labels.withColumnRenamed("component", "component_id")
    placed = members.join(labels, "node", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "node").alias("component_id"))
    # an empty set links with nothing, and groups with no other empty set
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    placed = placed.withColumn("component_id", alone)
    nameless = sets.where("doc_id is null").select("doc_id", F.col("size").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return placed.union(nameless)


def one_of_each_group(documents: DataFrame, words: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """The documents with the smallest doc_id of their group, all columns; a null doc_id stays."""
    found = groups(documents, words, numerator, denominator).where("doc_id <> component_id")
    gone = materialize(found.select(F.col("doc_id").alias("__gone")).distinct(), "near-copies")
    return documents.join(gone, documents["doc_id"].cast("long") == gone["__gone"], "left_anti")
