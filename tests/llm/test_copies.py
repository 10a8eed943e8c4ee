"""Jaccard groups and line dedup against brute force."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard, lines, queries


def brute_groups(pairs, size, numerator, denominator):
    """(doc_id, shingles, component) by all pairs that share a shingle."""
    sets = defaultdict(list)
    for doc_id, text in pairs:
        words = (text or "").encode().lower().split()
        runs = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()
        sets[doc_id].append(runs)
    parent = {doc_id: doc_id for doc_id in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    rows = [(doc_id, runs) for doc_id, own in sets.items() for runs in own]
    holders = defaultdict(list)
    for k, (_, runs) in enumerate(rows):
        for run in runs:
            holders[run].append(k)
    common = Counter(pair for held in holders.values() for pair in itertools.combinations(held, 2))
    for (i, j), n in common.items():
        (a, x), (b, y) = rows[i], rows[j]
        if denominator * n >= numerator * (len(x) + len(y) - n):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return sorted((doc_id, len(runs), root(doc_id)) for doc_id, runs in rows)


def chained(n, seed):
    """Texts with words changed here and there, so that groups are chains as well as stars."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(60)]
    out = []
    for k in range(n):
        words = base[: rng.randint(1, 60)] if k % 3 else list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 4)}"
        out.append((k, " ".join(words)))
    return out


@pytest.mark.parametrize(("size", "numerator", "denominator"), [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_groups_of_chained_texts(documents, size, numerator, denominator):
    pairs = chained(150, size)
    got = jaccard.groups(documents(pairs), size, numerator, denominator).collect()
    assert sorted(map(tuple, got)) == brute_groups(pairs, size, numerator, denominator)


def test_groups_of_the_given_documents(llm, sf, given):
    got = sorted(map(tuple, queries.op9_ngram_jaccard_join(llm, sf).collect()))
    assert got == brute_groups(given("SELECT doc_id, text FROM documents"), 3, 90, 100)


def test_groups_of_awkward_rows(documents):
    pairs = [(1, None), (2, ""), (3, " \t\x0b"), (4, "One two"), (5, "one TWO"), (6, "Ä b c"), (7, "ä b c"), (8, "x " * 30_000), (9, "x " * 3), (9, "one two"), (9, "one two")]
    got = jaccard.groups(documents([*pairs, (None, "one two")]), 3, 90, 100).collect()
    assert sorted(tuple(row) for row in got if row.doc_id is not None) == brute_groups(pairs, 3, 90, 100)
    assert [tuple(row) for row in got if row.doc_id is None] == [(None, 1, None)]
    assert jaccard.groups(documents([])).collect() == []
    kept = jaccard.one_of_each_group(documents([*pairs, (None, "one two")]), 3, 90, 100)
    assert sorted((row.doc_id or 0) for row in kept.collect()) == [0, 1, 2, 3, 4, 6, 7]
    assert kept.columns == documents([]).columns


def test_empty_rows_of_repeated_ids_link_nothing(documents):
    first, second = "one two three four five six", "seven eight nine ten eleven twelve"
    pairs = [(1, ""), (5, ""), (5, first), (7, None), (7, second), (8, second)]
    got = sorted(map(tuple, jaccard.groups(documents(pairs), 3, 90, 100).collect()))
    assert got == [(1, 0, 1), (5, 0, 5), (5, 4, 5), (7, 0, 7), (7, 4, 7), (8, 4, 7)]
    assert sorted(row.doc_id for row in jaccard.one_of_each_group(documents(pairs), 3, 90, 100).collect()) == [1, 5, 5, 7, 7]


def test_copies_give_their_tiles_once_a_task(documents):
    """A group of copies with a third of all rows, over several tasks, among texts near to it."""
    pairs = [(k, " ".join(f"w{i}" for i in range(60))) for k in range(10, 60)] + [(k, None) for k in range(60, 70)]
    pairs += [(100 + k, text) for k, text in chained(80, 4)]
    df = documents(pairs).repartition(4)
    sets = jaccard._sets(df.select("doc_id", "text"), 3, jaccard.Bands(90, 100))
    given = sets.where("size(tiles) > 0").groupBy("high", "low").count().collect()
    assert max(row["count"] for row in given) == 4
    assert len(given) == sets.where("size > 0").select("high", "low").distinct().count()
    assert sorted(map(tuple, jaccard.groups(df, 3, 90, 100).collect())) == brute_groups(pairs, 3, 90, 100)


def test_two_sets_with_one_half_of_the_hash_are_both_tried(documents, monkeypatch):
    """Texts 1 and 3, which are not alike, get the same half; each has a near copy."""
    real = jaccard._sets

    def clash(*settings):
        sets = real(*settings)
        return sets.withColumn("high", F.when(F.col("doc_id").isin(1, 3), 77).otherwise(F.col("high")))

    monkeypatch.setattr(jaccard, "_sets", clash)
    text = {name: " ".join(f"{name}{i}" for i in range(100)) for name in "ab"}
    pairs = [(1, text["a"]), (2, text["a"] + " end"), (3, text["b"]), (4, text["b"] + " end")]
    got = sorted(map(tuple, jaccard.groups(documents(pairs), 3, 90, 100).collect()))
    assert got == [(1, 98, 1), (2, 99, 1), (3, 98, 3), (4, 99, 3)]


def test_links_across_a_large_tile_are_found(documents, monkeypatch):
    """Copies that link only with some of their tile, in blocks of few."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    pairs = chained(60, 9) + [(100 + k, " ".join(f"w{i}" if (i * 7 + k) % 11 else f"y{k % 3}" for i in range(60))) for k in range(40)]
    got = jaccard.groups(documents(pairs), 1, 80, 100).collect()
    assert sorted(map(tuple, got)) == brute_groups(pairs, 1, 80, 100)


def test_components_of_a_path_and_a_star(llm):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)]
    found = dict(map(tuple, jaccard.components(llm.createDataFrame(links, "a long, b long")).collect()))
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def brute_lines(pairs):
    space = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = [(doc_id, [(line, line.strip(space).translate(lower)) for line in (text or "").split("\n")]) for doc_id, text in pairs]
    holders = defaultdict(list)
    for doc_id, held in split:
        for key in {key for _, key in held if len(key) >= 20}:
            holders[key].append(-1 if doc_id is None else doc_id)
    out = []
    for doc_id, held in split:
        kept = [line for line, key in held if len(holders[key]) < 3 or max(holders[key]) == (-1 if doc_id is None else doc_id)]
        out.append((doc_id, len(held), len(held) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


LINE = "a line that is long enough"
AWKWARD = [
    (1, f"{LINE}\nshort\n {LINE.upper()}\t"), (2, f"x\r\n{LINE}\r"), (3, LINE), (4, None), (5, ""), (6, "é" * 20), (7, "é" * 20 + "\n"), (8, "é" * 20 + "\nÉ"),
    (9, "e" * 19), (10, "e" * 19), (11, "e" * 19), (12, "\n".join([LINE] * 5000)), (12, "other"), (None, LINE),
]


def test_lines_of_awkward_rows(documents):
    df = documents(AWKWARD)
    index = lines.build_index(df)
    got = lines.decisions(df, index).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(AWKWARD)
    rewritten = lines.dedup_lines(df).collect()
    assert {row.doc_id: row.text for row in rewritten if row.doc_id in (1, 2, 4, 5)} == {1: "short", 2: "x\r", 4: None, 5: ""}
    assert all(row.n_chars == (None if row.text is None else len(row.text)) for row in rewritten)
    assert lines.dedup_lines(documents([])).collect() == []
    assert lines.decisions(documents([]), lines.build_index(documents([]))).collect() == []


def test_lines_of_the_given_documents_match_sql(llm, sf, given):
    got = queries.op10_line_dedup(llm, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(given(queries.ORACLES["op10_line_dedup"]))


def test_many_shards_and_little_memory(documents, given, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 3)
    monkeypatch.setattr(lines, "KEPT_BYTES", 64)
    pairs = given("SELECT doc_id, text FROM documents WHERE doc_id < 150") + AWKWARD
    df = documents(pairs)
    index = lines.build_index(df)
    assert len(index.paths) > 2
    got = lines.decisions(df, index).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(pairs)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1000])
def test_perfect_hash_is_minimal(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n).astype("u8")
    assert sorted(lines.PerfectHash.build(keys)(keys).tolist()) == list(range(n))
