"""Secret scan: candidates by pattern, false findings removed by a random forest.

Candidates are values after an assignment to a telling name, long runs of the
characters of keys, and private key blocks. The forest judges each by its length and
kinds of characters, character transitions (how usual its pairs of characters are in
the corpus), coverage by words of the corpus, the path of the document and the
words next to it. Pairs and words are counted over whole texts of all documents. The
forest is trained from labelled findings: keys of known making (right) and hashes,
ids, paths, words and placeholders (wrong), set into places of a bounded sample of
the corpus, so that labels are known by construction.

Values leave the operator only as a SHA-256 digest; `redact` replaces them.

Defined cases: a null or empty text has no findings; a null doc_id is returned as it
is; rows that repeat a doc_id are scanned one by one; a value found by two patterns
counts once (the longer one); an empty table gives no rows; other columns are
ignored by `find` and kept by `redact`.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import string
import uuid
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import slices
from tidemark.llm.trees import Forest
from tidemark.storage import materialize

#: Documents whose places the forest is trained with, at most; findings made of each label.
SAMPLE, FINDINGS = 1_500, 2_500
THRESHOLD = 0.5
#: Shares of all pairs of characters and of all words that a pair or word must reach to be known: at most as many as their inverses.
PAIR_FLOOR, WORD_FLOOR = 1e-6, 5e-6
#: Distinct words a task counts before it hands them on.
HELD_WORDS = 500_000
#: Characters before and after a value whose words count as neighbours.
NEAR = 48

_KEY = re.compile(r"[A-Za-z0-9_\-+/=.~]{16,}+")
_ASSIGNED = re.compile(r"[\"']?\s{0,3}(?:=>|:=|[:=])\s{0,3}[\"'`]?([^\s\"'`,;<>(){}]{6,}+)")
_NAME = re.compile(r"([A-Za-z][A-Za-z0-9_\-]*)$")
_BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s:,\-]*?-----END [A-Z ]*PRIVATE KEY-----")
_WORD = re.compile(r"[A-Za-z]+")
_LONG_WORD = re.compile(r"[a-z]{4,}")

# Words beside a value and what they tell.
TELLING = "password passwd pwd pass passphrase secret token apikey key auth authorization bearer credential credentials private client access signing".split()
HASHES = "sha sha1 sha256 md5 hash checksum digest commit revision rev etag integrity fingerprint crc".split()
NAMES = "id uuid guid ref version build file path url href src image asset order invoice ticket session name".split()
SAMPLES = "example sample test tests dummy fake placeholder mock fixture fixtures demo docs spec your changeme redacted".split()
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xox", "sk_live_", "sk-", "rk_live_", "AIza", "eyJ", "SG.", "npm_", "-----BEGIN")
NEIGHBOURS = tuple(map(frozenset, (TELLING, HASHES, NAMES, SAMPLES)))


def _floor(total: int, share: float) -> int:
    return max(2, math.ceil(total * share))


def count(texts: list[str | None]) -> tuple[Counter, Counter, int]:
    """Pairs of letters and digits, words of four letters and more, and the number of all pairs of characters."""
    low = "\n".join(text for text in texts if text).lower()
    words = Counter(_LONG_WORD.findall(low))
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    first, second = codes[:-1], codes[1:]
    near = (first < 1024) & (second < 1024)
    counted = np.bincount(first[near] * 1024 + second[near], minlength=1)
    found = [(int(k) // 1024, int(k) % 1024, int(counted[k])) for k in np.flatnonzero(counted)]
    keys, times = np.unique(first[~near] << 21 | second[~near], return_counts=True)
    found += [(k >> 21, k & (1 << 21) - 1, n) for k, n in zip(keys.tolist(), times.tolist(), strict=True)]
    pairs = Counter({pair: n for a, b, n in found if (pair := chr(a) + chr(b)).isalnum()})
    return pairs, words, len(first)


class Candidate(NamedTuple):
    start: int
    end: int
    kind: str


def _plausible_key(value: str) -> bool:
    digits = sum(map(str.isdigit, value))
    return 0 < digits < len(value) and any(map(str.isalpha, value)) or (digits == 0 and value.lower() != value and value.upper() != value and len(value) >= 24)


def candidates(text: str | None) -> list[Candidate]:
    """Places of candidate values; of overlapping ones the longest."""
    text = text or ""
    found = []
    if "-----BEGIN" in text:
        found += [Candidate(m.start(), m.end(), "private key") for m in _BLOCK.finditer(text)]
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            name = _NAME.search(text[max(0, m.start() - 40) : m.start()])
            parts = _WORD.findall(name[1].lower()) if name else []
            if any(part in NEIGHBOURS[0] or part.endswith(("key", "token", "secret", "password")) for part in parts):
                found.append(Candidate(m.start(1), m.end(1), "assigned"))
    found += [Candidate(m.start(), m.end(), "key") for m in _KEY.finditer(text) if _plausible_key(m[0])]
    found.sort(key=lambda c: (c.start, -c.end, c.kind))
    out: list[Candidate] = []
    for c in found:
        if out and c.start < out[-1].end:
            if c.end - c.start > out[-1].end - out[-1].start:
                out[-1] = c
        else:
            out.append(c)
    return out


class Language:
    """Pairs of letters and words of the corpus, from their counts.

    Kept are pairs and words that are there twice and reach a share (`PAIR_FLOOR`,
    `WORD_FLOOR`) of all, which bounds both tables whatever the corpus.
    """

    def __init__(self, pairs: Counter, words: Counter, all_pairs: int, all_words: int):
        total = all_pairs + 1
        self.rare = math.log(0.5 * max(1 / total, PAIR_FLOOR))
        self.pairs = {pair: math.log(n / total) for pair, n in pairs.items() if n >= _floor(all_pairs, PAIR_FLOOR)}
        self.words = frozenset(word for word, n in words.items() if n >= _floor(all_words, WORD_FLOOR)) | frozenset(w for group in NEIGHBOURS for w in group)

    @classmethod
    def of(cls, texts: list[str]) -> Language:
        pairs, words, total = count(texts)
        return cls(pairs, words, total, words.total())

    def usual(self, value: str) -> float:
        """Mean logarithm of the shares of a value's pairs of characters."""
        low = value.lower()
        return sum(self.pairs.get(low[i : i + 2], self.rare) for i in range(len(low) - 1)) / max(1, len(low) - 1)

    def covered(self, value: str) -> float:
        """Share of characters in words of the corpus, longest first from the left."""
        total = 0
        for run in _WORD.findall(value.lower()):
            at = 0
            while at < len(run) - 3:
                size = next((n for n in range(min(14, len(run) - at), 3, -1) if run[at : at + n] in self.words), 0)
                total += size
                at += size or 1
        return total / max(1, len(value))


def _kind_of(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(value: str, kind: str, before: str, after: str, path: str, language: Language) -> list[float]:
    kinds = [_kind_of(c) for c in value]
    n = max(1, len(value))
    counts = Counter(value)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    near = set(_WORD.findall(before.lower())) | {part for word in re.findall(r"[A-Za-z_\-]+", before.lower()) for part in re.split(r"[_\-]", word)}
    beyond = set(_WORD.findall(after.lower()))
    own = set(_WORD.findall(value.lower()))
    last = before.rstrip(" \"'`=:>").lower()
    parts = re.split(r"[^a-z0-9]+", path.lower())
    steps = sum(abs(ord(a) - ord(b)) <= 1 for a, b in zip(value, value[1:], strict=False)) / n
    return [
        len(value), entropy, entropy / math.log2(max(2, min(n, 64))),
        *(kinds.count(k) / n for k in range(4)),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, steps, len(counts) / n,
        language.usual(value), language.covered(value),
        all(c in string.hexdigits for c in value), n in (32, 40, 56, 64, 96, 128), value.count("/") + value.count("."), value.count("-"), value.count("_"),
        bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value)),
        value.startswith(PREFIXES), kind == "assigned", kind == "private key",
        before.rstrip(" ").endswith(("=", ":", "=>")) or before.rstrip("\"'`").rstrip(" ").endswith(("=", ":")), before[-1:] in "\"'`" and before != "",
        *(bool(near & group) for group in NEIGHBOURS), *(any(last.endswith(w) for w in group) for group in (TELLING, HASHES, NAMES)),
        bool(beyond & NEIGHBOURS[1]), bool(own & NEIGHBOURS[3]), any(part in NEIGHBOURS[3] for part in parts),
    ]


def _made(rng: np.random.Generator, right: bool, words: list[str]) -> tuple[str, str, str, str]:
    """A labelled finding: text before, value, text after, path."""
    def pick(*choices):
        return choices[int(rng.integers(len(choices)))]

    def run(alphabet: str, n: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))

    letters = string.ascii_letters + string.digits
    lower = "0123456789abcdef"
    quote, sign = pick('"', "'", ""), pick(" = ", "=", ": ", " := ")
    hexes = run(pick(lower, lower.upper()), pick(32, 40, 40, 64))
    paths = ("src/app/settings.py", "config/prod.env", "", "", "deploy/values.yaml", f"src{int(rng.integers(30))}")
    if right:
        name = pick("token", "TOKEN", "api_key", "API_KEY", "secret", "client_secret", "password", "auth_token", "access_key", "Authorization", "private_key")
        value = pick(
            hexes, hexes, run(letters, int(rng.integers(20, 64))), "AKIA" + run(string.ascii_uppercase + string.digits, 16), "ghp_" + run(letters, 36),
            "sk_live_" + run(letters, 24), base64.b64encode(rng.bytes(int(rng.integers(18, 48)))).decode(), "eyJ" + run(letters, 30) + "." + run(letters, 60) + "." + run(letters, 43),
            run(letters + "!#$%*+-_", int(rng.integers(10, 24))), run(letters + "_-", 40),
        )
        if not value.startswith(("AKIA", "ghp_", "sk_live_", "eyJ")) or rng.random() < 0.7:
            return f"{' '.join(words[:6])} {name}{sign}{quote}", value, f"{quote} {' '.join(words[6:])}", pick(*paths)
        return f"{' '.join(words[:8])} ", value, f" {' '.join(words[8:])}", pick(*paths)
    plain = [w for w in words if w.isalpha()] or ["word"]
    joined = pick("_", "-", "/", ".", "").join(pick(*plain) for _ in range(int(rng.integers(3, 6)))) + pick("", str(int(rng.integers(0, 9999))))
    how = int(rng.integers(0, 8))
    before, after, path = f"{' '.join(words[:6])} ", f" {' '.join(words[6:])}", pick(*paths)
    if how == 0:  # hashes of files and commits
        return before + pick("commit ", "sha256: ", "md5 ", "checksum = ", "integrity: ", "revision "), hexes, after, path
    if how == 1:  # ids
        return before + pick("id=", "uuid: ", "ref ", "order ", ""), str(uuid.UUID(bytes=rng.bytes(16))), after, path
    if how == 2:  # placeholders
        name = pick("password", "token", "api_key", "secret")
        value = pick("your_" + name + "_here", "changeme123", "xxxxxxxxxxxxxxxxxxxx", "example-" + name + "-1234", "<" + name + ">", "placeholder_" + name, "${" + name.upper() + "}", "0000000000000000", "1234567890abcdef", "REDACTED_VALUE_1")
        return before + name + sign + quote, value.strip("<>"), quote + after, path
    if how == 3:  # words, paths and names
        return before + pick("", "", "path: ", "file = ", "url="), joined, after, path
    if how == 4:  # assignments of words
        return before + pick("token", "key", "secret", "password", "auth") + sign, pick(joined, pick(*plain), "None", "required", "os.environ.get"), after, path
    if how == 5:  # keys of tests and documentation
        return before + pick("example token = ", "dummy api_key: ", "test password = ") + quote, pick(hexes, run(letters, 32)), quote + after, pick("tests/fixtures/keys.py", "docs/example.md")
    if how == 6:  # versions, addresses, numbers
        return before, pick(f"v{int(rng.integers(9))}.{int(rng.integers(99))}.{int(rng.integers(99))}-build{int(rng.integers(99999))}", f"{pick(*plain)}.{int(rng.integers(99))}", f"{int(rng.integers(10**15, 10**16))}a", "2024-01-15T10:20:30.123456Z"), after, path
    return before + pick("etag ", "asset-", "image_", "session "), run(lower, 16) + pick(".png", ".js", "-min.css", "/index.html"), after, path


class Scanner:
    """A trained forest with the language it was trained in."""

    def __init__(self, forest: Forest, language: Language):
        self.forest, self.language = forest, language

    @classmethod
    def train(cls, texts: list[str], findings: int = FINDINGS, seed: int = 5, language: Language | None = None) -> Scanner:
        """Half of the findings are right. Those whose value is no candidate in its place are left out. Without a language, that of the texts."""
        rng = np.random.default_rng(seed)
        language = language or Language.of(texts)
        held = [words for words in (text.split() for text in texts) if len(words) >= 12] or [["some", "plain", "words"] * 4]
        rows, targets = [], []
        for k in range(2 * findings):
            words = held[int(rng.integers(len(held)))]
            at = int(rng.integers(0, len(words) - 11))
            before, value, after, path = _made(rng, k % 2 == 0, words[at : at + 12])
            text = before + value + after
            for c in candidates(text):
                if c.start <= len(before) + 2 and c.end >= len(before) + len(value) - 2 and c.end > len(before):
                    rows.append(cls._row(text, c, path, language))
                    targets.append(k % 2 == 0)
        return cls(Forest.fit(np.array(rows, float), np.array(targets, float)), language)

    @staticmethod
    def _row(text: str, c: Candidate, path: str, language: Language) -> list[float]:
        return features(text[c.start : c.end], c.kind, text[max(0, c.start - NEAR) : c.start], text[c.end : c.end + NEAR], path, language)

    def __call__(self, texts: list[str | None], paths: list[str | None]) -> list[list[tuple[Candidate, float]]]:
        """Candidates of each text with the probability that they are secrets."""
        found = [candidates(text) for text in texts]
        rows = [self._row(text, c, path or "", self.language) for text, path, own in zip(texts, paths, found, strict=True) for c in own]
        odds = iter(self.forest(np.array(rows, float)).tolist() if rows else ())
        return [[(c, next(odds)) for c in own] for own in found]


def language_of(documents: DataFrame) -> Language:
    """The language of whole texts of all documents; tasks sum before they shuffle, and only what reaches the floors goes to the driver."""
    texts = documents.select(F.col("text").cast("string").alias("text")).where("text is not null")

    def counts(batches):
        pairs, words, total = Counter(), Counter(), 0

        def table():
            rows = [("pair", k, n) for k, n in pairs.items()] + [("word", k, n) for k, n in words.items()] + [("pairs", "", total), ("words", "", words.total())]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["kind", "key", "n"])

        for batch in batches:
            for some in slices(batch):
                own_pairs, own_words, own_total = count(some["text"].to_pylist())
                pairs.update(own_pairs)
                words.update(own_words)
                total += own_total
                if len(words) + len(pairs) > HELD_WORDS:
                    yield table()
                    pairs, words, total = Counter(), Counter(), 0
        yield table()

    summed = texts.mapInArrow(counts, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    summed = materialize(summed, "language")
    total = {row.kind: row.n for row in summed.where("kind in ('pairs', 'words')").collect()}
    all_pairs, all_words = total.get("pairs", 0), total.get("words", 0)
    pairs = summed.where((F.col("kind") == "pair") & (F.col("n") >= _floor(all_pairs, PAIR_FLOOR)))
    words = summed.where((F.col("kind") == "word") & (F.col("n") >= _floor(all_words, WORD_FLOOR)))
    known = [Counter({row.key: row.n for row in rows.toLocalIterator()}) for rows in (pairs, words)]
    return Language(*known, all_pairs, all_words)


def train(documents: DataFrame, sample: int = SAMPLE) -> Scanner:
    """A scanner trained with the language of all documents, and places of the `sample` documents with the smallest hashes."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # about twice the sample passes, so tasks hand the driver no more than that
    bound = int((1 << 30) * min(1.0, 2 * sample / max(1, texts.count())))
    placed = texts.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("place"))
    picked = placed.where(F.col("place") < bound).orderBy("place", "text").limit(sample)
    return Scanner.train([row.text for row in picked.select("text").collect()], language=language_of(documents))


def find(documents: DataFrame, path: str | None = None, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, end (code points), kind, value_sha256, probability, is_secret of every candidate of (doc_id, text).

    `path` names the column that tells where a document comes from.
    """
    scanner = train(documents, sample)
    where = F.col(path).cast("string") if path else F.lit("")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), where.alias("path"))

    def scan(batches):
        for batch in batches:
            for some in slices(batch):
                texts = some["text"].to_pylist()
                out = []
                for doc_id, text, found in zip(some["doc_id"].to_pylist(), texts, scanner(texts, some["path"].to_pylist()), strict=True):
                    for c, odds in found:
                        digest = hashlib.sha256(text[c.start : c.end].encode("utf-8", "surrogatepass")).hexdigest()
                        out.append((doc_id, c.start, c.end, c.kind, digest, odds, odds >= threshold))
                if out:
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_()]
                    names = ["doc_id", "start", "end", "kind", "value_sha256", "probability", "is_secret"]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return rows.mapInArrow(scan, "doc_id long, start long, end long, kind string, value_sha256 string, probability double, is_secret boolean")


def redact(documents: DataFrame, path: str | None = None, sample: int = SAMPLE, threshold: float = THRESHOLD, mask: str = "[SECRET]") -> DataFrame:
    """The documents with secrets replaced, all columns."""
    scanner = train(documents, sample)

    def rewrite(batches):
        for batch in batches:
            for some in slices(batch):
                texts = some["text"].to_pylist()
                paths = some[path].to_pylist() if path else [""] * len(texts)
                out = []
                for text, found in zip(texts, scanner(texts, paths), strict=True):
                    for c, odds in reversed(found):
                        if odds >= threshold:
                            text = text[: c.start] + mask + text[c.end :]
                    out.append(text)
                columns = list(some.columns)
                columns[some.schema.names.index("text")] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(columns, some.schema.names)

    return documents.mapInArrow(rewrite, documents.schema)
