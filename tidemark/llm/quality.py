"""Quality classifier from heuristic labellers without labels of their own.

1. Every document gets the votes (for, against, none) of overlapping labellers:
   signs, capitals, three kinds of repetition, function words, word lengths, plain words.
2. Votes are counted by pattern over all documents (at most 3 ** labellers rows).
   Expectation-maximisation on those counts estimates how often each labeller
   votes how on good and on bad documents, and the share of good ones; a
   document's pattern then gives the posterior that it is good.
3. A linear scorer on hashed words and word shapes is fitted to the posteriors of a
   sample of at most `sample` documents (the first by a hash of id and text, so all
   kinds come in their shares) and scores the whole text of every document.

Function words vary in documents of one kind, so a labeller may abstain, and no
labeller is trusted more than its agreement with the others allows.

Defined cases: a null or empty text has no words; it is bad (probability 0); a null
doc_id takes part like any other; repeated rows count as often as they are there;
an empty table gives no rows; other columns are ignored by the scores and kept by
the filter.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import slices
from tidemark.storage import materialize

#: Documents that the scorer is fitted to, at most.
SAMPLE = 6_000
#: Bytes of their texts, at most.
SAMPLE_BYTES = 64 << 20
#: Buckets of hashed features.
BUCKETS = 1 << 15
#: The bucket of words that follow themselves (others may fall there too).
AGAIN = 0
THRESHOLD = 0.6

#: Common function words of four languages.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it was for on are as with be by this at from or an not have which but "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so wie "
    "le la les de des et un une du en que qui dans est pour pas sur au avec ce il ne se par plus sont "
    "el los las y del se que una por con para como su al lo más pero sus ya o este sí porque no es".split()
)

_SIGN = str.maketrans("", "", " \n\t\r.,;:'\"()-?")
_LETTERS = re.compile(r"[^\W\d_]+")


class _Folded(dict):
    """Words without the signs around them, in small letters; kept, as most words come again."""

    def __missing__(self, word: str) -> str:
        value = self[word] = word.strip(".,;:!?\"'()").lower()
        return value


_folded = _Folded()


def measures(text: str | None) -> dict[str, float]:
    """What labellers look at."""
    text = text or ""
    words = text.split()
    n = max(1, len(words))
    dense = text.translate(_SIGN)
    chars = max(1, len(dense))
    letters = sum(map(len, _LETTERS.findall(dense)))
    if len(_folded) > 400_000:
        _folded.clear()
    folded = list(map(_folded.__getitem__, words))
    return {
        "words": len(words),
        "signs": 1 - letters / chars,
        "capitals": sum(map(str.isupper, words)) / n,
        "distinct": len(set(folded)) / n,
        "again": sum(map(str.__eq__, folded, folded[1:])) / n,
        "top": max(Counter(folded).values(), default=0) / n,
        "expected": min(1.0, 1.6 * n**-0.18),
        "function": sum(map(FUNCTION_WORDS.__contains__, folded)) / n,
        "length": len(dense) / n,
        "bare": sum(map(str.isalpha, folded)) / n,
    }


def votes(text: str | None) -> tuple[int, ...]:
    """A vote of each labeller: 1 for good, -1 for bad, 0 for none."""
    m = measures(text)
    few = m["words"] < 8
    spread = m["distinct"] / m["expected"]
    return (
        0 if few or m["signs"] < 0.06 else -1,
        0 if few or m["capitals"] < 0.3 else -1,
        0 if few or spread > 0.45 else -1,
        0 if few or m["again"] < 0.1 else -1,
        0 if few or m["top"] < 0.25 else -1,
        0 if few else 1 if m["function"] > 0.12 else -1 if m["function"] < 0.04 else 0,
        0 if few else 1 if 3 <= m["length"] <= 6.5 else -1 if m["length"] > 7.5 or m["length"] < 2 else 0,
        1 if m["bare"] > 0.9 else -1 if m["bare"] < 0.7 else 0,
        0 if m["words"] else -1,
    )


LABELLERS = 9


class LabelModel:
    """Accuracies of the labellers and the share of good documents."""

    def __init__(self, share: float, tables: np.ndarray):
        self.share, self.tables = share, tables

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
        """Expectation-maximisation over vote patterns and how often each occurs, from the majority's opinion on (no vote: rather good)."""
        belief = 1 / (1 + np.exp(-1.5 * (patterns.sum(axis=1) + 1)))
        model = cls(0.5, np.zeros((2, patterns.shape[1], 3)))
        for _ in range(rounds):
            weights = np.stack([counts * (1 - belief), counts * belief])
            # a few votes of prior keep unseen ones possible; abstaining says the same of either kind
            seen = np.stack([[[w[patterns[:, k] == v].sum() for v in (-1, 0, 1)] for k in range(patterns.shape[1])] for w in weights])
            seen = seen + np.array([[2.0, 1.0, 0.5], [0.5, 1.0, 2.0]])[:, None, :]
            tables = seen / seen.sum(axis=2, keepdims=True)
            tables[:, :, 1] = tables[:, :, 1].mean(axis=0)
            share = float((weights[1].sum() + 1) / (weights.sum() + 2))
            model = cls(share, tables / tables.sum(axis=2, keepdims=True))
            new = model.posterior(patterns)
            if np.abs(new - belief).max() < 1e-6:
                break
            belief = new
        return model

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each pattern."""
        columns = np.arange(patterns.shape[1])
        bad, good = (np.log(table[columns, patterns + 1]).sum(axis=1) for table in self.tables)
        odds = np.log(self.share) - np.log(1 - self.share) + good - bad
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def accuracies(self) -> list[float]:
        """Share of right votes of each labeller among its votes."""
        bad, good = self.tables
        right = (1 - self.share) * bad[:, 0] + self.share * good[:, 2]
        wrong = (1 - self.share) * bad[:, 2] + self.share * good[:, 0]
        return (right / (right + wrong)).tolist()


def shape(word: str) -> str:
    """Kinds of characters in a word, runs as one."""
    kinds = ("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    out = ""
    for kind in kinds:
        if not out.endswith(kind):
            out += kind
    return out


def features(word: str) -> tuple[int, int]:
    """Buckets of a word and of its shape."""
    return xxhash.xxh3_64_intdigest(word.lower()) % BUCKETS, xxhash.xxh3_64_intdigest(shape(word), 1) % BUCKETS


class Scorer:
    """Logistic scores: the mean weight of a text's words, their shapes and words said twice, and a constant."""

    def __init__(self, weights: np.ndarray, constant: float):
        self.weights, self.constant = weights, constant
        self._words: dict[str, float] = {}

    def __getstate__(self):
        return self.weights, self.constant

    def __setstate__(self, state):
        self.__init__(*state)

    @classmethod
    def fit(cls, texts: list[str], targets: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> Scorer:
        """Gradient steps (with momentum and a scale for each weight) on the cross-entropy to soft targets."""
        rows, columns, values = [], [], []
        for row, text in enumerate(texts):
            words = text.split()
            total = len(words) or 1
            held: Counter = Counter()
            for word, n in Counter(words).items():
                for bucket in features(word):
                    held[bucket] += n / total
            held[AGAIN] += sum(map(str.__eq__, words, words[1:])) / total
            rows.append(np.full(len(held), row))
            columns.append(np.fromiter(held.keys(), np.int64, len(held)))
            values.append(np.fromiter(held.values(), float, len(held)))
        weights, constant = np.zeros(BUCKETS), 0.0
        if rows:
            row, column, value = (np.concatenate(x) for x in (rows, columns, values))
            scale = np.sqrt(np.bincount(column, value**2, BUCKETS)) + 0.05 * np.sqrt(len(texts)) / 10
            # both kinds weigh the same
            kinds = targets / max(targets.sum(), 1e-9) + (1 - targets) / max((1 - targets).sum(), 1e-9)
            kinds = kinds / kinds.sum() * len(targets)
            moment = np.zeros(BUCKETS)
            for _ in range(rounds):
                scores = constant + np.bincount(row, weights[column] * value, len(texts))
                error = kinds * (1 / (1 + np.exp(-np.clip(scores, -30, 30))) - targets)
                gradient = np.bincount(column, error[row] * value, BUCKETS) / scale + decay * weights
                moment = 0.8 * moment + 0.2 * gradient
                weights -= rate * moment / np.sqrt(len(texts))
                constant -= rate * 4 * error.mean()
        return cls(weights, constant)

    def _word(self, word: str) -> float:
        a, b = features(word)
        value = self._words[word] = self.weights[a] + self.weights[b]
        return value

    def __call__(self, text: str | None) -> float:
        """Probability of good; 0 without words."""
        words = (text or "").split()
        if not words:
            return 0.0
        if len(self._words) > 300_000:
            self._words.clear()
        known, score = self._words, 0.0
        for word in words:
            value = known.get(word)
            score += self._word(word) if value is None else value
        score += self.weights[AGAIN] * sum(map(str.__eq__, words, words[1:]))
        return float(1 / (1 + np.exp(-np.clip(self.constant + score / len(words), -30, 30))))


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _code(found: tuple[int, ...]) -> int:
    """A pattern of votes as one number."""
    code = 0
    for vote in found:
        code = 3 * code + vote + 1
    return code


def _pattern(code: int) -> tuple[int, ...]:
    found = []
    for _ in range(LABELLERS):
        code, digit = divmod(code, 3)
        found.append(digit - 1)
    return tuple(reversed(found))


def with_votes(documents: DataFrame) -> DataFrame:
    """doc_id, text and the pattern of votes on it (a number)."""

    def vote(batches):
        for batch in batches:
            for some in slices(batch):
                codes = [_code(votes(text)) for text in some["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([some["doc_id"], some["text"], pa.array(codes, pa.int32())], ["doc_id", "text", "pattern"])

    return _texts(documents).mapInArrow(vote, "doc_id long, text string, pattern int")


def vote_patterns(voted: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Patterns, how often each occurs, and the number of documents; summed by Spark."""
    rows = sorted((_pattern(row["pattern"]), row["n"]) for row in voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect())
    patterns = np.array([row[0] for row in rows], np.int64).reshape(-1, LABELLERS)
    counts = np.array([row[1] for row in rows], float)
    return patterns, counts, int(counts.sum())


def train(voted: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[LabelModel, Scorer]:
    """The label model of all documents (with their votes), and the scorer fitted to at most `sample` of them.

    The sample is drawn by a hash of id and text, so rows of one id pass or fail each
    by itself, and the first rows by that hash are taken whatever the files' layout,
    until they hold `sample_bytes` of text.
    """
    patterns, counts, total = vote_patterns(voted)
    if not total:
        return LabelModel(0.5, np.full((2, LABELLERS, 3), 1 / 3)), Scorer(np.zeros(BUCKETS), 0.0)
    model = LabelModel.fit(patterns, counts)
    order = F.xxhash64("doc_id", "text")
    place = F.pmod(order, F.lit(1 << 30))
    drawn = voted.where(place < int((1 << 30) * min(1.0, 1.1 * (sample + 100) / total)) if total > sample else F.lit(True))
    # sizes first, so that the texts that come to the driver are bounded
    sized = drawn.select(place.alias("place"), order.alias("order"), F.octet_length("text").alias("bytes"))
    sizes = sized.orderBy("place", "order").limit(sample).collect()
    held = np.cumsum([row["bytes"] or 0 for row in sizes])
    fitting = int(np.searchsorted(held, sample_bytes, "right"))
    texts, codes = [], []
    if fitting:
        last = sizes[fitting - 1]
        until = (place < last["place"]) | ((place == last["place"]) & (order <= last["order"]))
        for row in drawn.where(until).select("text", "pattern").orderBy(place, order, "text").limit(fitting).toLocalIterator():
            texts.append(row["text"] or "")
            codes.append(row["pattern"])
    if not texts:
        return model, Scorer(np.zeros(BUCKETS), 0.0)
    targets = model.posterior(np.array([_pattern(code) for code in codes], np.int64))
    return model, Scorer.fit(texts, targets)


def classify(documents: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, posterior of the label model, probability by the scorer, keep.

    The votes are written beside the texts, so that every labeller looks at a text once.
    """
    voted = materialize(with_votes(documents), "votes")
    model, scorer = train(voted, sample)

    def score(batches):
        for batch in batches:
            for some in slices(batch):
                posterior = model.posterior(np.array([_pattern(code) for code in some["pattern"].to_pylist()], np.int64))
                probability = np.array([scorer(text) for text in some["text"].to_pylist()])
                arrays = [some["doc_id"], pa.array(posterior), pa.array(probability), pa.array(probability >= threshold)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "posterior", "probability", "keep"])

    return voted.mapInArrow(score, "doc_id long, posterior double, probability double, keep boolean")


def keep_good(documents: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the scorer finds good, all columns."""
    _, scorer = train(materialize(with_votes(documents), "votes"), sample)

    def keep(batches):
        for batch in batches:
            for some in slices(batch):
                yield some.filter(pa.array([scorer(text) >= threshold for text in some["text"].to_pylist()], pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
