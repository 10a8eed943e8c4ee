"""Quality rules as weak supervision, in DataFrame functions alone.

Rules on a text's statistics don't have to pass all: each votes for or against the
text or abstains.

1. Statistics of every whole text are taken in its row, without a shuffle: words and
   their hashes are arrays, windows of eight words get their hash from three rounds
   of pairing (2, 4, 8), windows that come again are found by sorting the hashes.
2. The votes of all documents are counted by pattern (at most 3 ** rules rows).
   Expectation-maximisation on these counts estimates how often each rule votes how
   on good and on bad documents, and the share of good ones.
3. The posterior of a document is then a sum of one weight for each vote. It is kept
   if two base conditions hold (`min_words`, `max_repeated` per cent of its words in
   windows that come again) and the posterior reaches `threshold`.

The statistics are written once to the shared folder (some numbers a document); the
counts and the verdicts read them from there.

Defined cases: a null or empty text has no words, so its base fails; a null doc_id
takes part like others; rows that repeat a doc_id are judged each by its own text and
count as often as they are there; an empty table gives no rows; other columns are
ignored. Windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import materialize

MIN_WORDS = 20
#: Per cent of words in windows of eight that come again, at most.
MAX_REPEATED = 30
THRESHOLD = 0.5

#: Common function words of four languages.
FUNCTION_WORDS = (
    "the of and to in a is that it was for on are as with be by this at from or an not have which but "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es er so wie "
    "le la les de et un une du en que qui dans est pour pas sur au avec ce il ne se par plus sont "
    "el los las y del una por con para como su al lo más pero sus ya o este sí porque no"
).split()

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _next(items: Column, by: int) -> Column:
    return F.slice(items, by + 1, F.greatest(F.size(items) - by, F.lit(0)))


def _paired(hashes: Column, by: int) -> Column:
    """Hashes of each place together with that `by` on; the last `by` of them mean nothing."""
    return _let(hashes, lambda held: F.zip_with(held, _next(held, by), lambda a, b: F.xxhash64(a, b)))


def _covered(windows: Column, size: int) -> Column:
    """Words in windows (their hashes by place) that stand twice or more."""

    def by_hash(ordered: Column) -> Column:
        again = lambda one, at: (F.get(ordered, at - 1)["hash"] == one["hash"]) | (F.get(ordered, at + 1)["hash"] == one["hash"])
        return F.filter(ordered, lambda one, at: F.coalesce(again(one, at), F.lit(False)))

    def words(places: Column) -> Column:
        steps = F.zip_with(places, _next(places, 1), lambda here, there: F.coalesce(F.least(there - here, F.lit(size)), F.lit(size)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    ordered = F.sort_array(F.transform(windows, lambda h, at: F.struct(h.alias("hash"), at.alias("at"))))
    places = _let(ordered, lambda held: F.sort_array(F.transform(by_hash(held), lambda one: one["at"])))
    # most texts repeat no window: the sort is for the others
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _let(places, words)).otherwise(0)


def measure(documents: DataFrame) -> DataFrame:
    """doc_id, the statistics of the contract, and further ones that rules look at."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    held = held.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    held = held.withColumns({
        "hashes": F.transform("words", lambda w: F.xxhash64(w)),
        "lines": F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
    })
    n = F.size("words").cast("long")
    windows = _paired(_paired(_paired(F.col("hashes"), 1), 2), 4)
    held = held.select(
        "doc_id",
        n.alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 8, _let(F.slice(windows, 1, F.greatest(F.size("words") - 7, F.lit(0))), lambda w: _covered(w, 8))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("hashes")).alias("n_distinct"),
        F.size(F.filter("hashes", lambda h, at: F.coalesce(h == F.get(F.col("hashes"), at + 1), F.lit(False)))).alias("n_again"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(FUNCTION_WORDS))).alias("n_function"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_capital"),
        F.regexp_count("text", F.lit(r"[^\p{L}\p{M}\p{N}\x09-\x0D .,;:'\"()?@/_+=-]")).alias("n_odd"),
    )
    return held


def votes(measured: DataFrame) -> DataFrame:
    """The statistics with one column `vote_<rule>` for each rule: 1 for good, -1 for bad, 0 for none.

    A text of fewer than eight words gets votes on its characters only.
    """
    n = F.greatest(F.col("n_words"), F.lit(1))
    long_enough = F.col("n_words") >= 8
    share = lambda name: F.col(name) / n
    # distinct words of running prose fall with its length
    variety = share("n_distinct") / F.least(F.lit(1.0), 1.6 * F.pow(n, F.lit(-0.18)))
    length = F.col("word_chars") / n

    def vote(good, bad, asked=long_enough) -> Column:
        choice = F.when(~asked, 0)
        choice = choice.when(bad, -1)
        return (choice.when(good, 1) if good is not None else choice).otherwise(0)

    rules = {
        "symbols": vote(None, share("n_symbols") > 0.1, F.lit(True)),
        "odd": vote(None, share("n_odd") > 0.35),
        "capitals": vote(None, F.col("n_capital") > 0.3 * F.col("word_chars")),
        "variety": vote(None, variety < 0.45),
        "again": vote(None, share("n_again") > 0.1),
        "function": vote(share("n_function") > 0.12, share("n_function") < 0.04),
        "length": vote((length >= 3) & (length <= 7), (length > 8.5) | (length < 2)),
        "repeated": vote(None, share("n_repeat_words") > 0.25),
        "lines": vote(None, F.col("n_dup_lines") > 0.3 * F.col("n_lines"), F.col("n_lines") >= 3),
    }
    return measured.withColumns({f"vote_{name}": column for name, column in rules.items()})


def rule_names(voted: DataFrame) -> list[str]:
    return [name for name in voted.columns if name.startswith("vote_")]


class Model:
    """How rules vote on good and on bad documents, and the share of good ones."""

    def __init__(self, rules: list[str], share: float, tables: list[list[list[float]]]):
        #: tables[kind][rule][vote + 1], kind 0 bad and 1 good
        self.rules, self.share, self.tables = rules, share, tables

    @classmethod
    def fit(cls, rules: list[str], patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> Model:
        """Expectation-maximisation over (votes, documents) from the majority's opinion on (no vote: rather good)."""
        belief = [1 / (1 + math.exp(-1.5 * (sum(pattern) + 1))) for pattern, _ in patterns]
        model = cls(rules, 0.5, [])
        for _ in range(rounds):
            model = cls._maximised(rules, patterns, belief)
            new = [model.posterior(pattern) for pattern, _ in patterns]
            moved = max((abs(a - b) for a, b in zip(new, belief, strict=True)), default=0.0)
            belief = new
            if moved < 1e-6:
                break
        return model

    @classmethod
    def _maximised(cls, rules, patterns, belief) -> Model:
        # some votes of prior keep unseen ones possible
        seen = [[[[2.0, 1.0, 0.5], [0.5, 1.0, 2.0]][kind][:] for _ in rules] for kind in (0, 1)]
        weight = [1.0, 1.0]
        for (pattern, n), good in zip(patterns, belief, strict=True):
            for kind, part in ((0, n * (1 - good)), (1, n * good)):
                weight[kind] += part
                for rule, vote in enumerate(pattern):
                    seen[kind][rule][vote + 1] += part
        tables = [[[count / sum(row) for count in row] for row in kind] for kind in seen]
        for bad, good in zip(*tables, strict=True):
            # abstaining says the same of either kind
            bad[1] = good[1] = (bad[1] + good[1]) / 2
        tables = [[[count / sum(row) for count in row] for row in kind] for kind in tables]
        return cls(rules, weight[1] / sum(weight), tables)

    def weights(self) -> list[list[float]]:
        """The log odds that a vote (-1, 0, 1) of each rule adds."""
        bad, good = self.tables
        return [[math.log(g) - math.log(b) for b, g in zip(*rows, strict=True)] for rows in zip(bad, good, strict=True)]

    def odds(self, pattern: tuple[int, ...]) -> float:
        return math.log(self.share) - math.log(1 - self.share) + sum(w[v + 1] for w, v in zip(self.weights(), pattern, strict=True))

    def posterior(self, pattern: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.odds(pattern)))))

    def accuracies(self) -> dict[str, float]:
        """Share of right votes of each rule among its votes."""
        out = {}
        for name, bad, good in zip(self.rules, *self.tables, strict=True):
            right = (1 - self.share) * bad[0] + self.share * good[2]
            out[name] = right / (right + (1 - self.share) * bad[2] + self.share * good[0])
        return out

    def column(self) -> Column:
        """The posterior as an expression on the vote columns."""
        parts = [F.lit(math.log(self.share) - math.log(1 - self.share))]
        for name, (against, none, approving) in zip(self.rules, self.weights(), strict=True):
            parts.append(F.when(F.col(name) < 0, against).when(F.col(name) > 0, approving).otherwise(none))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(add, parts)))


def fit(voted: DataFrame) -> Model:
    """The model of all documents; only the counts of vote patterns reach the driver."""
    rules = rule_names(voted)
    counted = voted.groupBy(*rules).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = sorted((tuple(row[name] for name in rules), row["n"]) for row in counted)
    return Model.fit(rules, patterns) if patterns else Model(rules, 0.5, [[[1 / 3] * 3 for _ in rules] for _ in (0, 1)])


def judge(
    documents: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED
) -> DataFrame:
    """doc_id, the statistics, votes, base_failed, posterior and kept of every document."""
    voted = votes(materialize(measure(documents), "text-statistics"))
    model = fit(voted)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    judged = voted.withColumns({"base_failed": failed, "posterior": model.column()})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
