"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone.

A text becomes a template: words in lower case, numbers, units after numbers and
names (capitalised words, wherever they stand) as typed slots. It is read in forms:

- `names`: all slots are open, so a question with other names and numbers agrees;
- `numbers`: names are plain words, so a copy in other case or layout agrees;
- `exact`: all are plain words, for items that have no window with enough plain
  words in the form `numbers` (they must be met word by word).

1. documents and items give their windows of `window` words at every place, in each
   form; those of items with at least `literals` plain words meet documents in a
   hash join, so any shared run that holds such a window is met, wherever it stands;
2. the documents found are opened again, and windows that agree are counted by
   document, item, form and span: a shift between their places, and also all shifts
   that lie within 2 * window - 2 places (a slot may take more words than one);
3. at the shifts found, all windows are compared, those with few plain words too, and
   slots at agreeing places: a value of the item must always stand against the same
   value of the document and the other way round. Values may differ as a whole (the
   same question with other numbers), not among themselves.

A document and an item match if a span holds at least `share` of all windows of the
item with consistent slots, one of them with `literals` plain words. Items of fewer
than 2 * window - 1 words have too few windows to be judged by a share: they match
where a document holds them word by word, as one window, in any case and layout. A
copy whose names are changed as well as written small is not known as one: nothing
tells its names from words.

Spark broadcasts the benchmark's windows, or the documents found, only where it has
measured a written table to be small; else it shuffles.

Defined cases: null or empty texts hold nothing; rows that repeat a doc_id or item_id
are judged each by its own text, the best match counts; a null doc_id or item_id is
not reported; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import materialize

WINDOW = 5
LITERALS = 3
SHARE = 0.5

#: Slots are marked by one character, their value follows.
NUMBER, UNIT, NAME = "\x01", "\x02", "\x03"
FORMS = ("names", "numbers", "exact")

#: What counts as a unit after a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l gal s sec min h hr ms percent usd eur gbp dollars dollar euros euro pounds pound cents cent "
    "seconds second minutes minute hours hour days day weeks week months month years year meters meter metres metre kilometers kilometres miles "
    "mile inches inch feet foot grams gram kilograms kilogram liters litres degrees mph kmh kph kw w v a hz mb gb tb"
).split()


def marked(text: Column) -> Column:
    """The words of a text parted by blanks, slots with their mark and value."""
    unit = "|".join(UNITS)

    def replaced(held: Column, *steps: tuple[str, str]) -> Column:
        for pattern, by in steps:
            held = F.regexp_replace(held, F.lit(pattern), F.lit(by))
        return held

    # the steps on numbers are for texts that hold a digit
    digits = text.rlike(r"\p{N}")
    # decimal and thousands separators stay inside their number
    text = F.when(digits, replaced(text, (r"[.,:/](?<=\p{N}.)(?=\p{N})", "_"), (r"%(?<=\p{N}%)", " percent"))).otherwise(text)
    # a word that begins with a capital and goes on with a small letter is a name
    text = replaced(text, (r"\p{Lu}(?<![\p{L}\p{M}\p{N}_].)(?=\p{Ll})", f"{NAME}$0"))
    text = replaced(F.lower(text), (r"[^\p{L}\p{M}\p{N}_\x01-\x03]+", " "))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    numbers = (
        # a unit may touch its number
        (rf"( \p{{N}}[\p{{N}}_]*)({unit}) ", "$1 $2 "),
        (r" (?=\p{N}[\p{N}_]* )", f" {NUMBER}"),
        (rf"({NUMBER}[^ ]+) {NAME}?({unit})(?= )", f"$1 {UNIT}$2"),
    )
    return F.trim(F.when(digits, replaced(text, *numbers)).otherwise(text))


def words_of(text: Column, form: str) -> Column:
    """The words of a marked text in a form, open slots without their values."""
    if form == "names":
        text = F.regexp_replace(text, F.lit(r"([\x01-\x03])[^ ]*"), F.lit("$1"))
    elif form == "numbers":
        text = F.translate(F.regexp_replace(text, F.lit(r"([\x01\x02])[^ ]*"), F.lit("$1")), NAME, "")
    else:
        text = F.translate(text, NUMBER + UNIT + NAME, "")
    return F.split(text, " ")


def _in_form(text: Column, form: Column) -> Column:
    """As `words_of`, for a form that is a column."""
    words = words_of(text, FORMS[-1])
    for known in FORMS[:-1]:
        words = F.when(form == known, words_of(text, known)).otherwise(words)
    return words


def _places(words: Column, window: int) -> Column:
    return F.when(F.size(words) >= window, F.sequence(F.lit(1), F.size(words) - window + 1)).otherwise(F.array().cast("array<int>"))


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def word_hashes(words: Column, form: str) -> Column:
    """The hash of every word of a marked text (as an array) in a form."""
    kept = {"names": "", "numbers": NAME, "exact": NUMBER + UNIT + NAME}[form]

    def slot(word: Column) -> Column:
        mark = F.substring(word, 1, 1)
        return F.when(F.lit(kept).contains(mark), F.xxhash64(F.substring(word, 2, 1 << 30))).otherwise(F.xxhash64(mark))

    return F.transform(words, lambda word: F.when(word >= "\x04", F.xxhash64(word)).otherwise(slot(word)))


def window_hashes(hashes: Column, window: int) -> Column:
    """The hash of the window at every place, from those of its words: windows are doubled by pairing."""

    def behind(held: Column, by: int) -> Column:
        return F.slice(held, by + 1, F.greatest(F.size(held) - by, F.lit(0)))

    def built(words: Column) -> Column:
        held, size = words, 1
        for bit in f"{window:b}"[1:]:
            held = _let(held, lambda h: F.zip_with(h, behind(h, size), lambda a, b: F.xxhash64(a, b)))  # noqa: B023
            size *= 2
            if bit == "1":
                held = F.zip_with(held, behind(words, size), lambda a, b: F.xxhash64(b, a))
                size += 1
        # the last places have no whole window
        return F.slice(held, 1, F.greatest(F.size(words) - window + 1, F.lit(0)))

    return _let(hashes, built)


def _hashes(words: Column, form: str, window: int) -> Column:
    return window_hashes(word_hashes(words, form), window)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id, item_body and item_text (marked) of the items that hold a word, each text once."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id is not null and text is not null")
    items = items.select("item_id", F.xxhash64("text").alias("item_body"), marked(F.col("text")).alias("item_text"))
    return items.where("item_text <> ''").dropDuplicates(["item_id", "item_body"])


def benchmark_windows(items: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """item_id, item_body, form, windows and rich windows of the item, item_place and hash of every rich window."""
    long_enough = items.where(F.size(F.split("item_text", " ")) >= 2 * window - 1)
    held = long_enough.select("item_id", "item_body", F.explode(F.array(*map(F.lit, FORMS))).alias("form"), "item_text")
    hashed = reduce(
        lambda found, form: F.when(F.col("form") == form, _hashes(F.split("item_text", " "), form, window)).otherwise(found), FORMS, F.lit(None)
    )
    held = held.select("item_id", "item_body", "form", _in_form(F.col("item_text"), F.col("form")).alias("words"), hashed.alias("hashes"))
    plain = lambda words: F.size(F.filter(words, lambda word: word >= "\x04"))
    rich = F.filter(_places(F.col("words"), window), lambda place: plain(F.slice("words", place, window)) >= literals)
    held = held.withColumn("places", rich).withColumns({"rich": F.size("places"), "windows": F.size("words") - window + 1})
    told = held.where("form = 'numbers' and rich > 0").select("item_id", "item_body", F.lit("exact").alias("form"))
    held = held.join(told, ["item_id", "item_body", "form"], "left_anti")
    opened = held.select("item_id", "item_body", "form", "windows", "rich", "hashes", F.explode("places").alias("item_place"))
    return opened.withColumn("hash", F.get("hashes", F.col("item_place") - 1)).drop("hashes")


def short_items(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, item_words (plain, between blanks), length and hash of the items too short for windows: they are met as a whole."""
    words = F.split("item_text", " ")
    held = items.where(F.size(words) < 2 * window - 1).withColumn("length", F.size(words))
    hashed = F.lit(None)
    for length in range(1, 2 * window - 1):
        hashed = F.when(F.col("length") == length, _hashes(words, "exact", length)[0]).otherwise(hashed)
    plain = F.translate("item_text", NUMBER + UNIT + NAME, "")
    return held.select("item_id", F.concat(F.lit(" "), plain, F.lit(" ")).alias("item_words"), "length", hashed.alias("hash"))


def candidates(documents: DataFrame, hashes: DataFrame, reads: list[tuple[str, int]]) -> DataFrame:
    """doc_id of the documents that hold a window of the benchmark at any place, read in forms and window sizes."""
    # an outer explode and no condition on the words: Spark would compute them once more for a filter
    words = documents.select("doc_id", F.split(marked(F.col("text")), " ").alias("words"))
    forms = sorted({form for form, _ in reads})
    words = words.select("doc_id", *(word_hashes(F.col("words"), form).alias(form) for form in forms))
    windows = [window_hashes(F.col(form), window) for form, window in reads]
    opened = words.select("doc_id", F.explode_outer(F.concat(*windows)).alias("hash"))
    return opened.join(hashes, "hash", "left_semi").select("doc_id").distinct()


def short_matches(held: DataFrame, short: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id, item_id and the first place of the short items that documents (marked, as `doc_text`) hold word by word."""
    plain = F.concat(F.lit(" "), F.translate("doc_text", NUMBER + UNIT + NAME, ""), F.lit(" "))
    hashes = word_hashes(F.split("doc_text", " "), "exact")
    opened = held.select("doc_id", plain.alias("doc_words"), F.explode(F.array_distinct(F.concat(*(window_hashes(hashes, n) for n in lengths)))).alias("hash"))
    met = opened.join(short, "hash").where(F.col("doc_words").contains(F.col("item_words")))
    before = F.expr("substring(doc_words, 1, instr(doc_words, item_words))")
    start = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))
    return met.groupBy("doc_id", "item_id").agg(F.min(start).cast("long").alias("start"))


def _spans(table: DataFrame, window: int) -> DataFrame:
    """Each row under its shift, and under two overlapping ranges of shifts."""
    wide = F.floor(F.col("shift") / (window - 1)).cast("long")
    spans = [F.struct(F.lit(False).alias("wide"), F.col("shift").cast("long").alias("at"))]
    spans += [F.struct(F.lit(True).alias("wide"), (wide + k).alias("at")) for k in (0, 1)]
    return table.withColumn("span", F.explode(F.array(*spans)))


def _aligned(shifts: DataFrame, texts: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """The item places of agreeing windows and the slots (item_value, doc_value) in them, for every shift."""
    both = shifts.join(texts, ["doc_id", "body"]).join(items, ["item_id", "item_body"])
    kept = [*shifts.columns]
    both = both.withColumns({name: _in_form(F.col(text), F.col("form")) for name, text in (("item_words", "item_text"), ("doc_words", "doc_text"))})
    both = both.withColumns({"item_values": F.split("item_text", " "), "doc_values": F.split("doc_text", " "), "first": F.greatest(F.lit(1), 1 - F.col("shift"))})
    length = F.least(F.size("item_words") - F.col("first"), F.size("doc_words") - F.col("first") - F.col("shift")) + 1
    part = {name: F.slice(name, F.col("first") + (F.col("shift") if name[0] == "d" else 0), length) for name in ("item_words", "doc_words", "item_values", "doc_values")}
    both = both.select(*kept, "first", *(column.alias(name) for name, column in part.items()))
    agreeing = lambda place: F.slice("item_words", place, window) == F.slice("doc_words", place, window)
    both = both.withColumn("hits", F.filter(_places(F.col("item_words"), window), agreeing))
    pairs = F.arrays_zip(F.col("item_words").alias("word"), F.col("item_values").alias("item_value"), F.col("doc_values").alias("doc_value"))
    both = both.withColumn("pairs", pairs)
    pairs = F.array_distinct(F.flatten(F.transform("hits", lambda place: F.slice("pairs", place, window))))
    slots = F.filter(pairs, lambda pair: (pair["word"] >= NUMBER) & (pair["word"] < "\x04"))
    return both.select(*kept, F.transform("hits", lambda place: place + F.col("first") - 1).alias("item_places"), slots.alias("slots"))


def matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, matched and all windows of the item, place in the document, slots and changed slots of every match."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where("doc_id is not null and text is not null")
    items = materialize(benchmark_items(benchmark), "benchmark-items")
    indexed = materialize(benchmark_windows(items, window, literals), "benchmark-windows")
    short = materialize(short_items(items, window), "benchmark-short-items")
    hashes = materialize(indexed.select("hash").union(short.select("hash")).distinct(), "benchmark-hashes")
    forms = [form for form in FORMS if form != "exact" or indexed.where("form = 'exact'").head(1)]
    lengths = sorted(row["length"] for row in short.select("length").distinct().collect())
    found = materialize(candidates(texts, hashes, [(form, window) for form in forms] + [("exact", n) for n in lengths]), "candidates")

    # each row of a candidate keeps a number of its own, so repeated ids don't mix their places
    held = texts.join(found, "doc_id", "left_semi").select("doc_id", F.xxhash64("text").alias("body"), marked(F.col("text")).alias("doc_text"))
    held = materialize(held, "candidate-texts")
    words = held.select("doc_id", "body", F.split("doc_text", " ").alias("words"))
    opened = words.select("doc_id", "body", F.explode(F.array(*(F.struct(F.lit(form).alias("form"), _hashes(F.col("words"), form, window).alias("hashes")) for form in forms))).alias("read"))
    opened = opened.select("doc_id", "body", "read.form", F.posexplode("read.hashes").alias("at", "hash"))
    agreeing = opened.join(indexed, ["form", "hash"]).withColumn("shift", F.col("at") + 1 - F.col("item_place"))
    shift = ["doc_id", "body", "item_id", "item_body", "form", "shift"]
    agreeing = materialize(agreeing.select(*shift, "windows", "rich", "item_place").distinct(), "agreeing-windows")
    run = [*shift[:-1], "span"]

    # with all windows of few plain words, a run must reach the share
    runs = _spans(agreeing, window).groupBy(*run, "windows", "rich").agg(F.countDistinct("item_place").alias("met"))
    needed = F.ceil(F.lit(share) * F.col("windows"))
    runs = materialize(runs.where(F.col("met") + F.col("windows") - F.col("rich") >= needed).select(*run, "windows"), "runs")
    shifts = _spans(agreeing.select(*shift).distinct(), window).join(runs, run, "left_semi").select(*shift).distinct()
    aligned = materialize(_aligned(shifts, held, items, window), "aligned")

    spanned = _spans(aligned, window).join(runs, run)
    matched = spanned.select(*run, "windows", "shift", F.explode("item_places").alias("item_place"))
    matched = matched.groupBy(*run, "windows").agg(F.countDistinct("item_place").alias("matched"), F.min(F.col("item_place") + F.col("shift")).alias("start"))
    matched = matched.where(F.col("matched") >= needed)
    slots = spanned.select(*run, F.explode("slots").alias("slot")).select(*run, "slot.item_value", "slot.doc_value").distinct()
    checked = slots.groupBy(*run).agg(
        F.count(F.lit(1)).alias("slots"),
        F.countDistinct("item_value").alias("item_values"),
        F.countDistinct("doc_value").alias("doc_values"),
        F.count_if(F.col("item_value") != F.col("doc_value")).alias("changed"),
    )
    judged = matched.join(checked, run, "left").na.fill(0, ["slots", "item_values", "doc_values", "changed"])
    judged = judged.where("slots = item_values and slots = doc_values")
    order = F.struct("matched", -F.col("start"), "slots", -F.col("changed"), "windows", "body")
    best = judged.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("matched", "windows", "start", "slots", "changed"), order).alias("best"))
    best = best.select("doc_id", "item_id", "best.matched", "best.windows", F.col("best.start").cast("long").alias("start"), "best.slots", "best.changed")
    if not lengths:
        return best
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    whole = short_matches(held, short, lengths).select("doc_id", "item_id", one.alias("matched"), one.cast("int").alias("windows"), "start", none.alias("slots"), none.alias("changed"))
    # rows that repeat an item_id may hold a long text and a short one
    return best.unionByName(whole.join(best.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that match no item, all columns; those with a null doc_id stay."""
    gone = materialize(matches(documents, benchmark, **options).select(F.col("doc_id").alias("__leaked")).distinct(), "leaks")
    return documents.join(gone, documents["doc_id"].cast("long") == gone["__leaked"], "left_anti")
