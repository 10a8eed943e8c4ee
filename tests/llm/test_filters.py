"""Quality classifier, secret scan, decontamination: held-out accuracy and brute force."""

import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import contamination, quality, queries, secrets

AWKWARD = [(1, None), (2, ""), (3, "word"), (3, "word"), (None, "no id here"), (4, "x " * 50_000)]


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.7
    right = [0.9, 0.8, 0.75, 0.7]
    votes = np.stack([np.where(rng.random(len(good)) < p, good, ~good) * 2 - 1 for p in right], axis=1)
    votes[rng.random(votes.shape) < 0.3] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.LabelModel.fit(patterns, counts.astype(float))
    assert np.allclose(model.accuracies(), right, atol=0.06)
    assert abs(model.share - 0.7) < 0.06


def test_classifier_agrees_with_held_out_labels(llm, sf, given):
    rows = {row.doc_id: row for row in queries.op3_quality_classifier(llm, sf).collect()}
    assert len(rows) == 1000
    labels = dict(given("SELECT doc_id, quality FROM labels"))
    kept = {q: np.mean([rows[d].keep for d, own in labels.items() if own == q]) for q in (0, 1)}
    assert kept[1] > 0.97
    assert kept[0] < 0.3


def test_classifier_on_awkward_rows(documents):
    df = documents(AWKWARD)
    rows = quality.classify(df).collect()
    assert sorted((row.doc_id or 0) for row in rows) == [0, 1, 2, 3, 3, 4]
    assert all(row.probability == 0 and not row.keep for row in rows if row.doc_id in (1, 2))
    assert quality.keep_good(df).columns == df.columns
    assert quality.classify(documents([])).collect() == []
    assert quality.keep_good(documents([])).collect() == []


def test_scan_finds_the_tokens_of_the_given_documents(llm, sf, given):
    want = {(d, m.start(1)) for d, t in given("SELECT doc_id, text FROM documents") for m in re.finditer(r'(?i)token = "([0-9a-f]{40})', t or "")}
    found = queries.op4_secret_scan(llm, sf).where("is_secret").collect()
    assert {(row.doc_id, row.start) for row in found} == want
    assert want


def test_scan_tells_made_findings_apart(given):
    texts = [text for (text,) in given("SELECT text FROM documents ORDER BY doc_id")]
    scanner = secrets.Scanner.train(texts[:400])
    rng = np.random.default_rng(17)
    held = [text.split() for text in texts[400:] if len(text.split()) >= 12]
    right = {True: [], False: []}
    for k in range(1000):
        before, value, after, path = secrets._made(rng, k % 2 == 0, held[int(rng.integers(len(held)))][:12])
        (found,) = scanner([before + value + after], [path])
        odds = max((o for c, o in found if c.end > len(before)), default=0.0)
        right[k % 2 == 0].append((odds >= 0.5) == (k % 2 == 0))
    assert np.mean(right[True]) > 0.95
    assert np.mean(right[False]) > 0.95


def test_scan_of_awkward_rows(documents):
    key = "A1b2C3d4E5f6A7b8C9d0"
    pairs = [*AWKWARD, (7, f'api_key = "{key}" and api_key = "{key}"'), (None, f'secret: "{key}"'), (8, "-----BEGIN PRIVATE KEY-----\nMIIabc123\n-----END PRIVATE KEY-----")]
    found = secrets.find(documents(pairs)).collect()
    assert {(row.doc_id, row.start) for row in found if row.is_secret} >= {(7, 11), (7, 48), (None, 9)}
    assert any(row.kind == "private key" for row in found)
    redacted = {row.doc_id: row.text for row in secrets.redact(documents(pairs)).collect()}
    assert redacted[7] == 'api_key = "[SECRET]" and api_key = "[SECRET]"'
    assert redacted[1] is None
    assert secrets.find(documents([])).collect() == []


# -- decontamination -------------------------------------------------------------------------------------------------

ITEM = "Alice buys 5 apples and Bob sells 7 pears, then Alice gives Bob 5 coins and leaves the market quickly today."
OTHER = "Carol buys 9 apples and Dave sells 4 pears, then Carol gives Dave 9 coins and leaves the market quickly today."
MIXED = "Carol buys 9 apples and Dave sells 4 pears, then Carol gives Dave 8 coins and leaves the market quickly today."


def items(llm, pairs):
    return llm.createDataFrame(pairs, "item_id long, text string, doc_id long, hash string")


def found(llm, documents, docs, benchmark):
    rows = contamination.matches(documents(docs), items(llm, [(*row, 1, "x") for row in benchmark])).collect()
    return {(row.doc_id, row.item_id): row for row in rows}


def test_parameters_may_change_as_a_whole_only(llm, documents):
    filler = "some more words of prose before it"
    docs = [(1, f"{filler}. {ITEM}"), (2, f"{filler}.\n{OTHER} {filler}"), (3, f"{filler}. {MIXED}"), (4, filler), (5, ITEM.upper()), (6, f"{filler} 12km. {OTHER}")]
    rows = found(llm, documents, docs, [(10, ITEM)])
    assert {key[0] for key in rows} == {1, 2, 5, 6}
    assert rows[1, 10].changed == 0
    assert rows[2, 10].changed == rows[2, 10].slots == 4


def test_awkward_rows(llm, documents):
    docs = [*AWKWARD, (7, ITEM), (7, ITEM), (7, "clean words only in this row"), (None, ITEM)]
    rows = found(llm, documents, docs, [(10, ITEM), (10, ITEM), (11, None), (12, ""), (13, "far too short"), (None, ITEM)])
    assert set(rows) == {(7, 10)}
    kept = contamination.decontaminate(documents(docs), items(llm, [(10, ITEM, 1, "x")]))
    assert sorted((row.doc_id or 0) for row in kept.collect()) == [0, 0, 1, 2, 3, 3, 4]
    assert kept.columns == documents([]).columns
    assert found(llm, documents, [], [(10, ITEM)]) == {}
    assert found(llm, documents, docs, []) == {}


def test_short_items_are_met_word_by_word(llm, documents):
    items_ = [(1, "Boil 3 eggs"), (2, "Who wrote Hamlet?"), (3, "How many legs has a spider?"), (4, "Name the largest city of the old world"), (5, "Ampersand")]
    prose = "so much was said before it was over and done with for good"
    docs = [(10 * n + k, f"{before}{text}{after}") for n, text in items_ for k, (before, after) in enumerate((("", ""), (f"{prose}. ", f" {prose}"), (f"{prose}\n", "")))]
    docs += [(90, "Boil 4 eggs and boil three eggs"), (91, "who wrote the old Hamlet"), (92, "ampersands"), (93, "WHO\nWROTE   HAMLET"), (94, None), (95, "the largest city of the old world, name")]
    rows = found(llm, documents, docs, items_)
    assert set(rows) == {(10 * n + k, n) for n, _ in items_ for k in range(3)} | {(93, 2)}
    assert rows[20, 2].start == 1 and rows[21, 2].start == 14


def test_windows_of_any_size_are_told_apart(llm):
    words = F.split(F.lit("a b c a b d a b c a b d e"), " ")
    for window in range(1, 12):
        hashes = llm.range(1).select(contamination._hashes(words, "exact", window)).first()[0]
        plain = "a b c a b d a b c a b d e".split()
        want = [tuple(plain[i : i + window]) for i in range(len(plain) - window + 1)]
        assert len(hashes) == len(want) and [hashes.index(h) for h in hashes] == [want.index(w) for w in want]


def brute_template(text):
    """The template of prose without numbers or units, by plain Python."""
    text = re.sub(r"(?<=[a-zà-ÿ,;] )([A-ZÀ-Ý])(?=[a-zà-ÿ])", "\x03\\1", text or "").lower()
    words = re.sub(r"[^\w\x03]+", " ", text).strip().split(" ")
    return [word[:1] if word[:1] == "\x03" else word for word in words]


def test_verbatim_passages_of_the_given_tables(llm, sf, given):
    got = {(row.doc_id, row.item_id) for row in queries.op2_benchmark_decontamination(llm, sf).collect()}
    plain = lambda text: " ".join(re.sub(r"\W+", " ", (text or "").lower()).split())
    bench = [(item, plain(text)) for item, text in given("SELECT item_id, text FROM benchmark")]
    want = {(doc, item) for doc, text in given("SELECT doc_id, text FROM documents") for held in [plain(text)] for item, words in bench if f" {words} " in f" {held} "}
    assert got == want
    assert want


def test_every_long_shared_run_is_found(llm, documents):
    """Against all windows of all texts, for runs cut at any place."""
    rng = np.random.default_rng(8)
    words = [f"{a}{b}{c}" for a in "bdkl" for b in "aeou" for c in "mnrst"]
    item = rng.choice(words, 24).tolist()
    docs = []
    for k in range(120):
        n = int(rng.integers(6, 25))
        at = int(rng.integers(0, 25 - n))
        docs.append((k, " ".join([*rng.choice(words, int(rng.integers(0, 9))), *item[at : at + n], *rng.choice(words, 7)])))
    rows = found(llm, documents, docs, [(1, " ".join(item))])
    windows = {tuple(item[i : i + 5]): i for i in range(20)}
    for doc, text in docs:
        held = brute_template(text)
        shifts = {}
        for at in range(len(held) - 4):
            if (i := windows.get(tuple(held[at : at + 5]))) is not None:
                shifts.setdefault(at - i, set()).add(i)
        matched = max(map(len, shifts.values()), default=0)
        assert ((doc, 1) in rows) == (matched >= 10), doc
        if matched >= 10:
            assert rows[doc, 1].matched == matched


NUMERIC = [
    "What is 15% of 240 kg plus 3.5 kg minus 12 kg?", "A box of 3 cm by 4 cm by 5 cm weighs 2 kg.",
    "A train travels 60 km in 2 h and then 90 km in 3 h. How far?", "12 + 7 * 3 - 4 / 2 = 31 and 5 * 5 = 25",
]


def test_numeric_items_are_found_at_every_offset(llm, documents):
    docs = [(10 * k + n, f"{'filler ' * n}{text} {'more ' * 3}") for k, text in enumerate(NUMERIC) for n in range(5)]
    clean = [(100, "A box of 3 cm stood here, and 7 7 7 7 7 7 7 7 7 7 7 7 was on it"), (101, NUMERIC[3].replace("31", "30").replace("12", "9").replace("4", "8"))]
    rows = found(llm, documents, docs + clean, list(enumerate(NUMERIC)))
    assert set(rows) == {(10 * k + n, k) for k in range(4) for n in range(5)}
    # the windows with few plain words are held against each other too
    wrong = NUMERIC[1].replace("4 cm", "9 kg").replace("2 kg", "6 cm")
    assert found(llm, documents, [(1, wrong)], [(1, NUMERIC[1])]) == {}


TOM = "Tom has 5 apples. Tom buys 3 more apples. Tom eats 2 apples. How many apples does Tom have now?"
NAMES = "then Alice met Bob near Paris while Carol drove to Rome, and Dave took Eve from Madrid to London before the long day was finally over"


def test_names_count_wherever_they_stand(llm, documents):
    lines = re.sub(r" (?=[A-Z])", "\n", NAMES)
    docs = [
        (1, TOM.replace("Tom", "Anna").replace("5", "9").replace("3", "6")), (2, NAMES.replace("Carol", "Carol Ann").replace("from", "far from")), (3, TOM.replace("apples. Tom", "apples.\nTom")), (4, TOM.upper()),
        (5, "He has many apples. How many apples does she have now?"), (6, NAMES.lower()), (7, lines), (8, NAMES.upper()), (9, lines.replace("Alice", "Zoe")), (10, NAMES.replace("Dave", "Bob")),
    ]
    rows = found(llm, documents, docs, [(10, TOM), (11, NAMES)])
    assert set(rows) >= {(1, 10), (2, 11), (3, 10), (4, 10), (6, 11), (7, 11), (8, 11), (9, 11)}
    assert {doc for doc, _ in rows} <= {1, 2, 3, 4, 6, 7, 8, 9, 10}
    assert rows[1, 10].matched == rows[1, 10].windows and rows[7, 11].changed == 0


def test_language_counts_whole_texts_of_all_documents(documents, monkeypatch):
    texts = ["plain words " * 600 + "zyxwvut qqjj", "zyxwvut Ünder 漢字漢字", None, "", *["plain"] * 40]
    monkeypatch.setattr(secrets, "HELD_WORDS", 3)
    language = secrets.language_of(documents([(None if k % 2 else k, text) for k, text in enumerate(texts)]))
    assert {"plain", "words", "zyxwvut"} <= language.words
    whole = secrets.Language.of([text for text in texts if text])
    assert language.words == whole.words and set(language.pairs) == set(whole.pairs) >= {"zy", "漢字"}
    assert secrets.train(documents([(k, text) for k, text in enumerate(texts)]), sample=1).language.words == language.words
    # what stands behind the first 512 characters counts
    plain = [secrets.features("ab1" * 200 + end, "key", "", "", "", language) for end in ("ab1" * 200, "zyxwvut" * 80)]
    assert plain[0][1] != plain[1][1] and plain[0][11:13] != plain[1][11:13]
