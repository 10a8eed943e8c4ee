"""The pipeline, stage by stage, against the operators' own brute-force results."""

import hashlib
import re

import public_tokenizers
from test_copies import brute_groups, brute_lines
from test_tokens import check_packing
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.storage import materialize


def test_stages(llm, sf, given):
    docs = corpus_pipeline.table(llm, sf, "documents")
    kept = {}
    before = given("SELECT doc_id, text FROM documents")
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = materialize(stage(llm, docs, sf), name)
        if name != "best_fit_packing":
            assert docs.columns == columns
            kept[name] = [(row.doc_id, row.text) for row in docs.select("doc_id", "text").collect()]
            assert docs.where("n_chars <> length(text)").count() == 0

    labels = dict(given("SELECT doc_id, quality FROM labels"))
    good = {doc_id for doc_id, _ in kept["quality_classifier"]}
    assert sum(q == 1 and d in good for d, q in labels.items()) > 0.97 * sum(labels.values())
    assert set(kept["quality_classifier"]) <= set(before)

    digest = lambda text: hashlib.sha256((text or "").encode()).hexdigest()
    by_lines = brute_lines(kept["quality_classifier"])
    assert {(d, digest(t)) for d, t in kept["line_dedup"]} == {(d, kept_digest) for d, _, _, kept_digest in by_lines}
    assert sum(gone for _, _, gone, _ in by_lines) > 0

    firsts = {d for d, _, component in brute_groups(kept["line_dedup"], 5, 80, 100) if d == component}
    assert {d for d, _ in kept["ngram_jaccard_join"]} == firsts

    plain = lambda text: " ".join(re.sub(r"\W+", " ", (text or "").lower()).split())
    bench = [plain(text) for (text,) in given("SELECT text FROM benchmark")]
    clean = {d for d, t in kept["ngram_jaccard_join"] if not any(f" {b} " in f" {plain(t)} " for b in bench)}
    left = {d for d, _ in kept["benchmark_decontamination"]}
    assert left <= clean
    assert len(clean - left) <= 0.01 * len(clean)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {d: b"".join(i.to_bytes(4, "little") for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in kept["benchmark_decontamination"]}
    check_packing(docs.collect(), texts, 2048)


def test_run_returns_the_last_stage(llm, sf):
    assert corpus_pipeline.run(llm, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
