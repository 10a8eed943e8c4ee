"""Token files and packing: exact round trips, and the plan against a lower bound."""

import os
import random
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import binary, packing, queries
from tidemark.llm.shared import filesystem
from tidemark.llm.tokens import Encoder, encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
AWKWARD = [(5, None), (3, ""), (9, "  two  blanks\n\nand lines \n"), (1, "a " * 9000 + "end"), (7, "tab\there"), (None, "no id"), (2, "same"), (2, "same")]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: array("I", tokenizer.encode(text or "", add_special_tokens=False).ids).tobytes()


def test_ids_are_those_of_whole_texts(plain, given):
    texts = [text for (text,) in given("SELECT text FROM documents LIMIT 200")]
    assert Encoder(PATH)(texts) == list(map(plain, texts))
    rng = random.Random(3)
    signs = "ab'sZé .,!\n\t\r  \xa0 1२³²½ß漢字ا😀_-<|endoftext|>\x0b\x1c​̈µª"
    odd = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    assert Encoder(PATH, limit=50)(odd[:100] + [None]) == [*map(plain, odd[:100]), b""]
    assert Encoder(PATH)(odd) == list(map(plain, odd))


def test_token_files_hold_every_document(llm, sf, given, plain):
    want, at = {}, 0
    for doc_id, text in given("SELECT doc_id, text FROM documents ORDER BY doc_id"):
        ids = plain(text) + b"\0\0\0\0"
        want[doc_id] = (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert {row[0]: tuple(row[1:]) for row in queries.op7_token_files(llm, sf).collect()} == want


def test_token_files_of_awkward_rows(llm, documents, plain, folder):
    manifest = binary.write_token_files(documents(AWKWARD), PATH, folder, frame_ids=64)
    rows = binary.read_token_files(manifest, folder).orderBy("start").collect()
    order = sorted(AWKWARD, key=lambda row: (row[0] is not None, row[0] or 0, row[1] or ""))
    assert [(row.doc_id, bytes(row.ids)) for row in rows] == [(d, plain(t) + b"\0\0\0\0") for d, t in order]
    assert [row.start for row in rows] == np.cumsum([0, *(row.n_tokens for row in rows[:-1])]).tolist()
    picked = binary.read_token_files(manifest, folder, [3, 9]).collect()
    assert sorted(row.doc_id for row in picked) == [3, 9]
    assert binary.write_and_read(documents([]), PATH).collect() == []


def test_only_asked_frames_are_read_and_damage_is_noticed(folder):
    fs, root = filesystem(folder)
    path = f"{root}/one.ids.zst"
    with fs.open_output_stream(path, compression=None) as sink:
        writer = binary.TokenFileWriter(sink, frame_ids=16)
        for k in range(40):
            writer.add(k, array("I", range(k)).tobytes())
        writer.close()
    with fs.open_input_file(path) as source:
        file = binary.TokenFile(source)
        read, real = [], file.frame
        file.frame = lambda number: read.append(number) or real(number)
        assert dict(file.documents([0, 20])) == {0: b"", 20: array("I", range(20)).tobytes()}
        assert len(read) <= 2 < len(file.sums)
    data = bytearray(open(path, "rb").read())
    data[12] ^= 1
    open(path, "wb").write(bytes(data))
    with fs.open_input_file(path) as source, pytest.raises(Exception):  # noqa: B017, PT011 - by zstandard or by the checksum
        list(binary.TokenFile(source).documents())


def check_packing(rows, texts, capacity):
    """Every id of every document lies in one place of a gapless sequence."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for row in rows:
        pieces[row.doc_id].append(row)
        sequences[row.sequence_id].append((row.offset, row.length))
    assert set(pieces) == set(texts)
    for doc_id, ids in texts.items():
        at = 0
        for k, row in enumerate(sorted(pieces[doc_id], key=lambda row: row.piece)):
            assert (row.piece, row.start) == (k, at)
            assert row.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + row.length)])
            assert k == 0 or row.length == capacity
            at += row.length
        assert at == len(ids) // 4
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_packing_of_all_documents(llm, sf, given, plain):
    texts = {doc_id: plain(text) + b"\0\0\0\0" for doc_id, text in given("SELECT doc_id, text FROM documents")}
    used = check_packing(queries.op5_best_fit_packing(llm, sf).collect(), texts, 2048)
    assert used <= 1.005 * -(-sum(map(len, texts.values())) // (4 * 2048)) + 1


def test_packing_of_awkward_rows(documents, plain):
    rows = packing.pack(documents([row for row in AWKWARD if row[0] != 2]), PATH, capacity=64).collect()
    check_packing(rows, {d: plain(t) + b"\0\0\0\0" for d, t in AWKWARD if d != 2}, 64)
    assert len(packing.pack(documents(AWKWARD), PATH).where("doc_id = 2").collect()) == 2
    assert packing.pack(documents([]), PATH).collect() == []


@pytest.mark.parametrize("kind", ["spread", "few", "halves", "large"])
def test_plan_holds_all_in_few_sequences(kind):
    rng = np.random.default_rng(4)
    lengths = {
        "spread": np.minimum(2048, np.exp(rng.normal(6, 1, 30_000)).astype(int) + 1),
        "few": rng.choice([300, 700, 1100], 5000),
        "halves": rng.choice([1024, 1025, 3], 4000),
        "large": rng.integers(1500, 2049, 3000),
    }[kind]
    counts = np.bincount(lengths, minlength=2049)
    plan = packing.plan_sequences(counts)
    held = Counter()
    for shape, times in plan:
        assert sum(length * n for length, n in shape) <= 2048
        for length, n in shape:
            held[length] += n * times
    assert held == Counter({int(k): int(counts[k]) for k in np.flatnonzero(counts)})
    used = sum(times for _, times in plan)
    greedy = sum(packing.best_fit(Counter(lengths.tolist()), 2048).values())
    assert used <= 1.005 * greedy + 1


def test_named_tokens_are_those_of_the_library_as_it_is(documents):
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["end <|endoftext|> next", "a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> x\ny", "<|endoftext| >", "end of text"]
    want = [array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes() for text in texts]
    assert Encoder(PATH)(texts) == want
    rows = binary.write_and_read(documents(list(enumerate(texts))), PATH).orderBy("doc_id").collect()
    assert [bytes(row.ids) for row in rows] == [ids + b"\0\0\0\0" for ids in want]


def test_a_worker_keeps_its_encoder_between_tasks(llm):
    def ask(batches):
        for batch in batches:
            kept = encoder(PATH)
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([not hasattr(kept, "asked")])], ["worker", "new"])
            kept.asked = True

    asked = llm.range(0, 64, 1, 64).mapInArrow(ask, "worker long, new boolean").collect()
    assert len(asked) == 64
    assert sum(row.new for row in asked) <= len({row.worker for row in asked}) < 64


def test_pieces_met_again_outlive_those_met_once(plain):
    kept = Encoder(PATH, limit=40)
    for start in range(0, 400, 20):
        texts = ["the often, often " + " ".join(f"w{'x' * k}" for k in range(start, start + 20)), "z" * 5000 + " " + "z" * 5000]
        assert kept(texts) == list(map(plain, texts))
        assert "often," in kept.after_blank or "often," in kept.after_blank.older
        for pieces in kept.kept:
            assert len(pieces) <= 20 and len(pieces.older) <= 60
            assert max(map(len, [*pieces, *pieces.older]), default=0) <= 100


def test_plain_words_go_to_the_model_unsplit(plain):
    kept = Encoder(PATH)
    words = ["plain", "Größe", "ÿÀ", "don't", "end.\u4e00", "x-y_z", "a" * 300, "é" * 200, "naïve!?", "µ", "x2"]
    text = " ".join(words) + "\n" + "\n".join(words)
    asked = []
    split, kept.whole = kept.whole, lambda piece: asked.append(piece) or split(piece)
    assert kept([text]) == [plain(text)]
    assert not {"plain", " plain", "Größe", " Größe", "a" * 300}.intersection(asked)
