"""Top-k search, archives and page texts."""

import hashlib
import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_text, queries, topk, warc
from tidemark.llm.trees import Boosted, Forest

# -- search ----------------------------------------------------------------------------------------------------------


def test_search_matches_sql(llm, sf, given):
    got = queries.op6_exact_topk(llm, sf).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(given(queries.ORACLES["op6_exact_topk"]))


def brute_search(vectors, k=5):
    usable = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in usable:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, a in asked.items():
        scored = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i) for i, v in usable if i != q and len(v) == len(a))[:k]
        out += [(q, rank, i, -score) for rank, (score, i) in enumerate(scored, 1)]
    return sorted(out)


def test_search_of_awkward_rows(llm, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(k, rng.integers(-2, 3, 3).astype(float).tolist()) for k in range(160)]
    rows += [(50, [9.0, 9.0, 9.0]), (7, rows[7][1]), (200, None), (201, []), (250, [1.0, None, 2.0]), (251, [float("nan")] * 3), (252, [float("inf")] * 3), (None, [1.0] * 3), (300, [1.0, 2.0]), (301, [3.0, 4.0])]
    frame = llm.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, numbers int, block string")
    for sizes in ({}, {"BLOCK": 2, "TILE": 1, "COLUMNS": 40, "COLUMN_ROWS": 4, "FAN_IN": 2}):
        for name, value in sizes.items():
            monkeypatch.setattr(topk, name, value)
        assert sorted(map(tuple, topk.search(frame, F.col("vec_id") % 50 == 0).collect())) == brute_search(rows)
    assert topk.search(frame.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_products_are_whole_and_checked():
    big = np.array([[1 << 30, 3]], np.int64)
    assert topk.products(big, big).tolist() == [[(1 << 60) + 9]]
    with pytest.raises(OverflowError):
        topk.products(big << 3, big << 3)


# -- archives --------------------------------------------------------------------------------------------------------

PAGES = [(1, "u", "x" * 200), (2, "u", "x" * 200), (3, None, None), (4, "a", "x" * 50), (5, "b\r\nX: y", "x" * 50), (None, "c", "x" * 200), (0, "é", "é" * 60), (9, "é", "é" * 60), (11, "WARC", "WARC/1.1\r\n\r\n" * 20_000)]


def make_pages(llm, rows):
    return llm.createDataFrame([(*row, "x", 1) for row in rows], "page_id long, url string, html string, digest string, first long")


def test_archives_hold_every_page(llm, sf, given):
    got = queries.op1_warc(llm, sf).collect()
    assert sorted(map(tuple, got)) == sorted(given(queries.ORACLES["op1_warc"]))


def test_archives_of_awkward_rows(llm, folder):
    warc.write_pages(make_pages(llm, PAGES), folder)
    rows = warc.read_pages(llm, folder, "bytes").collect()
    assert len(rows) == len(PAGES)
    texts = dict((i, t or "") for i, _, t in PAGES)
    refers = {2: 1, 9: 0}
    for row in rows:
        body = texts[row.page_id].encode()
        assert (row.payload_bytes, row.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert row.refers_to == refers.get(row.page_id)
        assert row.record_type == ("revisit" if row.page_id in refers else "response")
        assert row.payload == (None if row.page_id in refers else body)
    assert warc.archive_and_read(make_pages(llm, [])).collect() == []


def test_header_filters_reach_the_reader(llm, folder):
    warc.write_pages(make_pages(llm, PAGES), folder)
    reader = warc.WarcReader(folder, "none")
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 3)]))
    assert left == [warc.EqualTo(("payload_bytes",), 3)]
    found = [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    assert {row["record_id"] for row in found} == {"urn:page:2", "urn:page:9"}
    assert all(row["payload"] is None for row in found)
    frame = warc.register(llm).read.format("warc").load(folder)
    assert frame.where("record_type = 'revisit'").count() == 2
    assert frame.where("record_id IN ('urn:page:3', 'urn:page:4')").count() == 2
    assert frame.where("target_uri IS NULL").count() == 1


def test_damaged_payloads_are_noticed(llm, folder):
    data = warc.record(1, "u", b"abc" * 50, hashlib.sha256(b"else").hexdigest(), None)
    with open(f"{folder}/x.warc.gz", "wb") as file:
        file.write(warc.member(data))
    with pytest.raises(Exception, match="digest"):
        warc.read_pages(llm, folder).collect()


# -- page texts ------------------------------------------------------------------------------------------------------


def article(page):
    """The article of the given pages, which mark it, by plain text operations."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", block.replace("<br>", " ")))).strip() for block in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(block for block in blocks if block)


def test_texts_of_the_given_pages(llm, sf, given):
    got = {row.page_id: row for row in queries.op8_html_extraction(llm, sf).collect()}
    rows = given("SELECT page_id, url, html FROM pages")
    assert len(got) == len(rows)
    assert all(got[i].url == url and got[i].text == article(page) for i, url, page in rows)
    assert all(row.n_chars == len(row.text) for row in got.values())


@pytest.fixture(scope="module")
def model(given):
    return html_text.train([page for (page,) in given("SELECT html FROM pages ORDER BY page_id LIMIT 80")])


def test_texts_in_layouts_without_marks(given, model):
    texts = [article(page).split("\n")[:8] for (page,) in given("SELECT html FROM pages ORDER BY page_id DESC LIMIT 60")]
    pool = [sentence for blocks in texts for block in blocks for sentence in block.split(". ")]
    rng = np.random.default_rng(23)
    right = 0
    for blocks in texts:
        page = html_text.relaid(blocks, pool, rng).replace(" data-main=1", "")
        right += html_text.extract(page, model) == "\n".join(blocks)
    assert right >= 0.9 * len(texts)


def test_awkward_pages(llm, model):
    long = "Plain words of a long paragraph, with commas and an end. " * 6
    page = f"<body><nav><a href=x>Menu</a></nav><article><h1>A &amp; B&nbsp;&lt;</h1><p>{long}<p>one\n two<br>three <b>bold<script>no()</script><p hidden></p>{long}</article><footer>Foot</footer>"
    text = html_text.extract(page, model)
    assert text.split("\n") == ["A & B <", long.strip(), "one two three bold", long.strip()]
    for odd in (None, "", "<", "<<<>>>", "</p></div>", "<p", "<!--", "<script>", "a" * 100_000, "<div>" * 3000, "<a href='" * 50):
        assert isinstance(html_text.extract(odd, model), str)
    rows = [(1, "u", None), (None, None, page), (2, "u", page), (2, "u", page)]
    got = html_text.main_text(make_pages(llm, rows)).collect()
    assert sorted((row.page_id or 0, row.n_chars) for row in got) == [(0, len(text)), (1, 0), (2, len(text)), (2, len(text))]
    assert html_text.main_text(make_pages(llm, [])).collect() == []


def test_pages_with_open_heads_drawings_and_formulas(model):
    long = "Plain words of a long paragraph, with commas and an end. " * 6
    body = f"<article><h1>Top</h1><p>{long}</p><p>{long}</p></article><footer>Foot</footer>"
    want = ["Top", long.strip(), long.strip()]
    for page in (
        f"<html><head><title>x</title><meta charset=utf-8><body>{body}", f"<head><title>x</title>{body}", f"<head><body class=x>{body}",
        f"<head><style>b</style><link rel=x></head><body>{body}", f"<body>{body}".replace("<h1>", "<svg width='1'/><h1>"),
        body.replace("<h1>", "<svg><svg/><svg><path/></svg> gone </svg><h1>"), body.replace("<p>", "<math/><p>", 1),
    ):
        assert html_text.extract(page, model).split("\n") == want, page
    formula = "<math display='inline'><mi>x</mi><mspace/><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math>"
    assert html_text.extract(body.replace("<p>", f"<p>As {formula}, so: ", 1), model).split("\n") == ["Top", f"As x=12, so: {long.strip()}", long.strip()]
    root = html_text.parse("<head>Loose text")
    assert html_text.render(root, {id(node): True for node in html_text.nodes(root)}) == "Loose text"


def test_siblings_count_without_limit(llm):
    found = html_text.nodes(html_text.parse("<div>" + "".join(f"<p>{'x' * k}</p>" for k in range(1, 101)) + "</div>"))
    rows = html_text.features(found)
    at = html_text._OWN + 6
    assert set(rows[2:, at].tolist()) == {100}
    assert np.allclose(rows[2:, at + 1], [np.log1p((5050 - k) / 99) for k in range(1, 101)])
    words = "Plain words of a long paragraph, with commas and an end. " * 80
    page = f"<body><nav><a href=x>Menu</a></nav><article>{f'<p>{words}</p>' * 50}</article><footer>Foot</footer>"
    got = html_text.main_text(make_pages(llm, [(1, "u", page), (2, "u", None)])).collect()
    assert len(page) > 200_000
    assert {row.page_id: row.text for row in got} == {1: "\n".join([words.strip()] * 50), 2: ""}


def test_decoding_is_consistent(model):
    root = html_text.parse("<div><p>aaaaaaaaaa</p><div><p>bbbbbbbbbb</p><p>cccccccccc</p></div></div>")
    found = html_text.nodes(root)
    kept = html_text.decode(found, np.array([0, 0, 5.0, -4.0, -4.0, -4.0]), cost=1.0)
    assert kept == [False, False, True, False, False, False]
    assert html_text.decode(found, np.array([0, 0, 5.0, -4.0, 0.1, -0.1]), cost=50.0) == [True] * 6


# -- trees -----------------------------------------------------------------------------------------------------------


def test_trees_learn_rules():
    rng = np.random.default_rng(3)
    rows = rng.random((2000, 5))
    targets = ((rows[:, 0] > 0.5) ^ (rows[:, 3] > 0.3)).astype(float)
    fresh = rng.random((500, 5))
    want = (fresh[:, 0] > 0.5) ^ (fresh[:, 3] > 0.3)
    assert ((Boosted.fit(rows, targets)(fresh) > 0) == want).mean() > 0.95
    assert ((Forest.fit(rows, targets)(fresh) > 0.5) == want).mean() > 0.9
