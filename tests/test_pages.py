from helpers import rows
from hypothesis import HealthCheck, given, settings, strategies as st

from tidemark.operators import pages as P


def test_cut_pages(spark):
    pages = spark.createDataFrame(
        [("a", 0, 5), ("a", 1, 5), ("a", 2, 3), ("a", 3, 5), ("b", 0, 0), ("b", 1, 5), ("c", 0, 5), ("c", 1, 5), ("c", 2, 5)],
        "endpoint string, page bigint, records int",
    )
    cut = P.cut_pages(pages, pages, 5, 2)
    assert rows(cut, "endpoint", "page") == [("a", 0), ("a", 1), ("b", 0), ("c", 0), ("c", 1)]
    cut = P.cut_pages(pages, pages, 5, 100)
    assert rows(cut, "endpoint", "page") == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", 0), ("c", 1), ("c", 2)]
    cut = P.cut_pages(pages, pages, 5, 100, start=1)
    assert ("a", 0) not in rows(cut, "endpoint", "page")


def walk(links, page_size, limit):
    """What a caller sees who asks page after page."""
    seen = []
    by_key = {(e, c): (n, r) for e, c, n, r in links}
    for endpoint in sorted({link[0] for link in links}):
        cursor, step = None, 0
        while step < limit and (endpoint, cursor) in by_key:
            seen.append((endpoint, cursor, step))
            following, records = by_key[endpoint, cursor]
            step += 1
            if following is None or records < page_size:
                break
            cursor = following
    return sorted(seen, key=repr)


SCHEMA = "endpoint string, cursor string, next_cursor string, records int"


def test_follow_cursors(spark):
    links = [("a", None, "1", 3), ("a", "1", "2", 3), ("a", "2", None, 1), ("a", "9", "1", 3)]
    links += [("b", None, "x", 2), ("b", "x", None, 3)]  # short first page
    links += [("c", None, "gone", 3)]  # next page was never stored
    links += [("d", None, "p", 3), ("d", "p", "q", 3), ("d", "q", "p", 3)]  # a loop
    df = spark.createDataFrame(links, SCHEMA)
    for limit in (1, 2, 3, 7, 8):
        got = rows(P.follow_cursors(df, 3, limit), "endpoint", "cursor", "step")
        assert got == walk(links, 3, limit), limit


def test_follow_a_long_chain(spark):
    links = [("a", None if n == 0 else str(n), str(n + 1), 3) for n in range(150)]
    df = spark.createDataFrame(links, SCHEMA)
    assert len(rows(P.follow_cursors(df, 3, 100))) == 100
    assert len(rows(P.follow_cursors(df, 3, 1000))) == 150


chains = st.dictionaries(
    st.tuples(st.sampled_from("ab"), st.sampled_from([None, "1", "2", "3", "4"])),
    st.tuples(st.sampled_from([None, "1", "2", "3", "4"]), st.integers(1, 3)),
    min_size=1,
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(chains, st.integers(1, 6))
def test_follow_cursors_like_a_caller(spark, chain, limit):
    links = [(e, c, n, r) for (e, c), (n, r) in chain.items()]
    got = rows(P.follow_cursors(spark.createDataFrame(links, SCHEMA), 2, limit), "endpoint", "cursor", "step")
    assert got == walk(links, 2, limit)
