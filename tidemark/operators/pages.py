"""Page sequences: where they end, and how cursors link them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark import storage


def last_pages(counts: DataFrame, page_size: int) -> DataFrame:
    """The first short page of each endpoint as `last_page`.

    A partial aggregation: a hot endpoint shrinks to one row per task before
    the shuffle.
    """
    short = counts.where(F.col("records") < page_size)
    return short.groupBy("endpoint").agg(F.min("page").alias("last_page"))


def cut_pages(pages: DataFrame, counts: DataFrame, page_size: int, max_requests: int, start: int = 0) -> DataFrame:
    """Keep pages up to and including the first short one, within the request limit.

    `counts` has `endpoint, page, records`, counted after field selection. The
    ends are written first, so the join below plans with their true size.
    """
    ends = storage.materialize(last_pages(counts, page_size), "page-ends")
    return keep_pages(pages, ends, max_requests, start)


def keep_pages(pages: DataFrame, ends: DataFrame, max_requests: int, start: int = 0) -> DataFrame:
    """Pages within the request limit and not after their endpoint's `last_page`."""
    within = pages.where((F.col("page") >= start) & (F.col("page") < start + max_requests))
    joined = within.join(ends, "endpoint", "left")
    return joined.where(F.col("last_page").isNull() | (F.col("page") <= F.col("last_page"))).drop("last_page")


def follow_cursors(links: DataFrame, page_size: int, max_requests: int = 100) -> DataFrame:
    """The pages a cursor walk visits, as `endpoint, cursor, step`.

    `links` has `endpoint`, `cursor` (the token the page was requested with,
    null for the first page), `next_cursor` and `records`. A walk stops at a
    page without a next cursor, at a short page, and after `max_requests`
    pages. Jump tables are doubled, so the number of joins grows with the
    logarithm of the limit, and all endpoints advance together. Only keys
    travel; join the bodies to the result afterwards.
    """
    if max_requests < 1:
        raise ValueError("max_requests must be at least 1")
    keys = storage.materialize(links.select("endpoint", "cursor", "next_cursor", "records"), "cursor-links")
    walkable = F.col("next_cursor").isNotNull() & (F.col("records") >= page_size)
    jumps = keys.where(walkable).select("endpoint", F.col("cursor").alias("here"), F.col("next_cursor").alias("there"))
    known = keys.select("endpoint", F.col("cursor").alias("page_cursor"))
    reached = known.where("page_cursor is null").select(
        "endpoint", F.col("page_cursor").alias("cursor"), F.lit(0).cast("bigint").alias("step")
    )
    span = 1
    while span < max_requests:
        walk, jump = reached.alias("w"), jumps.alias("j")
        ahead = (
            walk.join(jump, (F.col("w.endpoint") == F.col("j.endpoint")) & F.col("w.cursor").eqNullSafe(F.col("j.here")))
            .select(F.col("w.endpoint"), F.col("j.there").alias("cursor"), (F.col("w.step") + span).alias("step"))
            .where(F.col("step") < max_requests)
        )
        new = storage.materialize(ahead, "cursor-steps")
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
        span *= 2
        if span < max_requests:
            left, right = jumps.alias("a"), jumps.alias("b")
            doubled = left.join(
                right, (F.col("a.endpoint") == F.col("b.endpoint")) & (F.col("a.there") == F.col("b.here"))
            ).select("a.endpoint", "a.here", "b.there")
            jumps = storage.materialize(doubled, "cursor-jumps")
    # a cursor that leads to no stored page ends the walk there
    stored = F.col("w.endpoint") == F.col("k.endpoint")
    stored &= F.col("w.cursor").eqNullSafe(F.col("k.page_cursor"))
    return reached.alias("w").join(known.alias("k"), stored, "left_semi")
