"""Change rows: normalising a change feed, marking snapshots, row bookmarks."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

CHANGE_TYPE = "_change_type"
COMMIT_TIME = "_commit_timestamp"

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def bookmark_literal(bookmark: datetime) -> Column:
    """A bookmark as a timestamp in whole seconds; naive values count as UTC."""
    if bookmark.tzinfo is None:
        bookmark = bookmark.replace(tzinfo=timezone.utc)
    seconds = (bookmark - EPOCH).total_seconds()
    return F.timestamp_seconds(F.lit(int(seconds)))


def as_inserts(snapshot: DataFrame, bookmark: datetime = EPOCH) -> DataFrame:
    """A snapshot as change rows: every row an insert at the bookmark."""
    return snapshot.withColumns({CHANGE_TYPE: F.lit("insert"), COMMIT_TIME: bookmark_literal(bookmark)})


def normalise(changes: DataFrame, bookmark: datetime = EPOCH) -> DataFrame:
    """Drop preimages, call postimages updates and stamp the commit time.

    A commit time that came with the rows is kept; the bookmark fills in where
    there is none.
    """
    stamp = bookmark_literal(bookmark)
    if COMMIT_TIME in changes.columns:
        stamp = F.coalesce(F.col(COMMIT_TIME).cast("timestamp"), stamp)
    kind = F.replace(F.col(CHANGE_TYPE), F.lit("update_postimage"), F.lit("update"))
    return changes.where(F.col(CHANGE_TYPE) != "update_preimage").withColumns(
        {CHANGE_TYPE: kind, COMMIT_TIME: stamp}
    )


def newer_than(rows: DataFrame, column: str, bookmark: datetime) -> DataFrame:
    """Rows strictly after the bookmark; the comparison reaches the scan."""
    kind = rows.schema[column].dataType
    naive = bookmark.astimezone(timezone.utc).replace(tzinfo=None) if bookmark.tzinfo else bookmark
    return rows.where(F.col(column) > F.lit(naive.isoformat(sep=" ")).cast(kind))


def next_bookmark(rows: DataFrame, column: str) -> DataFrame:
    """The bookmark after these rows, as a one-row table."""
    return rows.agg(F.max(column).alias("bookmark"))
