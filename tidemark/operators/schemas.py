"""Schema union: new fields join at the end, existing ones stay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T


class SchemaConflict(ValueError):
    """Two batches give one field different types."""


def merge_schemas(old: T.StructType | None, new: T.StructType) -> T.StructType:
    """The old fields in place, followed by the fields only `new` has."""
    if old is None:
        return new
    known = {field.name: field.dataType for field in old}
    clashes = [
        f"{f.name}: {known[f.name].simpleString()} and {f.dataType.simpleString()}"
        for f in new
        if f.name in known and known[f.name].simpleString() != f.dataType.simpleString()
    ]
    if clashes:
        raise SchemaConflict("; ".join(clashes))
    return T.StructType(old.fields + [f for f in new if f.name not in known])


def fit(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of `schema` in order, null where the frame lacks one."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema
        ]
    )


def union_batches(*batches: DataFrame) -> DataFrame:
    """One table from batches whose fields may differ; conflicting types are refused."""
    reduce(lambda schema, df: merge_schemas(schema, df.schema), batches, None)
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), batches)
