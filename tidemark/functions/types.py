"""What each sink can hold, as a cast of every column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

FILE_TYPES = ("csv", "json", "avro", "parquet")
SINK_TYPES = FILE_TYPES + ("open_table",)

_INTERVALS = (T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType)


class UnsupportedTypes(ValueError):
    """Raised with one line per column the sink cannot hold."""


def target_type(data_type: T.DataType, sink: str) -> T.DataType:
    """The type a value takes in a sink; ValueError when it has none."""
    if isinstance(data_type, (T.NullType, T.TimeType, T.CharType, T.VarcharType)):
        return T.StringType()
    if isinstance(data_type, T.VariantType):
        return T.StringType()
    if isinstance(data_type, _INTERVALS):
        if sink == "open_table" or isinstance(data_type, T.CalendarIntervalType):
            raise ValueError("intervals have no type in this sink")
        return T.StringType() if sink in ("csv", "json") else data_type
    if isinstance(data_type, T.BinaryType):
        return T.StringType() if sink == "csv" else data_type
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType)) and sink == "csv":
        return T.StringType()
    if isinstance(data_type, T.StructType):
        return T.StructType(
            [T.StructField(f.name, target_type(f.dataType, sink), True) for f in data_type]
        )
    if isinstance(data_type, T.ArrayType):
        return T.ArrayType(target_type(data_type.elementType, sink), True)
    if isinstance(data_type, T.MapType):
        if sink == "avro" and not isinstance(data_type.keyType, T.StringType):
            raise ValueError("map keys must be strings in this sink")
        return T.MapType(
            target_type(data_type.keyType, sink), target_type(data_type.valueType, sink), True
        )
    return data_type


def _same(left: T.DataType, right: T.DataType) -> bool:
    return left.simpleString() == right.simpleString()


def _convert(value: Column, source: T.DataType, sink: str) -> Column:
    target = target_type(source, sink)
    if _same(source, target):
        return value
    if isinstance(source, T.VariantType):
        return F.to_json(value)
    if isinstance(source, T.BinaryType):
        return F.base64(value)
    if isinstance(target, T.StringType):
        if isinstance(source, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(value)
        return value.cast(target)
    if isinstance(source, T.ArrayType):
        return F.transform(value, lambda item: _convert(item, source.elementType, sink))
    if isinstance(source, T.MapType):
        changed = F.transform_values(value, lambda _, item: _convert(item, source.valueType, sink))
        return changed.cast(target)
    fields = [_convert(value.getField(f.name), f.dataType, sink).alias(f.name) for f in source]
    return F.when(value.isNotNull(), F.struct(*fields))


def conform(df: DataFrame, sink: str) -> DataFrame:
    """One projection that gives every column a type the sink can hold."""
    if sink not in SINK_TYPES:
        raise ValueError(f"unknown sink {sink!r}")
    refused, columns = [], []
    for field in df.schema:
        try:
            value = F.col(f"`{field.name}`")
            columns.append(_convert(value, field.dataType, sink).alias(field.name))
        except ValueError as problem:
            refused.append(f"{field.name} {field.dataType.simpleString()}: {problem}")
    if refused:
        raise UnsupportedTypes(f"{sink} cannot hold " + "; ".join(refused))
    return df.select(*columns)
