"""The dialect's types and their Spark counterparts."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of types and what they mean.
ALIASES = {
    "BOOLEAN": "BOOLEAN", "BOOL": "BOOLEAN", "BIGINT": "BIGINT", "LONG": "BIGINT", "INT64": "BIGINT", "DOUBLE": "DOUBLE", "FLOAT64": "DOUBLE",
    "STRING": "STRING", "TEXT": "STRING", "VARCHAR": "STRING", "BYTES": "BYTES", "BINARY": "BYTES",
}
SPARK = {"BOOLEAN": T.BooleanType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "BYTES": T.BinaryType(), "TIMESTAMP": T.TimestampNTZType()}
NUMERIC = ("BIGINT", "DOUBLE")


def of_spark(kind: T.DataType) -> str | None:
    """The dialect's type of an imported column; TIMESTAMP is an extension, None is carried
    along but can't stand in an expression."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "BIGINT"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "DOUBLE"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP"
    return {T.BooleanType: "BOOLEAN", T.StringType: "STRING", T.BinaryType: "BYTES"}.get(type(kind))
