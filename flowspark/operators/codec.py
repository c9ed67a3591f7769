"""Payload strings to columns and back."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark import schemas

# Fixed value: layout of the scoring time stamp.
DATE_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def parse_fields(df: DataFrame, schema: T.StructType, value: str = "value", keep=()) -> DataFrame:
    """Split a delimited payload and take its fields by position.

    Fields past the end, and fields that do not parse, become null. A number written as a decimal
    ("64.0") is accepted for an integer column.
    """
    parts = df.select(*keep, F.split(F.col(value), ",", -1).alias("_fields"))

    def field(i, f):
        text = F.get("_fields", F.lit(i))
        if isinstance(f.dataType, T.StringType):
            return text.alias(f.name)
        # An empty field is null at once: a cast of it to double would throw and catch an exception in every row.
        number = F.nullif(F.trim(text), F.lit(""))
        if isinstance(f.dataType, T.DoubleType):
            return number.try_cast("double").alias(f.name)
        whole = F.coalesce(
            number.try_cast(f.dataType), number.try_cast("double").try_cast(f.dataType)
        )
        return whole.alias(f.name)

    return parts.select(*keep, *[field(i, f) for i, f in enumerate(schema.fields)])


def parse_flow_payload(df: DataFrame, value: str = "value", keep=()) -> DataFrame:
    """Statistics-flow messages to 46 columns; quotes are stripped, an empty label is null."""
    bare = df.withColumn(value, F.replace(F.col(value), F.lit('"'), F.lit("")))
    return parse_fields(bare, schemas.STATS_FLOW.schema, value, keep)


def parse_packet_payload(df: DataFrame, value: str = "value", keep=()) -> DataFrame:
    """Packet messages to 26 columns; an empty field is null."""
    return parse_fields(df, schemas.PACKET, value, keep)


def encode_flow_csv(df: DataFrame, columns=None, keep=()) -> DataFrame:
    """All columns as one comma-separated ``value``; nulls stay as empty fields."""
    columns = columns or df.columns
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.select(*keep, F.array_join(F.array(*text), ",").alias("value"))


def encode_flow_message(df: DataFrame, keep=()) -> DataFrame:
    """Statistics flows as live messages: quoted, with an empty label field."""
    names = [c for c in schemas.STATS_FLOW_COLUMNS if c != schemas.LABEL]
    return encode_flow_csv(df, names, keep).withColumn("value", F.concat(F.lit('"'), "value", F.lit(',"')))


def encode_prediction_json(df: DataFrame, columns=None) -> DataFrame:
    columns = columns or [*schemas.STATS_FLOW.key_cols, "date", "prediction"]
    return df.select(F.to_json(F.struct(*columns)).alias("value"))


def featurize(df: DataFrame, columns, output: str = "features", handle_invalid: str = "error") -> DataFrame:
    assembler = VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid=handle_invalid)
    return assembler.transform(df)


def featurize_stats(df: DataFrame, output: str = "features", handle_invalid: str = "error") -> DataFrame:
    """The 40 statistics columns as one vector."""
    return featurize(df, schemas.STATS_FLOW.feature_cols, output, handle_invalid)


def featurize_agg(df: DataFrame, output: str = "features", handle_invalid: str = "error") -> DataFrame:
    """The 24 aggregate columns as one vector."""
    return featurize(df, schemas.AGG_FLOW.feature_cols, output, handle_invalid)


def stamp_time(df: DataFrame, column: str = "date") -> DataFrame:
    """Add the scoring time as text: one value per query or micro-batch."""
    return df.withColumn(column, F.date_format(F.current_timestamp(), DATE_FORMAT))


def prediction_columns(df: DataFrame, with_key: bool = False, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction), or the document form with the 5-tuple and date in front."""
    front = [*schemas.STATS_FLOW.key_cols, "date"] if with_key else []
    return df.select(*front, label, prediction)
