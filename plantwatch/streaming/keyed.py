"""The last rows of every key as keyed state, for frames over a stream.

A micro-batch reads and writes the state of its own keys only, and state of keys that stay silent expires. The processor handles text
alone: a row travels as JSON, its place in the order as a text that sorts the same, its features as a list of numbers in text. No
number passes through pandas, so nulls, NaN and large integers come back as they were.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PAST = "place string, features string"
MADE = "_row string, _frame array<string>, _late boolean"
SENT = ("_row", "_place", "_features", "_identity")  # after the keys
CHUNK = 5000


def _as_text(name: str, kind: T.DataType) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.base64(column)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column)
    return column.cast("string")


def _from_text(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(column.cast("bigint"))
    if isinstance(kind, T.BinaryType):
        return F.unbase64(column)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.from_json(column, kind)
    return column.cast(kind)


def place_text(schema: T.StructType, order: Sequence[str]) -> Column:
    """A text that sorts as the order columns do, nulls first: 16 hexadecimal digits for each."""
    parts = []
    for name in order:
        column, kind = F.col(f"`{name}`"), schema[name].dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            number = F.unix_micros(column.cast("timestamp"))
        elif isinstance(kind, T.DateType):
            number = F.unix_date(column).cast("bigint")
        elif isinstance(kind, T.IntegralType):
            number = column.cast("bigint")
        else:
            raise TypeError(f"order columns must be whole numbers, dates or timestamps: {name}")
        # With the sign bit turned, the digits of a negative number sort before those of a positive one.
        digits = F.lpad(F.hex(number.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
        parts.append(F.coalesce(digits, F.lit(" " * 16)))
    return F.concat(*parts)


class LastRows(StatefulProcessor):
    """Frames of the last `size` rows of a key, itself included; late rows get none and leave the state alone."""

    def __init__(self, size: int, ttl_ms: int | None):
        self.size, self.ttl_ms = size, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getListState("past", PAST, self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.past.get()]
        batch = pd.concat(list(rows))
        batch = batch.set_axis([*range(batch.shape[1] - len(SENT)), *SENT], axis=1)  # the names that columns come with differ by version
        batch = batch.drop_duplicates("_identity").sort_values("_place", kind="stable")
        late = batch["_place"] <= held[-1][0] if held else pd.Series(False, index=batch.index)
        fresh = batch[~late]
        known = [x for _, x in held] + fresh["_features"].tolist()
        frames = [known[max(0, end - self.size) : end] for end in range(len(held) + 1, len(known) + 1)]
        passed = batch[late]
        if len(passed):
            yield pd.DataFrame({"_row": passed["_row"], "_frame": [None] * len(passed), "_late": True})
        for k in range(0, len(fresh), CHUNK):
            part = fresh["_row"].iloc[k : k + CHUNK]
            yield pd.DataFrame({"_row": part, "_frame": frames[k : k + CHUNK], "_late": False})
        if len(fresh):
            every = held + list(zip(fresh["_place"], fresh["_features"], strict=True))
            # At least one row, which tells what is late.
            self.past.put(every[-max(1, self.size - 1) :])

    def close(self) -> None:
        pass


def keyed_frames(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], features: Sequence[str], size: int, identity: Sequence[str], ttl_ms: int | None = None
) -> DataFrame:
    """The rows with `frame`, the features of the last `size` rows of their key, fewer while it warms up, and `_late`.

    Rows that are not newer than what earlier batches brought of their key are late and have no frame. Rows of a batch that agree in
    `identity` count once. The rows of one key in one micro-batch are held together, so the trigger bounds them. State of a key that
    brings nothing for `ttl_ms` expires.
    """
    schema = stream.schema
    row = F.to_json(F.struct(*[_as_text(f.name, f.dataType).alias(f"c{i}") for i, f in enumerate(schema.fields)]))
    numbers = [F.coalesce(F.col(f"`{f}`").cast("double").cast("string"), F.lit("")) for f in features]
    same = F.to_json(F.struct(*[_as_text(c, schema[c].dataType).alias(f"c{i}") for i, c in enumerate(identity)]))
    sent = stream.select(
        *[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)], row.alias("_row"), place_text(schema, order).alias("_place"),
        F.concat_ws(",", *numbers).alias("_features"), same.alias("_identity"),
    )
    grouped = sent.groupBy(*[f"_key{i}" for i in range(len(keys))])
    mode = "ProcessingTime" if ttl_ms else "None"
    made = grouped.transformWithStateInPandas(LastRows(size, ttl_ms), MADE, "Append", mode)
    text = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(schema.fields))])
    parsed = made.withColumn("_c", F.from_json("_row", text))
    columns = [_from_text(F.col(f"_c.c{i}"), f.dataType).alias(f.name) for i, f in enumerate(schema.fields)]
    number = lambda x: F.when(x != "", x).cast("double")
    frame = F.transform("_frame", lambda r: F.transform(F.split(r, ","), number))
    return parsed.select(*columns, frame.alias("frame"), F.col("_late"))
