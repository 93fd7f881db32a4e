"""Which readings a lake table may hold already: Bloom filters per equipment and day, in front of an exact anti join.

Every batch adds its identities to the filters of its days. A later batch asks the filters of the days it holds; only rows that they
do not rule out are looked up in the lake, and only in the days of such rows. A filter that fills up rules out less, never too much:
results stay exact, whatever the delay of a delivery. Identities are spread over shards, so one equipment is not one filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantwatch.schemas import BATCH, EQUIPMENT, EVENT_DAY
from plantwatch.sources import versions
from plantwatch.sources.sinks import with_day
from plantwatch.streaming.upserts import Upserts

SHARDS = 16
BITS = 1 << 17
PROBES = 7
KEYS = (EQUIPMENT, EVENT_DAY, "shard")
FILTER = f"{EQUIPMENT} string, {EVENT_DAY} date, shard int, bits binary"


def _positions(rows: pa.Table) -> np.ndarray:
    """The bits of every identity, by two hashes."""
    one, other = (rows[c].to_numpy().astype(np.uint64) for c in ("_h", "_g"))
    steps = np.arange(PROBES, dtype=np.uint64)[None, :]
    return ((one[:, None] + steps * (other[:, None] | np.uint64(1))) % np.uint64(BITS)).astype(np.int64)


def _row(key: tuple, bits: np.ndarray) -> pa.Table:
    schema = pa.schema([(EQUIPMENT, pa.string()), (EVENT_DAY, pa.date32()), ("shard", pa.int32()), ("bits", pa.binary())])
    values = [*[k.as_py() if hasattr(k, "as_py") else k for k in key], np.packbits(bits).tobytes()]
    return pa.table([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def _made(key: tuple, rows: pa.Table) -> pa.Table:
    bits = np.zeros(BITS, dtype=bool)
    bits[_positions(rows).ravel()] = True
    return _row(key, bits)


def _united(key: tuple, rows: pa.Table) -> pa.Table:
    bits = np.zeros(BITS // 8, dtype=np.uint8)
    for part in rows["bits"]:
        bits |= np.frombuffer(part.as_py(), np.uint8)
    return _row(key, np.unpackbits(bits).astype(bool))


def _asked(key: tuple, rows: pa.Table, filters: pa.Table) -> pa.Table:
    maybe = np.zeros(rows.num_rows, dtype=bool)
    at = _positions(rows)
    for part in filters["bits"]:
        maybe |= np.unpackbits(np.frombuffer(part.as_py(), np.uint8)).astype(bool)[at].all(axis=1)
    return rows.append_column("_maybe", pa.array(maybe)).select(["_h", "_g", "_maybe"])


def filters_at(path: str) -> Upserts:
    """The filters of the table at `path`, beside it."""
    return Upserts(f"{path.rstrip('/')}_seen", KEYS, lambda rows: rows.groupBy(*KEYS).applyInArrow(_united, FILTER))


def _named(batch: DataFrame, identity: Sequence[str]) -> DataFrame:
    """The rows with their day, two hashes of their identity, and its shard."""
    names = [F.col(c) for c in identity]
    hashes = {"_h": F.xxhash64(*names), "_g": F.xxhash64(F.lit(1), *reversed(names))}
    return with_day(batch).withColumns(hashes).withColumn("shard", F.pmod("_h", F.lit(SHARDS)).cast("int"))


def possible_repeats(named: DataFrame, filters: DataFrame) -> DataFrame:
    """(_h, _g) of the rows that the filters do not rule out."""
    asked = named.select(F.coalesce(EQUIPMENT, F.lit("")).alias(EQUIPMENT), EVENT_DAY, "shard", "_h", "_g")
    left, right = asked.groupBy(*KEYS), filters.groupBy(*KEYS)
    return left.cogroup(right).applyInArrow(_asked, "_h bigint, _g bigint, _maybe boolean").where("_maybe").select("_h", "_g").distinct()


def unseen_rows(batch: DataFrame, path: str, batch_id: int, identity: Sequence[str]) -> DataFrame:
    """The rows of a micro-batch that no earlier batch wrote to the table at `path`, each once, however late they are.

    The table is one of `write_lake_batches`; its filters lie beside it and learn the batch's identities here. Days are read only if
    a filter cannot rule a row out. A repeated batch does not see what it wrote itself. The batch is read more than once.
    """
    spark = batch.sparkSession
    once = _named(batch.dropDuplicates(list(identity)), identity)
    index = filters_at(path)
    # `batch` is what the stream wrote for this step, so a second reading gives the same rows.
    days = [r[0] for r in once.select(EVENT_DAY).distinct().collect()]
    suspects = None
    if batch_id > 0 and versions.newest(spark, index.path) is not None:
        in_days = F.col(EVENT_DAY).isin([d for d in days if d is not None])
        if None in days:
            in_days = in_days | F.col(EVENT_DAY).isNull()
        maybe = possible_repeats(once, index.read(spark, in_days))
        suspects = once.join(maybe, ["_h", "_g"], "left_semi")
        days = [r[0] for r in suspects.select(EVENT_DAY).distinct().collect()]
    fresh = once
    if suspects is not None and days:
        seen = past_identities(batch, path, batch_id, identity, days)
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in identity])
        fresh = once.join(seen, same, "left_anti")
    fresh = fresh.select(*batch.columns, EVENT_DAY, "shard", "_h", "_g")
    learned = fresh.select(F.coalesce(EQUIPMENT, F.lit("")).alias(EQUIPMENT), EVENT_DAY, "shard", "_h", "_g")
    index.write(learned.groupBy(*KEYS).applyInArrow(_made, FILTER), batch_id)
    return fresh.select(*batch.columns)


def past_identities(batch: DataFrame, path: str, batch_id: int, identity: Sequence[str], days: Sequence) -> DataFrame:
    """Identities that earlier batches wrote in these days; no other day is read."""
    schema = T.StructType([*[batch.schema[c] for c in identity], T.StructField(EVENT_DAY, T.DateType()), T.StructField(BATCH, T.LongType())])
    in_days = F.col(EVENT_DAY).isin([d for d in days if d is not None])
    if None in days:
        in_days = in_days | F.col(EVENT_DAY).isNull()
    past = batch.sparkSession.read.schema(schema).parquet(path).filter(in_days & (F.col(BATCH) < batch_id))
    return past.select(*[F.col(c).alias(f"_s_{c}") for c in identity])
