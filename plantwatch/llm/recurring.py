"""Which of very many keys (hashes of grams or shingles) belong to more than one owner, without a frequent key gathering anywhere.

A key with several places in one batch is known to recur there: its rows go by their owner, and a single row tells the
task that counts the key. Only keys seen once in a batch go to that task themselves, so it gets a row per batch at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "route bigint, gram bigint, uid bigint, many boolean"


def routed(key: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
    """Rows for the keys of one batch, each with its owner; the same key may be there several times for one owner."""
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    distinct, count = np.unique(key, return_counts=True)
    many = np.repeat(count > 1, count)
    again = np.zeros(len(key), dtype=bool)
    again[1:] = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
    alone, here, told = ~many, many & ~again, distinct[count > 1]
    kinds = [int(alone.sum()), len(told), int(here.sum())]
    uid = np.concatenate([owner[alone], np.zeros(len(told), np.int64), owner[here]])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([key[alone], told, owner[here]])),
            pa.array(np.concatenate([key[alone], told, key[here]])),
            pa.array(uid, mask=np.repeat([False, True, False], kinds)),
            pa.array(np.repeat([False, True, True], kinds)),
        ],
        ["route", "gram", "uid", "many"],
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, gram) of the keys with more than one owner or place, from rows sorted by gram and owner."""
    held: list[tuple[np.ndarray, ...]] = []

    def settled(last: bool) -> pa.RecordBatch:
        gram, uid, told, many = (np.concatenate(x) for x in zip(*held, strict=True))
        end = len(gram) if last else int(np.searchsorted(gram, gram[-1]))
        held[:] = [] if last else [(gram[end:], uid[end:], told[end:], many[end:])]
        gram, uid, told, many = gram[:end], uid[:end], told[:end], many[:end]
        passing = many & ~told
        alone = ~many
        again = np.zeros(len(gram), dtype=bool)
        again[1:] = (gram[1:] == gram[:-1]) & (uid[1:] == uid[:-1]) & (told[1:] == told[:-1]) & (many[1:] == many[:-1])
        _, which = np.unique(gram, return_inverse=True)
        weight = np.bincount(which, weights=2 * told + (alone & ~again))
        out = ~again & (passing | (alone & (weight[which] > 1) if len(gram) else alone))
        return pa.RecordBatch.from_arrays([pa.array(uid[out]), pa.array(gram[out])], ["uid", "gram"])

    for batch in batches:
        if not batch.num_rows:
            continue
        uid = batch.column("uid")
        many = batch.column("many").to_numpy(zero_copy_only=False).astype(bool)
        held.append((batch.column("gram").to_numpy(), uid.fill_null(0).to_numpy(), uid.is_null().to_numpy(zero_copy_only=False), many))
        yield settled(False)
    if held:
        yield settled(True)


def recurring(rows: DataFrame) -> DataFrame:
    """(uid, gram) of the recurring keys, from rows made by `routed`. A pair may come twice, from two routes."""
    return rows.repartition("route").sortWithinPartitions("gram", "many", "uid").mapInArrow(_counted, "uid bigint, gram bigint")
