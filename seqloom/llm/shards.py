"""Documents in shards of bounded size, and what shards ask of and tell to hash buckets.

Runs of words are far more numerous than documents, so they don't travel as rows: each shard sends every hash bucket
one packed array, each bucket sends every shard one packed answer.  A hash appears once per shard however often it
occurs there, which is the pre-aggregation that keeps frequent passages from piling up in their bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_BYTES = 8 << 20
#: Entries that one bucket sorts at a time, about, if every word of the text starts an entry.
BUCKET_ENTRIES = 3 << 20


def shard_count(text_bytes: int) -> int:
    return int(max(16, text_bytes // SHARD_BYTES + 1))


def bucket_count(text_bytes: int, bytes_per_entry: float) -> int:
    return int(max(16, text_bytes / bytes_per_entry // BUCKET_ENTRIES + 1))


def dealt(docs: DataFrame, shards: int, *columns: str) -> DataFrame:
    """doc_id, text and columns, with their shard; the text takes part in the hash so that repeated ids spread."""
    return docs.select("doc_id", "text", *columns, F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash by its upper bits; ascending for ascending hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def cuts(hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of each bucket that has any of the sorted hashes."""
    if not len(hashes):
        return []
    of = bucket_of(hashes, buckets)
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    return list(zip(of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(of)], strict=True))


def joined(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """Packed arrays of a column end to end, and the length of each."""
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.array([len(p) for p in parts], np.int64)
