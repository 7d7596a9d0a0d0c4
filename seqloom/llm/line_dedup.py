"""Line dedup by range-partitioned hashes.

Each document's long lines become (hash of the key, document, line numbers).  These rows are range-partitioned by hash
and document together, so a line that a third of all documents hold spreads over many partitions, and sorted within
each; streaming through a partition, the first document of a hash is the one that stays.  Hashes that go on into another
partition (two at most) leave a fragment's count, first and last document; the fragments, two rows per partition at most,
settle their rows.  The result is one compressed keep bitmap for each document that loses a line, instead of text.

Keys are compared by 128-bit hashes.

Edge cases: null or empty text is one empty line, which is too short to go; rows that share a ``doc_id`` count as one document
(and if it is the largest, all keep the line); rows with a null ``doc_id`` count as one document smaller than any; an empty
table gives an empty result; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import SPACES, materialise, table

SHORTEST, SPREAD = 20, 3
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Stands for a null doc_id in the order: below every id.
NO_ID = -(1 << 63)


def row_key(text: str) -> int:
    """Tells rows apart that share a doc_id."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def long_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """hash (16 bytes), doc, row, lines (numbers, as little-endian 32-bit integers) of every long line's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, ids, rows, lines = [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text or len(text) < shortest:
                    continue
                held: dict[str, list[int]] = {}
                for n, line in enumerate(text.split("\n")):
                    if len(line) >= shortest and len(line := line.strip(SPACES)) >= shortest:
                        held.setdefault(line.translate(LOWER), []).append(n)
                row = row_key(text)
                for key, at in held.items():
                    hashes.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass")))
                    ids.append(NO_ID if doc is None else doc)
                    rows.append(row)
                    lines.append(np.array(at, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.binary()), pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(lines, pa.binary())],
                ["hash", "doc", "row", "lines"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "hash binary, doc long, row long, lines binary")


SETTLED = "hash binary, doc long, row long, lines binary, n long, first long, last long, part int, open boolean"


def stream_groups(batches: Iterator[pa.RecordBatch], spread: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash and, within it, from the largest document down -> rows to drop, and open rows.

    Rows of a hash wholly inside the partition are dropped at once (open false).  The first and the last hash may go on
    elsewhere: their rows are given as open, with one more row (no lines) that tells the fragment's documents, its first and
    its last.  Of a hash only the rows of the first ``spread - 1`` documents wait; the rest stream by.
    """
    out: list[tuple] = []
    now, first, last, n, waiting, opened, part = None, 0, None, 0, [], True, TaskContext.get().partitionId()

    def end(is_open: bool) -> None:
        if now is not None and is_open:
            out.extend((now, d, r, x, None, None, None, part, True) for d, r, x in waiting)
            out.append((now, None, None, None, n, first, last, part, True))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
        columns = zip(*rows, strict=True) if rows else [()] * 9
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in SETTLED.split(", ")])

    # The last hash is known as such only at the end, so a hash's rows are held back until the next begins or enough
    # documents are seen; once enough are seen they drop whether or not the hash goes on, unless it may be the first
    # here, whose largest document may lie elsewhere.
    for batch in batches:
        for h, d, r, x in zip(*(batch.column(c).to_pylist() for c in ("hash", "doc", "row", "lines")), strict=True):
            if h != now:
                end(opened)
                opened = now is None  # the partition's first hash
                now, first, last, n, waiting = h, d, None, 0, []
            n += d != last
            last = d
            if opened:
                out.append((h, d, r, x, None, None, None, part, True))
            elif n < spread:
                waiting.append((d, r, x))
            else:
                out.extend((h, *w, None, None, None, part, False) for w in [*waiting, (d, r, x)] if w[0] != first)
                waiting = []
        if len(out) >= 20_000:
            yield batch_of(out)
            out = []
    end(True)
    yield batch_of(out)


def dropped_lines(docs: DataFrame, shortest: int = SHORTEST, spread: int = SPREAD) -> DataFrame:
    """doc, row, lines: the lines to drop, some rows per document."""
    lines = materialise(long_lines(docs, shortest), "long-lines")
    n = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("hash"), F.col("doc").desc(), F.col("row")]
    dealt = lines.repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = materialise(dealt.mapInArrow(lambda batches: stream_groups(batches, spread), SETTLED), "line-groups")
    # Fragments: two for each partition at most.  A document that ends one and begins the next is one document.
    parts = found.where("open AND n IS NOT NULL")
    before = F.lag("last").over(Window.partitionBy("hash").orderBy("part"))
    parts = parts.withColumn("n", F.col("n") - F.coalesce((before == F.col("first")).cast("int"), F.lit(0)))
    parts = parts.groupBy("hash").agg(F.sum("n").alias("docs"), F.max("first").alias("stays"))
    spread_out = parts.where(F.col("docs") >= spread).withColumnRenamed("hash", "of")
    waiting = found.where("open AND n IS NULL").join(F.broadcast(spread_out), F.col("hash") == F.col("of"))
    late = waiting.where("doc <> stays").select("doc", "row", "lines")
    return found.where("NOT open").select("doc", "row", "lines").unionByName(late)


def keep_bitmaps(docs: DataFrame, shortest: int = SHORTEST, spread: int = SPREAD) -> DataFrame:
    """doc, row and bitmap of each document that loses a line; all others keep every line.

    The bitmap is the packed bits of the dropped lines' complement up to the last dropped one, deflated; lines past its
    end stay.  A document's lines lie in one row of its own text, so a group here is never larger than a document.
    """

    def bitmap(lines: list[bytes]) -> tuple[int, bytes]:
        at = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in lines]))
        keep = np.ones(int(at[-1]) + 1, bool)
        keep[at] = False
        return len(keep), zlib.compress(np.packbits(keep).tobytes(), 6)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lines, out = None, [], []

        def batch_of() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc", "row", "n_bits", "bitmap"])

        for batch in batches:
            for doc, row, x in zip(*(batch.column(c).to_pylist() for c in ("doc", "row", "lines")), strict=True):
                if (doc, row) != now:
                    if now is not None:
                        out.append((*now, *bitmap(lines)))
                    now, lines = (doc, row), []
                lines.append(x)
            if len(out) >= 5000:
                yield batch_of()
                out.clear()
        if now is not None:
            out.append((*now, *bitmap(lines)))
        yield batch_of()

    dropped = dropped_lines(docs, shortest, spread)
    dealt = dropped.repartition("doc", "row").sortWithinPartitions("doc", "row")
    return dealt.mapInArrow(pack, "doc long, row long, n_bits long, bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, digest: bool = False, shortest: int = SHORTEST) -> DataFrame:
    """The documents' other columns with the kept text; or, as a digest, doc_id, n_lines, n_dropped and kept_sha256."""
    columns = ["doc_id"] if digest else docs.columns
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" if digest else docs.schema
    names = [f"c{i}" for i in range(len(columns))]
    at_text = None if digest else docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, n_lines, n_dropped = [], [], []
            for text, size, bitmap in zip(*(batch.column(c).to_pylist() for c in ("_text", "_bits", "_bitmap")), strict=True):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                if bitmap is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=size).tolist()
                    lines = [x for n, x in enumerate(lines) if n >= size or bits[n]]
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append(text if bitmap is None else "\n".join(lines))
            if digest:
                sums = [hashlib.sha256((k or "").encode("utf-8", "surrogatepass")).hexdigest() for k in kept]
                arrays = [batch.column("c0").cast(pa.int64()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_lines", "n_dropped", "kept_sha256"])
            else:
                arrays = [pa.array(kept, pa.string()) if i == at_text else batch.column(c) for i, c in enumerate(names)]
                yield pa.RecordBatch.from_arrays(arrays, columns)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [None if not t or len(t) < shortest else row_key(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.int64())], [*batch.schema.names, "_row"])

    # The text travels once, under its own name.
    fields = [F.col(f"`{c}`").alias(n) if i != at_text else F.lit(None).cast("string").alias(n) for i, (c, n) in enumerate(zip(columns, names, strict=True))]
    left = docs.select(*fields, F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    left = left.mapInArrow(key, T.StructType([*left.schema.fields, T.StructField("_row", T.LongType())]))
    right = bitmaps.select(F.col("doc").alias("_d"), F.col("row").alias("_r"), F.col("n_bits").alias("_bits"), F.col("bitmap").alias("_bitmap"))
    same = (F.coalesce("_doc", F.lit(NO_ID)) == F.col("_d")) & (F.col("_row") == F.col("_r"))
    return left.join(right, same, "left").select(*names, "_text", "_bits", "_bitmap").mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, shortest: int = SHORTEST, spread: int = SPREAD) -> DataFrame:
    """The documents without their repeated lines; all rows and columns stay."""
    return apply_bitmaps(docs, keep_bitmaps(docs, shortest, spread), shortest=shortest)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_bitmaps(docs, keep_bitmaps(docs), digest=True)


ORACLES = {
    "op6_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
g AS (SELECT key, max(doc_id) AS stays FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*)::bigint AS n_lines, count_if(stays IS NOT NULL AND doc_id <> stays)::bigint AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (stays IS NULL OR doc_id = stays), '')) AS kept_sha256
FROM k LEFT JOIN g USING (key) GROUP BY doc_id""",
}
QUERIES = {"op6_line_dedup": op6_line_dedup}
