"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of full-dimensional codewords, one from each of STAGES codebooks.  The codebooks are
fitted on a bounded sample (at most SAMPLE vectors, chosen by a hash of their ids): k-means on residuals, then a joint
least-squares update.  Every vector is encoded by a beam search over the codebooks and keeps its codes, the norm of its
approximation, and itself.  A query scores a block of codes by lookup tables (its products with all codewords; for nearness
by distance the norms as well), and the best SHORTLIST distinct vectors of the block are reranked by the exact measure in
double precision.

Index rows stay where they are: queries come to them in chunks of bounded size, each broadcast and held against every block of
the index, and each task gives its k best for a query.  So vectors are never copied, and a larger query set takes more passes.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows with a
null id or a length other than the most frequent one; with fewer candidates than asked for, all are returned; ties go
to the smaller id; repeated ids are separate candidates (a query passes over all rows of its own id), and repeated query
rows are separate queries, each with a result of its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

STAGES, WORDS, BEAM, ROUNDS, SAMPLE = 24, 64, 4, 6, 8192
SHORTLIST, BLOCK, TOGETHER = 600, 16384, 256
#: Bytes of query vectors that are broadcast at a time.
QUERY_BYTES = 16 << 20


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and vector (array<float>) of the rows that take part."""
    v = F.col(vector_column)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(fine & F.exists("vector", lambda x: x != 0)).withColumn("width", F.size("vector"))
    widths = rows.groupBy("width").count().orderBy(F.desc("count"), "width").first()
    return rows.where(F.col("width") == (widths["width"] if widths else 0)).drop("width")


def nearest_words(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words * words).sum(1)[None] - 2 * (x @ words.T), 1)


def fit_codebooks(x: np.ndarray, stages=STAGES, words=WORDS, rounds=ROUNDS, seed=0) -> np.ndarray:
    """stages x words x width codewords from sample vectors."""
    rng = np.random.default_rng(seed)
    books, residual = [], x.astype(np.float32)
    for _ in range(stages):
        book = residual[rng.permutation(len(residual))[:words]]
        if len(book) < words:  # a small sample: unused codewords are zero
            book = np.concatenate([book, np.zeros((words - len(book), x.shape[1]), np.float32)])
        for _ in range(rounds):
            code = nearest_words(residual, book)
            count = np.bincount(code, minlength=words)
            total = np.eye(words, dtype=np.float32)[code].T @ residual
            book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book).astype(np.float32)
        residual = residual - book[nearest_words(residual, book)]
        books.append(book)
    books = np.stack(books)
    codes = encode(x.astype(np.float32), books)
    # least squares over all codewords at once, given the codes
    picks = np.concatenate([np.eye(words, dtype=np.float32)[codes[:, m]] for m in range(stages)], 1)
    gram, target = picks.T @ picks, picks.T @ x.astype(np.float32)
    pull = 0.1 * np.eye(len(gram), dtype=np.float32)
    solved = np.linalg.solve(gram + pull, target + 0.1 * books.reshape(len(gram), -1))
    return solved.reshape(books.shape).astype(np.float32)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (uint8) of each vector: at each stage the ``beam`` best partial sums go on, with their residuals."""
    stages, words, width = books.shape
    out = np.empty((len(x), stages), np.uint8)
    for at in range(0, len(x), 2048):
        some = x[at : at + 2048]
        n = np.arange(len(some))[:, None]
        left, codes = some[:, None, :], np.zeros((len(some), 1, 0), np.uint8)  # residuals of the partial sums
        for book in books:
            cost = (left * left).sum(2)[:, :, None] - 2 * (left.reshape(-1, width) @ book.T).reshape(len(some), -1, words)
            spread = (cost + (book * book).sum(1)).reshape(len(some), -1)
            go_on = min(beam, spread.shape[1])
            chosen = np.argpartition(spread, go_on - 1, 1)[:, :go_on]
            parent, word = chosen // words, chosen % words
            left = left[n, parent] - book[word]
            codes = np.concatenate([codes[n, parent], word[:, :, None].astype(np.uint8)], 2)
        out[at : at + 2048] = codes[n[:, 0], np.argmin((left * left).sum(2), 1)]
    return out


def matrix(column: pa.ChunkedArray | pa.Array, kind=None) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in chunks if len(c)]
    found = np.concatenate(parts) if parts else np.zeros((0, 0), np.float32)
    return found if kind is None else found.astype(kind)


def build_index(rows: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """id, vector, codes, norm (of the approximation) of every row; and the codebooks."""
    sample = rows.select("vector", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).select("vector").toArrow()
    books = fit_codebooks(matrix(sample.column("vector"), np.float32)) if sample.num_rows else None
    schema = rows.schema.simpleString()[7:-1].replace(":", " ", 1).replace(",vector:", ", vector ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = encode(matrix(batch.column("vector"), np.float32), books)
            sums = sum(books[m][codes[:, m]] for m in range(len(books)))
            arrays = [*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((sums * sums).sum(1), pa.float32())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "vector", "codes", "norm"])

    return materialise(rows.mapInArrow(run, f"{schema}, codes binary, norm float"), "ann-index"), books


def best(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest scores; of equal ones at the edge, the first."""
    if len(scores) <= n:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - n)[len(scores) - n]
    over = np.flatnonzero(scores > edge)
    return np.concatenate([over, np.flatnonzero(scores == edge)[: n - len(over)]])


class Block:
    """Up to BLOCK index rows; equal vectors are one, with the ids of all."""

    def __init__(self, table: pa.Table):
        ids, x = table.column("id").to_numpy(), np.ascontiguousarray(matrix(table.column("vector")))
        _, first, of = np.unique(x.view(f"V{x.shape[1] * x.itemsize}").ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((ids, of.ravel()))
        self.ids, self.cuts = ids[order], np.searchsorted(of.ravel()[order], np.arange(len(first) + 1))
        self.x = x[first]
        self.codes = np.frombuffer(b"".join(table.column("codes").take(pa.array(first)).to_pylist()), np.uint8).reshape(len(first), -1)
        self.norms = table.column("norm").to_numpy()[first]

    def scores(self, asked: np.ndarray, books: np.ndarray, by_distance: bool) -> np.ndarray:
        """Approximate nearness of each query (a row) to each distinct vector."""
        some, total = asked.astype(np.float32), np.zeros((len(self.codes), len(asked)), np.float32)
        for m in range(len(books)):
            total += (books[m] @ some.T)[self.codes[:, m]]  # the stage's lookup table, a row for each code
        if by_distance:
            total = 2 * total - self.norms[:, None]
        return np.ascontiguousarray(total.T)

    def nearest(self, scores: np.ndarray, q: int, vector: np.ndarray, k: int, shortlist: int, by_distance: bool) -> tuple[np.ndarray, np.ndarray]:
        """Exact nearness and ids of the k best (more on ties) of the short list but for rows with id ``q``."""
        short = best(scores, shortlist + 1)
        x = self.x[short].astype(np.float64)
        exact = -((x - vector) ** 2).sum(1) if by_distance else (x * vector).sum(1)
        order = np.argsort(-exact, kind="stable")
        sizes = (self.cuts[short + 1] - self.cuts[short])[order]
        own = np.flatnonzero(self.ids == q)
        enough = int(np.searchsorted(np.cumsum(sizes), k + len(own)))
        chosen = order[exact[order] >= exact[order[min(enough, len(order) - 1)]]]
        parts = [(u := self.ids[self.cuts[s] : self.cuts[s + 1]])[u != q][:k] for s in short[chosen].tolist()]
        return np.repeat(exact[chosen], [len(u) for u in parts]), np.concatenate(parts)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_column="vec_id", vector_column="embedding", shortlist=SHORTLIST, by_distance=False) -> DataFrame:
    """query_id, rank, id, score: the k nearest found among all rows but those of the query's id, by inner product, or by
    Euclidean distance (score: its square, negative).

    ``queries`` has the same columns as ``vectors``.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors, id_column, vector_column), "ann-rows")
    asked = materialise(usable(queries, id_column, vector_column).withColumn("query", F.monotonically_increasing_id()), "ann-queries")
    index, books = build_index(rows)
    size = asked.agg(F.sum(F.size("vector").cast("long") * 8)).first()[0] or 0
    chunks, schema = int(size // QUERY_BYTES + 1), "query long, query_id long, negative double, vec_id long"
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def looked_up(chunk: int) -> DataFrame:
        some = asked.where(F.pmod(F.xxhash64("query"), F.lit(chunks)) == chunk).toArrow()  # QUERY_BYTES, about
        shared = spark.sparkContext.broadcast((some.column("query").to_numpy(), some.column("id").to_numpy(), matrix(some.column("vector"), np.float64)))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, names, wanted = shared.value
            found = [(np.zeros(0), np.zeros(0, np.int64)) for _ in names]

            def take(table: pa.Table) -> None:
                block = Block(table)
                for at in range(0, len(names), TOGETHER):
                    scores = block.scores(wanted[at : at + TOGETHER], books, by_distance)
                    for i in range(at, at + len(scores)):
                        held, more = found[i], block.nearest(scores[i - at], names[i], wanted[i], k, shortlist, by_distance)
                        exact, ids = np.concatenate([held[0], more[0]]), np.concatenate([held[1], more[1]])
                        order = np.lexsort((ids, -exact))[:k]
                        found[i] = exact[order], ids[order]

            waiting, n = [], 0
            for batch in batches if len(names) else ():
                for start in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(start, BLOCK)
                    if n + part.num_rows > BLOCK:
                        take(pa.Table.from_batches(waiting).combine_chunks())
                        waiting, n = [], 0
                    waiting.append(part)
                    n += part.num_rows
            if n:
                take(pa.Table.from_batches(waiting).combine_chunks())
            sizes = [len(e) for e, _ in found]
            arrays = [np.repeat(keys, sizes), np.repeat(names, sizes), -np.concatenate([np.zeros(0), *(e for e, _ in found)]), np.concatenate([np.zeros(0, np.int64), *(i for _, i in found)])]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["query", "query_id", "negative", "vec_id"])

        return index.mapInArrow(look, schema)

    found = looked_up(0)
    for chunk in range(1, chunks):
        found = found.unionByName(looked_up(chunk))
    order = Window.partitionBy("query").orderBy("negative", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", (-F.col("negative")).alias("score"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))


QUERIES = {"op9_ann": op9_ann}
