"""Toxicity from the nearest labelled examples, by exact cosine over an inverted index of all their terms.

The examples are a bounded sample of the labelled rows (at most EXAMPLES, by a hash of their ids).  Every term of their
texts is indexed.  Its weight is its TF-IDF, document frequencies being counted over all documents, times
sqrt(1 + chi-squared of term and label among the examples): plain TF-IDF for terms that tell nothing of the label, more for
those that do.  The index is block-max: blocks of examples whose bound stays below the nearest found so far are passed over,
and the neighbours are exact.  Votes are weighted by distance, and an isotonic fit of the examples' own votes (each without
itself) turns them into probabilities.  The neighbours, their cosines and labels are each score's evidence.

Edge cases: null or empty text has no terms, and like every text without a term of any example gets the rate of toxic
examples without any; labels that are null, or of unknown documents, are ignored; with repeated ids every row is scored;
without examples every score is 0; texts of any length are read whole; an empty table gives an empty result.  Labels,
language, source and id are no inputs of a score.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import held, materialise, table

EXAMPLES = 8192
NEIGHBOURS, CLOSEST = 15, 0.05
THRESHOLD = 0.7
#: Terms of at least this share of the examples have a weight for every row; examples of a block; groups of alike examples;
#: more than the error of sums in single precision; texts looked up together; results that are kept for texts seen again.
COMMON, BLOCK, CENTRES, MARGIN, TOGETHER, MEMO = 0.05, 64, 96, 2e-4, 128, 2000
#: Bytes that end a word, among ASCII; other characters that do.
ENDS_WORD = bytes(b if b >= 128 or chr(b).isalnum() or b == 95 else 32 for b in range(256))
OTHER_ENDS = re.compile(r"[^\w\x00-\x7f]")


def tokens(text: str | None) -> list[bytes]:
    r"""The text's runs of \w, lower-cased, as UTF-8."""
    text = (text or "").lower()
    if not text.isascii():
        text = OTHER_ENDS.sub(" ", text)
    return text.encode("utf-8", "surrogatepass").translate(ENDS_WORD).split()


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learnt from; a null id has no label to learn from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def chosen_examples(labels: DataFrame) -> DataFrame:
    """id, toxic of the sample: at most EXAMPLES rows."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES).select(F.col("doc_id").alias("id"), "toxic")


def example_terms(texts: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """Every term of the examples, from their text and toxic, with its chi-squared against the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[toxic].update(set(tokens(text)))
            terms = list(counts[0].keys() | counts[1].keys())
            clean, toxic = ([c[t] for t in terms] for c in counts)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())], ["term", "clean", "toxic"])

    totals = texts.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    n0, n1 = (float(x or 0) for x in totals)
    counts = texts.select("text", "toxic").mapInArrow(run, "term binary, clean long, toxic long").groupBy("term")
    found = counts.agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b")).toArrow().sort_by("term")
    a, b = (found.column(c).to_numpy().astype(np.float64) for c in "ab")
    off, under = a * (n1 - b) - b * (n0 - a), n0 * n1 * (a + b) * (n0 + n1 - a - b)
    return found.column("term").to_pylist(), np.divide((n0 + n1) * off * off, under, out=np.zeros(len(a)), where=under > 0)


def counted(text: str | None, vocabulary: dict[bytes, int]) -> bytes:
    """A text's terms as packed pairs (term, count), ascending by term; empty if it has none."""
    found = Counter(map(vocabulary.get, tokens(text)))
    found.pop(None, None)
    terms = np.fromiter(found.keys(), np.uint32, len(found))
    order = np.argsort(terms)
    return np.stack([terms[order], np.fromiter(found.values(), np.uint32, len(found))[order]], 1).tobytes()


def places(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of the ranges, end to end, and the ranges' lengths."""
    n = ends - starts
    return np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n), n


class Index:
    """Block-max inverted index of examples, whose rows lie in blocks of alike texts.

    A term of few examples has its postings.  A term of many has a weight for every row, block by block, and of each block
    the largest.  Queries come many at a time.  Each adds up its rare terms' postings; these sums and the largest weights
    of its frequent terms bound the cosine of any row of a block.  The blocks with the largest bounds come first, and then
    only those that can still hold one of the nearest.  Sums in single precision choose the candidates, with a margin over
    their error; candidates are compared in double precision.
    """

    def __init__(self, packed: list[bytes], toxic: list[int], ids: list[int], frequency: np.ndarray, total: int, chi: np.ndarray | float = 0.0):
        self.idf = (np.log((1 + total) / (1 + frequency)) + 1).astype(np.float64) * np.sqrt(1 + np.asarray(chi, np.float64))
        self.name, self.ids, self.toxic = uuid.uuid4().hex, np.array(ids, np.int64), np.array(toxic, np.float64)
        pairs = np.frombuffer(b"".join(packed), "<u4").reshape(-1, 2)
        self.terms, self.counts = pairs[:, 0].astype(np.int32), pairs[:, 1].astype(np.uint32)
        self.ends = np.cumsum([0, *(len(x) // 8 for x in packed)], dtype=np.int64)
        self.take(np.lexsort((self.ids, [zlib.crc32(x) for x in packed])))  # whatever order they came in
        self.build()
        if len(self.ids) > BLOCK:
            self.take(self.alike())
            self.build()

    def __getstate__(self) -> dict:
        """Only the examples travel, compressed; each worker builds the postings from them."""
        columns = [zlib.compress(np.ascontiguousarray(c).tobytes(), 1) for c in (np.diff(self.terms, prepend=np.int32(0)), self.counts)]
        return {"name": self.name, "idf": self.idf, "ids": self.ids, "toxic": self.toxic, "ends": self.ends, "columns": columns}

    def __setstate__(self, state: dict) -> None:
        self.name, self.idf, self.ids, self.toxic, self.ends = state["name"], state["idf"], state["ids"], state["toxic"], state["ends"]
        steps, counts = map(zlib.decompress, state["columns"])
        self.terms, self.counts = np.cumsum(np.frombuffer(steps, np.int32), dtype=np.int32), np.frombuffer(counts, np.uint32)
        self.build()

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows' terms, row by row, and the rows' sizes."""
        return places(self.ends[rows], self.ends[rows + 1])

    def take(self, order: np.ndarray) -> None:
        """Put the examples in this order."""
        at, sizes = self.entries(order)
        self.terms, self.counts = self.terms[at], self.counts[at]
        self.ids, self.toxic = self.ids[order], self.toxic[order]
        self.ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def weighed(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (1 + np.log(counts.astype(np.float64))) * self.idf[terms]

    def build(self) -> None:
        n, size = len(self.ids), len(self.idf)
        row = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.ends))
        w = self.weighed(self.terms, self.counts)
        self.norms = np.sqrt(np.bincount(row, w * w, n))
        w /= self.norms[row]
        degree = np.bincount(self.terms, minlength=size)
        common = np.flatnonzero(degree >= max(1, COMMON * n)) if n else np.zeros(0, np.int64)
        self.common = np.full(size, -1, np.int32)
        self.common[common] = np.arange(len(common))
        self.blocks = -(-n // BLOCK)
        whole = self.common[self.terms] >= 0
        self.whole = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        self.whole[self.common[self.terms[whole]], row[whole]] = w[whole]
        self.whole = np.ascontiguousarray(self.whole.reshape(len(common), self.blocks, BLOCK).transpose(1, 0, 2))
        self.most = self.whole.max(2, initial=0).T.copy()
        terms, row, w = self.terms[~whole], row[~whole], w[~whole].astype(np.float32)
        by = np.argsort(terms, kind="stable")
        self.rows, self.weights = row[by], w[by]
        self.cuts = np.concatenate([[0], np.cumsum(np.where(self.common < 0, degree, 0))]).astype(np.int64)
        self.dense = np.zeros(size)
        self.logs = 1 + np.log(np.maximum(1, np.arange(int(self.counts.max(initial=0)) + 1, dtype=np.float64)))
        empty = np.diff(self.ends) == 0
        self.rate_without = float((self.toxic[empty].sum() + self.base()) / (empty.sum() + 1)) if n else 0.0

    def alike(self) -> np.ndarray:
        """Order of the rows by a few rounds of spherical k-means over their frequent terms."""
        x = self.whole.transpose(0, 2, 1).reshape(self.blocks * BLOCK, -1)[: len(self.ids)]
        centres = x[np.linspace(0, len(x) - 1, min(CENTRES, len(x))).astype(int)]
        for _ in range(4):
            of = np.argmax(x @ centres.T, 1)
            centres = np.stack([x[of == c].mean(0) if (of == c).any() else centres[c] for c in range(len(centres))])
            centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-9
        return np.lexsort((self.ids, of))

    def base(self) -> float:
        return float(self.toxic.mean()) if len(self.toxic) else 0.0

    def packed(self, row: int) -> bytes:
        a, b = self.ends[row], self.ends[row + 1]
        return np.stack([self.terms[a:b], self.counts[a:b]], 1).astype("<u4").tobytes()

    def vector(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.frombuffer(data, "<u4").reshape(-1, 2)
        terms = pairs[:, 0].astype(np.int64)
        w = self.weighed(terms, pairs[:, 1])
        return terms, w / math.sqrt(float((w * w).sum())) if len(w) else w

    def add(self, sums: np.ndarray, queries: np.ndarray, wanted: np.ndarray) -> None:
        """Add the frequent terms' part to the sums of the wanted (query, block)."""
        for b in np.flatnonzero(wanted.any(0)).tolist():
            some = np.flatnonzero(wanted[:, b])
            sums[some, b] += queries[some] @ self.whole[b]

    def nearest(self, asked: list[bytes], k: int = NEIGHBOURS, but: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each text the k largest (cosine, example), nearest first, ties by the examples' ids; ``but`` is left out."""
        m, n = len(asked), len(self.ids)
        if not n or not m:
            return [[] for _ in asked]
        vectors = [self.vector(data) for data in asked]
        queries, sums = np.zeros((m, self.most.shape[0]), np.float32), np.zeros((m, self.blocks * BLOCK), np.float32)
        for i, (terms, weights) in enumerate(vectors):
            of = self.common[terms]
            queries[i, of[of >= 0]] = weights[of >= 0]
            rare = terms[of < 0]
            at, sizes = places(self.cuts[rare], self.cuts[rare + 1])
            sums[i] = np.bincount(self.rows[at], self.weights[at] * np.repeat(weights[of < 0].astype(np.float32), sizes), self.blocks * BLOCK)
        sums = sums.reshape(m, self.blocks, BLOCK)
        bounds = sums.max(2) + queries @ self.most
        first = np.argsort(-bounds, 1)[:, : k // BLOCK + 2]
        seen = np.zeros(bounds.shape, bool)
        np.put_along_axis(seen, first, True, 1)
        self.add(sums, queries, seen)
        held = np.take_along_axis(sums, first[:, :, None], 1).reshape(m, -1)
        # the k-th best so far (one more, since ``but`` may be among them)
        least = np.partition(held, -k - 1, 1)[:, -k - 1] if held.shape[1] > k + 1 else np.zeros(m, np.float32)
        self.add(sums, queries, ~seen & (bounds > 0) & (bounds >= least[:, None] - MARGIN))
        sums, out = sums.reshape(m, -1)[:, :n], []
        for i, (terms, weights) in enumerate(vectors):
            own = sums[i]
            if but is not None:
                own[but[i]] = 0
            rows = np.flatnonzero(own >= max(least[i] - MARGIN, 1e-30))
            if len(rows) > k:
                own = own[rows]
                rows = rows[own >= np.partition(own, -k)[-k] - MARGIN]
            at, sizes = self.entries(rows)
            self.dense[terms] = weights
            held = self.terms[at]
            parts = self.dense[held] * self.logs[self.counts[at]] * self.idf[held]
            exact = np.round(np.add.reduceat(parts, np.cumsum(sizes) - sizes) / self.norms[rows], 12) if len(rows) else np.zeros(0)
            self.dense[terms] = 0
            best = np.lexsort((self.ids[rows], -exact))[:k]
            out.append([(float(exact[j]), int(rows[j])) for j in best if exact[j] > 0])
        return out

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of toxic neighbours by weights that fall with distance; the base rate has one distant vote."""
        weights = [1 / (CLOSEST + 1 - min(1.0, s)) for s, _ in near]
        return (sum(w * self.toxic[r] for w, (_, r) in zip(weights, near, strict=True)) + self.base()) / (sum(weights) + 1)

    def calibrate(self, votes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Isotonic fit (pooled neighbours) of the examples' labels by their votes, each pool with one vote of 1/2."""
        order = np.lexsort((rows, votes))
        pools: list[list[float]] = []  # sum, size, least vote
        for v, y in zip(votes[order], self.toxic[rows[order]], strict=True):
            pools.append([y, 1, v])
            while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][2] == pools[-1][2]):
                y1, n1, _ = pools.pop()
                pools[-1][0] += y1
                pools[-1][1] += n1
        return (np.array([p[2] for p in pools]), np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools]))

    def scores(self, asked: list[bytes], steps: tuple[np.ndarray, np.ndarray]) -> list[tuple[float, list[tuple[float, int]]]]:
        """Score and nearest examples of each text."""
        if not len(self.ids):
            return [(0.0, [])] * len(asked)
        memo = held(("toxicity", self.name), dict)
        if len(memo) >= MEMO:
            memo.clear()
        new = [d for d in dict.fromkeys(asked) if d and d not in memo]
        for at in range(0, len(new), TOGETHER):
            some = new[at : at + TOGETHER]
            for data, near in zip(some, self.nearest(some), strict=True):
                step = int(np.searchsorted(steps[0], self.vote(near), side="right")) - 1
                memo[data] = (float(steps[1][max(0, step)]) if len(steps[1]) else self.base(), near)
        return [memo[d] if d else (self.rate_without, []) for d in asked]


def document_frequency(docs: DataFrame, vocabulary: Broadcast) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and the number of documents."""
    size = len(vocabulary.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("toxicity", dict)
        counts, n, known = np.zeros(size, np.int64), 0, vocabulary.value
        for batch in slices(batches):
            n += batch.num_rows
            for text in batch.column("text").to_pylist():
                counts[[i for w in set(tokens(text)) if (i := known.get(w)) is not None]] += 1
        has = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *has.tolist()], pa.int64()), pa.array([n, *counts[has].tolist()], pa.int64())], ["term", "n"])

    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row a term of the examples, and one
    term, n = found.column("term").to_numpy(), found.column("n").to_numpy()
    counts = np.zeros(size, np.int64)
    counts[term[term >= 0]] = n[term >= 0]
    return counts, int(n[term < 0].sum())


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Broadcast, Broadcast, tuple[np.ndarray, np.ndarray]]:
    """The vocabulary and the index, broadcast (their sizes are bounded by the texts of EXAMPLES rows), and the calibration."""
    spark = docs.sparkSession
    sample = materialise(chosen_examples(labels), "examples")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("id"))
    texts = materialise(texts.select("id", "text", "toxic"), "example-texts")
    words, chi = example_terms(texts)
    vocabulary = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    frequency, total = document_frequency(docs, vocabulary)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in slices(batches):
            terms = pa.array([counted(t, known) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), terms, batch.column("toxic").cast(pa.int64())], ["id", "terms", "toxic"])

    rows = texts.mapInArrow(packed, "id long, terms binary, toxic long")
    # of rows that share an id, one
    rows = rows.groupBy("id").agg(F.min(F.struct("terms", "toxic")).alias("row")).select("id", "row.*").toArrow()
    index = Index(*(rows.column(c).to_pylist() for c in ("terms", "toxic", "id")), frequency, total, chi)
    shared = spark.sparkContext.broadcast(index)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            asked = [r for r in batch.column("id").to_pylist() if own.ends[r] < own.ends[r + 1]]
            parts = [asked[at : at + TOGETHER] for at in range(0, len(asked), TOGETHER)]
            found = [own.vote(near) for some in parts for near in own.nearest([own.packed(r) for r in some], but=some)]
            yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(found, pa.float64())], ["row", "vote"])

    own = spark.range(len(index.ids)).repartition(spark.sparkContext.defaultParallelism * 2).mapInArrow(votes, "row long, vote double").toArrow()
    return vocabulary, shared, index.calibrate(own.column("vote").to_numpy(), own.column("row").to_numpy())


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and evidence (the nearest examples, their cosine and label) of each document."""
    vocabulary, shared, steps = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value, vocabulary.value
        for batch in slices(batches):
            found = own.scores([counted(t, known) for t in batch.column("text").to_pylist()], steps)
            rows = np.array([r for _, near in found for _, r in near], np.int64)
            columns = [pa.array(own.ids[rows]), pa.array([c for _, near in found for c, _ in near], pa.float64()), pa.array(own.toxic[rows].astype(np.int32))]
            ends = np.cumsum([0, *(len(near) for _, near in found)], dtype=np.int32)
            near = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, ["doc_id", "cosine", "toxic"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([x for x, _ in found], pa.float64()), near], ["doc_id", "score", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score under ``threshold``, with all columns."""
    vocabulary, shared, steps = learn(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value, vocabulary.value
        for batch in slices(batches):
            found = own.scores([counted(t, known) for t in batch.column(at).to_pylist()], steps)
            yield batch.filter(pa.array([x < threshold for x, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


QUERIES = {"op3_toxicity": op3_toxicity}
