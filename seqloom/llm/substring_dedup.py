"""Substring dedup: repeated runs of words as compacted paths of a de Bruijn graph.

Nodes are runs of SPAN - 1 words; an edge (a token k-mer) is a run of SPAN words from one node to the next.  An edge that
starts in several documents is repeated.  A link between an edge and the next is nonbranching if all places of either
have the other beside them: the same next word, and the same word before (the end of a text is a neighbour of its own).
Maximal runs of repeated edges over nonbranching links are the compacted paths.  All places of an edge have the same
neighbours in such a path, so a path is in the same documents as each of its edges, and one row stands for all of them.

Documents are dealt to shards, edges to hash buckets; each join between them carries packed arrays.

1. Shards send the seeds of their edges (the least hash of the 8-word runs inside an edge: 2 in 7 edges bring a new one), and
   buckets answer which seeds occur in several documents.  Equal edges have equal seeds, so
2. only edges with a repeated seed are candidates.  Shards send their hashes with the neighbouring words and the documents,
   and buckets answer which are repeated, and which of their links branch.
3. Shards compact their documents' paths and give one row for each path they hold: its smallest document and place there (the
   source's coordinates), and a 128-bit digest of the words between them.  A join on the digest finds each path's source.
4. Documents lose the words of paths whose source is a smaller document.  Paths that lie end to end here and at their source
   are one span.

Edges are found by 64-bit hashes, but nothing is removed on such a hash: a span must have the digest of the words at its
source.  Colliding edges only make links branch, so that paths are shorter, in all places alike.

Edge cases: null or empty text has no words and loses none; fewer than SPAN words make no edge; documents with a null
``doc_id`` are no one's source and lose nothing; rows that share a ``doc_id`` don't remove each other's words; texts
of any length are one run of words; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, release, table, text_bytes, trim
from .shards import bucket_count, cuts, dealt, joined, shard_count
from .shingles import hash_words, mix, multipliers, split_words, window_hashes

SPAN, SEED = 13, 8
EDGE_FACTORS, SEED_FACTORS = multipliers(SPAN, 13), multipliers(SEED, 8)
#: Marks of an edge: in several documents; links to the edges before and after it branch.
SEVERAL, INTO, OUT = 1, 2, 4


#: Stands for a null doc_id: no document is smaller.
NO_ID = -(1 << 63)


class Texts:
    """The texts of a shard end to end: hashes of all words, and where each document begins and ends."""

    def __init__(self, docs: pa.Table, keep: bool = False):
        hashes, sizes, lines, lengths = [np.zeros(0, np.uint64)], [], [], [np.zeros(0, np.int64)]
        parts = (docs.column("text").slice(at, 200).to_pylist() for at in range(0, docs.num_rows, 200))  # few texts are Python objects at once
        for text in chain.from_iterable(parts):
            words = split_words(text)
            hashes.append(hash_words(words))
            sizes.append(len(words))
            if keep:
                lines.append(b" ".join(words))
                lengths.append(np.fromiter(map(len, words), np.int64, len(words)))
        self.hashes, self.sizes = np.concatenate(hashes), np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.ids = pc.fill_null(docs.column("doc_id").cast(pa.int64()), NO_ID).to_numpy()
        n = np.maximum(0, self.sizes - SPAN + 1) * (self.ids != NO_ID)
        self.owner = np.repeat(np.arange(len(n)), n)  # of each edge, its document
        self.edges = np.arange(n.sum()) + (self.starts - (np.cumsum(n) - n))[self.owner]  # and its first word
        if keep:
            # words and single spaces between them; a space after each document, but none after its last word
            self.text, lengths = b" ".join(x for x, n in zip(lines, sizes, strict=True) if n), np.concatenate(lengths)
            self.stop = np.cumsum(lengths + 1) - 1
            self.start = self.stop - lengths

    def windows(self, factors: np.ndarray) -> np.ndarray:
        """Hash of each run of words, those over the end of a document included."""
        return window_hashes(self.hashes, factors)

    def edge_hashes(self, bits: int) -> np.ndarray:
        """Hash of each edge, of which only the upper bits count."""
        if not len(self.edges):
            return np.zeros(0, np.uint64)
        found = self.windows(EDGE_FACTORS)[self.edges]
        return found if bits == 64 else found >> np.uint64(64 - bits) << np.uint64(64 - bits)

    def seeds(self) -> np.ndarray:
        """Each edge's seed, spread over all numbers again (least hashes crowd at the lower end)."""
        if not len(self.edges):
            return np.zeros(0, np.uint64)
        runs = self.windows(SEED_FACTORS)
        least = runs[: len(runs) - SPAN + SEED].copy()
        for i in range(1, SPAN - SEED + 1):
            np.minimum(least, runs[i : i + len(least)], out=least)
        return mix(least[self.edges])

    def beside(self, edges: np.ndarray) -> np.ndarray:
        """Hash of the word before and of the word after each of these edges; 0 at the ends of a text."""
        first, doc = self.edges[edges], self.owner[edges]
        around = np.concatenate([[np.uint64(0)], self.hashes, [np.uint64(0)]])
        before = np.where(first > self.starts[doc], around[first], 0)
        after = np.where(first + SPAN < self.ends[doc], around[first + SPAN + 1], 0)
        return np.stack([before, after], 1).astype(np.uint64)


def starts_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def within(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in the sorted array, and its place there."""
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return (among[at] == values if len(among) else np.zeros(len(values), bool)), at


class Known:
    """A sorted array of hashes with a table of bits in front, since most hashes that are looked up aren't in it."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.mask = np.uint64((1 << max(12, len(hashes).bit_length() + 3)) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[self.key(hashes)] = True

    def key(self, values: np.ndarray) -> np.ndarray:
        return (values >> np.uint64(20)) & self.mask

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which values are known (their places in ``values``), and where."""
        may = np.flatnonzero(self.bits[self.key(values)])
        found, at = within(values[may], self.hashes)
        return may[found], at[found]


ASKED = "bucket int, shard int, hashes binary, docs binary, marks binary, words binary"
TOLD = "shard int, hashes binary, docs binary"


def ask(shard: int, buckets: int, hashes: np.ndarray, marks: np.ndarray, docs: np.ndarray | None = None, words: np.ndarray | None = None) -> pa.Table:
    some = lambda x, i, j: b"" if x is None else x[i:j].tobytes()
    rows = [(b, shard, *(some(x, i, j) for x in (hashes, docs, marks, words))) for b, i, j in cuts(hashes, buckets)]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    columns = zip(*rows, strict=True) if rows else [()] * 6
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in ASKED.split(", ")])


def tell(shards: np.ndarray, hashes: np.ndarray, docs: np.ndarray | None) -> pa.Table:
    """One answer for each shard; rows come in order of shards."""
    starts = starts_of(shards)
    ends = np.append(starts[1:], len(shards)).tolist() if len(starts) else []
    rows = [(int(shards[i]), hashes[i:j].tobytes(), b"" if docs is None else docs[i:j].tobytes()) for i, j in zip(starts.tolist(), ends, strict=True)]
    columns = zip(*rows, strict=True) if rows else [()] * 3
    return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int32(), pa.binary(), pa.binary()], strict=True)], ["shard", "hashes", "docs"])


def in_groups(hashes: np.ndarray, docs: np.ndarray, marks: np.ndarray | None, words: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Distinct hashes ascending, each with its smallest document, its marks, and the words before and after it.

    Marks add up; documents that differ mark SEVERAL, words before or after that differ INTO or OUT.
    """
    order = np.argsort(hashes)
    hashes, docs = hashes[order], docs[order]
    starts = starts_of(hashes)
    if not len(starts):
        return hashes, docs, np.zeros(0, np.uint8), np.zeros((0, 2), np.uint64)
    marks = np.zeros(len(starts), np.uint8) if marks is None else np.bitwise_or.reduceat(marks[order], starts)
    first = np.minimum.reduceat(docs, starts)
    marks[np.maximum.reduceat(docs, starts) != first] |= SEVERAL
    if words is not None:
        words = words[order]
        size = np.diff(np.append(starts, len(hashes)))
        for side, mark in ((0, INTO), (1, OUT)):
            differs = words[:, side] != np.repeat(words[starts, side], size)
            marks[np.bitwise_or.reduceat(differs, starts)] |= mark
        words = words[starts]
    return hashes[starts], first, marks, words


def repeated_seeds(rows: DataFrame, buckets: int) -> DataFrame:
    def look(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        trim()
        texts = Texts(docs)
        seeds, owners = texts.seeds(), texts.owner
        new = np.flatnonzero(np.concatenate([[True], (seeds[1:] != seeds[:-1]) | (owners[1:] != owners[:-1])])) if len(seeds) else starts_of(seeds)
        hashes, _, marks, _ = in_groups(seeds[new], texts.ids[owners[new]], None, None)
        return ask(key[0].as_py(), buckets, hashes, marks)

    def answer(key: tuple[pa.Scalar, ...], asked: pa.Table) -> pa.Table:
        trim()
        hashes, lengths = joined(asked.column("hashes"), "<u8")
        marks, _ = joined(asked.column("marks"), "u1")
        shards = np.repeat(asked.column("shard").to_numpy(), lengths)
        order = np.argsort(hashes, kind="stable")
        same = np.concatenate([[False], hashes[order][1:] == hashes[order][:-1]]) if len(order) else np.zeros(0, bool)
        repeated = np.empty(len(hashes), bool)
        repeated[order] = same | np.append(same[1:], False) if len(order) else same
        repeated |= marks > 0
        return tell(shards[repeated], hashes[repeated], None)

    asked = rows.groupBy("shard").applyInArrow(look, ASKED)
    return materialise(asked.groupBy("bucket").applyInArrow(answer, TOLD), "seeds")


def repeated_edges(rows: DataFrame, seeds: DataFrame, buckets: int, bits: int) -> DataFrame:
    """shard, hashes, docs (the marks): each shard's repeated edges and which of their links branch."""

    def look(key: tuple[pa.Scalar, ...], docs: pa.Table, told: pa.Table) -> pa.Table:
        trim()
        repeated = Known(np.sort(joined(told.column("hashes"), "<u8")[0]))
        texts = Texts(docs if told.num_rows else docs.slice(0, 0))
        at, _ = repeated.find(texts.seeds())
        hashes, first, marks, words = in_groups(texts.edge_hashes(bits)[at], texts.ids[texts.owner[at]], None, texts.beside(at))
        return ask(key[0].as_py() if docs.num_rows else 0, buckets, hashes, marks, first, words)

    def answer(key: tuple[pa.Scalar, ...], asked: pa.Table) -> pa.Table:
        trim()
        hashes, lengths = joined(asked.column("hashes"), "<u8")
        docs, marks, words = (joined(asked.column(c), k)[0] for c, k in (("docs", "<i8"), ("marks", "u1"), ("words", "<u8")))
        shards = np.repeat(asked.column("shard").to_numpy(), lengths)
        known, _, marks, _ = in_groups(hashes, docs, marks, words.reshape(-1, 2))
        mark = marks[np.searchsorted(known, hashes)]
        wanted = (mark & SEVERAL) > 0
        return tell(shards[wanted], hashes[wanted], mark[wanted])

    asked = rows.groupBy("shard").cogroup(seeds.groupBy("shard")).applyInArrow(look, ASKED)
    return materialise(asked.groupBy("bucket").applyInArrow(answer, TOLD), "edges")


class Graph:
    """A shard's repeated edges; compacts the paths of its documents."""

    def __init__(self, hashes: pa.ChunkedArray, marks: pa.ChunkedArray, bits: int):
        self.bits = bits
        hashes, marks = joined(hashes, "<u8")[0], joined(marks, "u1")[0]
        order = np.argsort(hashes)
        self.known, self.marks = Known(hashes[order]), marks[order]

    def paths(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word, edges, digest (two numbers) and document of each path of the texts."""
        none = np.zeros(0, np.int64)
        if not len(self.marks):
            return none, none, np.zeros((0, 2), np.int64), none
        at, where = self.known.find(texts.edge_hashes(self.bits))
        if not len(at):
            return none, none, np.zeros((0, 2), np.int64), none
        marks, edges, owner = self.marks[where], texts.edges[at], texts.owner[at]
        goes_on = (np.diff(edges) == 1) & (owner[1:] == owner[:-1]) & (marks[:-1] & OUT == 0) & (marks[1:] & INTO == 0)
        new = np.flatnonzero(np.concatenate([[True], ~goes_on]))
        sizes, first = np.diff(np.append(new, len(at))), edges[new]
        digest, text = xxhash.xxh3_128_digest, texts.text
        ends = zip(texts.start[first].tolist(), texts.stop[first + sizes + SPAN - 2].tolist(), strict=True)
        digests = b"".join([digest(text[a:b]) for a, b in ends])
        return first, sizes, np.frombuffer(digests, "<i8").reshape(-1, 2), owner[new]


PATHS = "shard int, a long, b long, doc long, start long, several boolean"


def path_sources(rows: DataFrame, edges: DataFrame, bits: int) -> DataFrame:
    """shard, a, b (the digest), source, source_start of the paths that a shard has in a document larger than the source."""
    names = [f.split()[0] for f in PATHS.split(", ")]

    def look(key: tuple[pa.Scalar, ...], docs: pa.Table, told: pa.Table) -> pa.Table:
        trim()
        graph = Graph(told.column("hashes"), told.column("docs"), bits)
        texts = Texts(docs if told.num_rows else docs.slice(0, 0), keep=True)
        first, _, digests, owner = graph.paths(texts)
        owners, starts = texts.ids[owner], first - texts.starts[owner]
        order = np.lexsort((starts, owners, digests[:, 1], digests[:, 0]))
        digests, owners, starts = digests[order], owners[order], starts[order]
        new = np.flatnonzero(np.concatenate([[True], (digests[1:] != digests[:-1]).any(1)])) if len(order) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(order)) - 1 if len(new) else new
        several = owners[last] != owners[new]
        shard = np.full(len(new), key[0].as_py() if len(new) else 0, np.int32)
        return pa.table([pa.array(c) for c in (shard, digests[new, 0], digests[new, 1], owners[new], starts[new], several)], names)

    paths = materialise(rows.groupBy("shard").cogroup(edges.groupBy("shard")).applyInArrow(look, PATHS), "paths")
    # One row for each shard that has a path, so a passage of many documents is no large group; its source is one row.
    sources = paths.groupBy("a", "b").agg(F.min(F.struct("doc", "start")).alias("source"), F.count(F.lit(1)).alias("n"), F.max("several").alias("s"))
    sources = sources.where("n > 1 OR s").select("a", "b", "source")
    found = paths.join(sources, ["a", "b"]).where("source.doc < doc OR several")
    found = found.select("shard", "a", "b", F.col("source.doc").alias("source"), F.col("source.start").alias("source_start"))
    return materialise(found, "sources")


def spans_of(starts: np.ndarray, sizes: np.ndarray, sources: np.ndarray, places: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, words, source, place in the source) of spans; paths that lie end to end here and there are one."""
    if not len(starts):
        return []
    next_start, next_place = starts + sizes, places + sizes
    apart = (starts[1:] != next_start[:-1]) | (sources[1:] != sources[:-1]) | (places[1:] != next_place[:-1])
    new = np.flatnonzero(np.concatenate([[True], apart]))
    last = np.append(new[1:], len(starts)) - 1
    return [(int(starts[i]), int(next_start[j] - starts[i]) + SPAN - 1, int(sources[i]), int(places[i])) for i, j in zip(new, last, strict=True)]


SPANS = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,n_words:long,source:long,source_start:long>>"


def marked(docs: DataFrame, digest: bool, bits: int = 64) -> DataFrame:
    """doc_id, text (or digest columns), spans of each row of ``docs``; with few ``bits`` of an edge's hash, edges collide."""
    size = text_bytes(docs, "text")
    rows = dealt(docs, shard_count(size))
    spark = docs.sparkSession
    seeds = repeated_seeds(rows, bucket_count(size, 16))
    release(spark)
    edges = repeated_edges(rows, seeds, bucket_count(size, 12), bits)
    discard(seeds)
    release(spark)
    sources = path_sources(rows, edges, bits)
    release(spark)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long" if digest else SPANS
    names = [f.split()[0] for f in schema.split(", ")]
    fields = ("start", "n_words", "source", "source_start")
    last = pa.int64() if digest else pa.list_(pa.struct([(f, pa.int64()) for f in fields]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), last]

    def cut(key: tuple[pa.Scalar, ...], docs: pa.Table, told: pa.Table) -> pa.Table:
        trim()
        known = pc.is_valid(told.column("a"))
        edges = told.filter(pc.invert(known))
        graph = Graph(edges.column("hashes"), edges.column("docs"), bits)
        told = told.filter(known).sort_by([("a", "ascending"), ("b", "ascending")])
        a, b, source, place = (told.column(c).to_numpy() for c in ("a", "b", "source", "source_start"))
        texts = Texts(docs, keep=True)
        first, sizes, digests, owner = graph.paths(texts) if len(a) else graph.paths(Texts(docs.slice(0, 0), keep=True))
        at = np.searchsorted(a, digests[:, 0])
        while len(at):  # digests that share their first half follow one another
            where = at.clip(max=len(a) - 1)
            on = (at < len(a)) & (a[where] == digests[:, 0]) & (b[where] < digests[:, 1])
            if not on.any():
                at = where
                break
            at += on
        hit = np.flatnonzero((a[at] == digests[:, 0]) & (b[at] == digests[:, 1]) & (source[at] < texts.ids[owner])) if len(at) else at
        owner, starts, sizes, source, place = owner[hit], (first - texts.starts[owner])[hit], sizes[hit], source[at[hit]], place[at[hit]]
        cut_at, out = np.searchsorted(owner, np.arange(docs.num_rows + 1)).tolist(), []
        for i, d in enumerate(docs.column("doc_id").to_pylist()):
            lo, hi, n = cut_at[i], cut_at[i + 1], int(texts.sizes[i])
            base, last = int(texts.starts[i]), int(texts.ends[i])
            spans = spans_of(starts[lo:hi], sizes[lo:hi], source[lo:hi], place[lo:hi])
            parts, done, gone = [], 0, 0
            for start, length, *_ in spans:  # in order of their starts; they may overlap
                if start > done:
                    parts.append(texts.text[texts.start[base + done] : texts.stop[base + start - 1]])
                gone += max(0, start + length - max(done, start))
                done = max(done, start + length)
            if done < n:
                parts.append(texts.text[texts.start[base + done] : texts.stop[last - 1]])
            kept = b" ".join(parts)
            if digest:
                out.append((d, n, gone, hashlib.sha256(kept).hexdigest(), len(spans)))
            else:
                out.append((d, n, gone, kept.decode("utf-8", "surrogatepass"), [dict(zip(fields, s, strict=True)) for s in spans]))
        columns = zip(*out, strict=True) if out else [()] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    told = edges.unionByName(sources, allowMissingColumns=True)
    return rows.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(cut, schema)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_words, source, source_start of each span whose words a smaller document has at its source_start."""
    return marked(docs, digest=False).select("doc_id", F.inline("spans"))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space) and spans of each document."""
    return marked(docs, digest=False)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(table(spark, sf_dir, "documents"), digest=True).drop("n_spans")


ORACLES = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i,
         unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM d WHERE len(w) >= 13),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM m WHERE f < doc_id),
x AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.p) AS kept FROM u ANTI JOIN c ON u.doc_id = c.doc_id AND u.p = c.p GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(len(ps), 0)::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN k USING (doc_id)""",
}
QUERIES = {"op2_substring_dedup": op2_substring_dedup}
