"""N-gram Jaccard join: documents whose sets of 5-word shingles overlap by at least 80 %.

Equal sets are one class, and a class is one row of a sparse matrix of documents by n-grams.  The product of the matrix
with its transpose is formed in blocks, only where two rows can reach the bound:

1. shards count in how many shards each n-gram occurs (packed fingerprints, sent to hash buckets and answered);
2. each class brings its prefix, the n - ceil(0.8 n) + 1 rarest n-grams: rows that link share one.  N-grams found in one
   shard and one document only can't be shared and stay home.  Each bucket ties the rows of an n-gram together, leaving
   out pairs that their sizes and places in the prefixes rule out;
3. rows tied together form a group.  Groups are cut into blocks of bounded size, and each pair of
   blocks accumulates overlap counts over column blocks.  Pairs below the size-derived bound are discarded there;
   links leave as a spanning forest, so a group of thousands of near copies never becomes a list of all its pairs.

Components of the ties and of the links come from rounds of joins (large star, small star) on written tables.

N-grams are compared by 64-bit hashes; the fingerprints of step 1 only order them.

Edge cases: null text or text without words has an empty set and links with nothing; with fewer than five words the
whole sequence is the one shingle; repeated rows are documents of one class; a null ``doc_id`` takes part, and is the
smallest of its component only if all are null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, release, table, text_bytes, trim
from .shards import bucket_count, bucket_of, dealt, joined, shard_count
from .shingles import hash_words, mix, multipliers, split_words, window_hashes
from .substring_dedup import TOLD, tell, within

WORDS, PERCENT = 5, 80
FACTORS = multipliers(WORDS, 5)
#: Rows of an n-gram up to which all pairs are looked at one by one; rows and set entries of a block; columns of a block.
FEW, BLOCK, ENTRIES, COLUMNS = 48, 1024, 1 << 20, 2048
#: Set entries that one task of step 3 holds, about.
BIN_ENTRIES = 4 << 20


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct n-grams of a text, ascending by hash."""
    words = split_words(text, lower=True)
    h = hash_words(words)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return mix(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 7)], np.uint64))
    return np.unique(window_hashes(h, FACTORS))


def least_overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Smallest shared count with which sets of n and m link: 100 s >= PERCENT (n + m - s)."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def class_of(s: np.ndarray) -> int:
    """Number of the class of equal sets."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) - (1 << 63)


# ---- step 1: classes, and which n-grams occur elsewhere


def fingerprint_shift(text_size: int) -> int:
    """Fingerprints keep 10 bits more than it takes to number all words of the text (6 bytes each, about)."""
    return max(0, 64 - (max(1, text_size // 6).bit_length() + 10))


FOUND = "kind int, shard int, bucket int, doc long, n long, rep long, key long, prints binary"


def classes_and_prints(rows: DataFrame, buckets: int, shift: int) -> DataFrame:
    """Rows of two kinds: 0, a document with its class; 1, a shard's fingerprints for a bucket."""
    names = [f.split()[0] for f in FOUND.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def look(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        trim()
        shard, out, seen = key[0].as_py(), [], {}
        for doc, text, text_key in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "text", "key")), strict=True):
            s = shingle_set(text)
            c = class_of(s)
            out.append((0, shard, None, doc, len(s), c, text_key, None))
            if len(s):
                seen[c] = s
        prints, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *seen.values()]) >> np.uint64(shift), return_counts=True)
        bucket = bucket_of(prints << np.uint64(shift), buckets)
        starts = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(starts)).tolist():
            some = prints[starts[b] : starts[b + 1]]
            # fingerprints in few bytes: differences of an ascending list, and a mark for those found twice here
            steps = np.diff(some, prepend=np.uint64(0)) << np.uint64(1) | (counts[starts[b] : starts[b + 1]] > 1).astype(np.uint64)
            out.append((1, shard, b, None, None, None, None, narrow(steps)))
        columns = zip(*out, strict=True) if out else [()] * 8
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return rows.groupBy("shard").applyInArrow(look, FOUND)


def narrow(values: np.ndarray) -> bytes:
    """64-bit numbers in as few whole bytes each as the largest but the first needs (little-endian, width ahead)."""
    width = max(1, (int(values[1:].max()).bit_length() + 7) // 8) if len(values) > 1 else 8
    head = values[:1].tobytes()
    return bytes([width]) + head + values[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widen(data: bytes) -> np.ndarray:
    width, head = data[0], np.frombuffer(data[1:9], "<u8")
    raw = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    rest = np.zeros((len(raw), 8), np.uint8)
    rest[:, :width] = raw
    return np.concatenate([head, rest.view("<u8").ravel()])


def shared_prints(found: DataFrame) -> DataFrame:
    """shard, hashes (fingerprints that occur elsewhere or twice), docs (in how many shards)."""

    def answer(key: tuple[pa.Scalar, ...], asked: pa.Table) -> pa.Table:
        trim()
        prints, many, lengths = [], [], []
        for data in asked.column("prints").to_pylist():
            steps = widen(data)
            prints.append(np.cumsum(steps >> np.uint64(1), dtype=np.uint64))
            many.append((steps & np.uint64(1)).astype(bool))
            lengths.append(len(steps))
        shards = np.repeat(asked.column("shard").to_numpy(), lengths)
        prints, many = np.concatenate(prints), np.concatenate(many)
        known, counts = np.unique(prints, return_counts=True)
        count = counts[np.searchsorted(known, prints)]
        wanted = (count > 1) | many
        return tell(shards[wanted], prints[wanted], count[wanted].astype("<i8"))

    return found.where("kind = 1").select("bucket", "shard", "prints").groupBy("bucket").applyInArrow(answer, TOLD)


# ---- step 2: prefixes and ties

PREFIX = "hash long, rep long, n int, place int"


def prefixes(rows: DataFrame, shared: DataFrame, shift: int) -> DataFrame:
    """The n-grams of each class's prefix that occur elsewhere, once for each shard that has the class."""
    names = [f.split()[0] for f in PREFIX.split(", ")]

    def look(key: tuple[pa.Scalar, ...], docs: pa.Table, told: pa.Table) -> pa.Table:
        trim()
        prints, count = joined(told.column("hashes"), "<u8")[0], joined(told.column("docs"), "<i8")[0]
        order = np.argsort(prints)
        prints, count = prints[order], count[order]
        parts: list[tuple] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))]
        seen = set()
        for text in docs.column("text").to_pylist():
            s = shingle_set(text)
            rep = class_of(s)
            if rep in seen or not len(s):
                continue
            seen.add(rep)
            known, at = within(s >> np.uint64(shift), prints)
            often = np.where(known, count[at] if len(count) else 0, 0)
            length = len(s) - math.ceil(len(s) * PERCENT / 100) + 1
            order = np.lexsort((s, often))[:length]
            places = np.flatnonzero(often[order] > 0).astype(np.int32)
            own = s[order[places]]
            parts.append((own, np.full(len(own), rep, np.int64), np.full(len(own), len(s), np.int32), places))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.table([columns[0].view(np.int64), *columns[1:]], names)

    return rows.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(look, PREFIX)


def tie_rows(prefix: DataFrame) -> DataFrame:
    """src, dst: rows that may link.  N-grams with few rows tie the pairs that sizes and places allow; with more rows, an
    n-gram ties neighbours by size as long as the sizes allow a link, which joins the same rows into one group."""
    entries = prefix.groupBy("hash", "rep").agg(F.first("n").alias("n"), F.first("place").alias("place"))
    counts = entries.groupBy("hash").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    entries = entries.join(counts, "hash")
    few = entries.where(F.col("rows") <= FEW).groupBy("hash").agg(F.collect_list(F.struct("rep", "n", "place")).alias("list"))
    both = few.select("list", F.explode("list").alias("a")).select("a", F.explode("list").alias("b")).where("a.rep < b.rep")
    x, y = F.col("a"), F.col("b")
    most = F.least(x["place"], y["place"]) + F.least(x["n"] - x["place"], y["n"] - y["place"])
    allowed = (100 + PERCENT) * most >= PERCENT * (x["n"] + y["n"])
    pairs = both.where(allowed).select(x["rep"].alias("src"), y["rep"].alias("dst"))
    # Salted by size class, so that a frequent n-gram's rows spread; neighbouring classes are chained by their ends.
    size = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / PERCENT))
    many = entries.where(F.col("rows") > FEW).select("hash", "rep", size.alias("size"), F.pmod(F.xxhash64("rep"), F.lit(64)).alias("salt"))
    heads = many.groupBy("hash", "size", "salt").agg(F.min("rep").alias("head"))
    least = heads.groupBy("hash", "size").agg(F.min("head").alias("least"))
    to_head = many.join(heads, ["hash", "size", "salt"]).select(F.col("rep").alias("dst"), F.col("head").alias("src"))
    to_least = heads.join(least, ["hash", "size"]).select(F.col("head").alias("dst"), F.col("least").alias("src"))
    below = least.select("hash", (F.col("size") + 1).alias("size"), F.col("least").alias("below"))
    chain = least.join(below, ["hash", "size"]).select(F.col("least").alias("dst"), F.col("below").alias("src"))
    ties = pairs
    for more in (to_head, to_least, chain):
        ties = ties.unionByName(more)
    return ties.where("src <> dst").distinct()


def components(links: DataFrame, name: str) -> DataFrame:
    """id, component (smallest id reachable) of every end of the links src, dst.

    Rounds of large star and small star; each round's links are written, and rounds end when they no longer change.
    """
    now = materialise(links.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a <> b").distinct(), name)
    state = None
    while True:
        # large star: every larger neighbour of a node goes to the node's smallest neighbour or itself
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = materialise(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), name)
        seen = after.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if tuple(seen) == state:
            break
        now, state = after, tuple(seen)
    leaves = after.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return leaves.unionByName(after.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


# ---- step 3: products of blocks


def accumulate(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Overlap counts of all rows of two blocks (or of one with itself), summed over blocks of columns."""
    rows = left + (right or [])
    hashes = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1  # columns with one entry count for nothing
    entry = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[entry]], owner[entry]
    split, total = len(left), np.zeros((len(left), len(right or left)))  # whole numbers, exact far beyond any set's size
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        block = np.zeros((len(rows), COLUMNS), np.float32)
        block[owner[lo:hi], column[lo:hi] - at] = 1
        total += block[:split] @ (block[split:] if right else block).T
    return total


def forest(a: np.ndarray, b: np.ndarray, size: int) -> list[int]:
    """Places of those links that join what earlier ones don't."""
    root = list(range(size))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return kept


LINKS = "src long, dst long, links long"


def block_links(reps: list[int], weights: list[int], sets: list[np.ndarray], split: int | None) -> list[tuple]:
    """(src, dst, 0) of a spanning forest of the links, and (row, null, n) for the number of a row's links here."""
    left, right = (sets, None) if split is None else (sets[:split], sets[split:])
    n = np.array([len(s) for s in sets], np.int64)
    first, second = (n, n) if split is None else (n[:split], n[split:])
    overlap = accumulate(left, right).astype(np.int64)
    hit = overlap >= least_overlap(first[:, None], second[None, :])
    if split is None:
        np.fill_diagonal(hit, False)
    w = np.array(weights, np.int64)
    counts = hit @ (w if split is None else w[split:])
    out = [(reps[i], None, int(c)) for i, c in enumerate(counts.tolist()) if c]
    a, b = np.nonzero(np.triu(hit) if split is None else hit)
    if split is not None:
        back = w[:split] @ hit
        out += [(reps[split + i], None, int(c)) for i, c in enumerate(back.tolist()) if c]
        b = b + split
    return out + [(reps[a[k]], reps[b[k]], 0) for k in forest(a, b, len(reps))]


def links_of(sets: DataFrame, entries: int) -> DataFrame:
    """Links of the rows tie (their group), block, blocks (of the group), rep, weight, set."""
    bins = int(max(16, entries // BIN_ENTRIES + 1))
    # A group of one block goes to a bin with others; each pair of blocks of a larger group is a task of its own.
    alone = sets.where("blocks = 1").withColumn("bin", F.pmod(F.xxhash64("tie"), F.lit(bins)))
    alone = alone.select("bin", F.lit(0).alias("i"), F.lit(0).alias("j"), "block", "tie", "rep", "weight", "set")
    paired = sets.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "other") + 1, F.greatest("block", "other") + 1
    paired = paired.select(F.col("tie").alias("bin"), i.alias("i"), j.alias("j"), "block", "tie", "rep", "weight", "set")
    names, kinds = ["src", "dst", "links"], [pa.int64()] * 3

    def multiply(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        trim()
        groups: dict[int, list[tuple]] = {}
        for tie, block, rep, weight, data in zip(*(part.column(c).to_pylist() for c in ("tie", "block", "rep", "weight", "set")), strict=True):
            groups.setdefault(tie, []).append((block, rep, weight, np.frombuffer(data, "<u8")))
        across, out = key[1].as_py() != key[2].as_py(), []
        for group in groups.values():
            group.sort(key=lambda r: r[:2])
            _, reps, weights, own = zip(*group, strict=True)
            split = sum(r[0] == group[0][0] for r in group) if across else None
            if split != len(group):  # else the other block is empty
                out += block_links(list(reps), list(weights), list(own), split)
        columns = zip(*out, strict=True) if out else [()] * 3
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return alone.unionByName(paired).groupBy("bin", "i", "j").applyInArrow(multiply, LINKS)


SETS = "tie long, block int, blocks int, rep long, weight long, set binary"


def sets_of(rows: DataFrame, info: DataFrame) -> DataFrame:
    """The sets of the classes in ``info``, each from the one document it names."""
    names = [f.split()[0] for f in SETS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def look(key: tuple[pa.Scalar, ...], docs: pa.Table, wanted: pa.Table) -> pa.Table:
        trim()
        by_rep = {r["rep"]: r for r in wanted.to_pylist()}
        ids, out = {r["doc"] for r in by_rep.values()}, []
        for doc, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True):
            if doc in ids:
                s = shingle_set(text)
                if r := by_rep.pop(class_of(s), None):
                    out.append((r["tie"], r["block"], r["blocks"], r["rep"], r["weight"], s.tobytes()))
        columns = zip(*out, strict=True) if out else [()] * 6
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return rows.groupBy("shard").cogroup(info.groupBy("shard")).applyInArrow(look, SETS)


def row_groups(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), n_shingles, group, component_id, n_links of each row of ``docs``; no group without words."""
    spark = docs.sparkSession
    size = text_bytes(docs, "text")
    rows, shift = dealt(docs.select("doc_id", "text", F.xxhash64("text").alias("key")), shard_count(size), "key"), fingerprint_shift(size)
    found = materialise(classes_and_prints(rows, bucket_count(size, 6), shift), "sets")
    release(spark)
    shared = materialise(shared_prints(found), "shared")
    members = found.where("kind = 0").select(F.col("doc").alias("doc_id"), "key", F.col("n").alias("n_shingles"), "rep", "shard")
    members = materialise(members, "members")
    discard(found)
    release(spark)
    classes = members.groupBy("rep").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("weight"), F.min(F.struct("shard", "doc_id")).alias("at"), F.max("n_shingles").alias("n")
    )
    classes = materialise(classes, "classes")
    prefix = materialise(prefixes(rows, shared, shift), "prefixes")
    discard(shared)
    release(spark)
    tied = components(tie_rows(prefix), "ties").select(F.col("id").alias("rep"), F.col("component").alias("tie"))
    info = classes.join(tied, "rep")
    blocks = info.groupBy("tie").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(ENTRIES))).cast("int").alias("blocks"))
    info = info.join(blocks, "tie").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    info = materialise(info.select("tie", "block", "blocks", "rep", "weight", "n", F.col("at.shard").alias("shard"), F.col("at.doc_id").alias("doc")), "blocks")
    entries = info.agg(F.sum("n")).first()[0] or 0
    links = materialise(links_of(sets_of(rows, info), entries), "links")
    release(spark)
    degrees = links.where("dst IS NULL").groupBy("src").agg(F.sum("links").alias("degree"))
    joined_reps = components(links.where("dst IS NOT NULL").select("src", "dst"), "links")
    classes = classes.join(degrees, F.col("rep") == F.col("src"), "left").join(joined_reps, F.col("rep") == F.col("id"), "left")
    classes = classes.withColumn("group", F.coalesce("component", "rep"))
    smallest = classes.groupBy("group").agg(F.min("first").alias("component_id"))
    classes = classes.join(smallest, "group").select(
        F.col("rep").alias("of"), "group", "component_id", (F.coalesce("degree", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    result = members.join(classes, F.col("rep") == F.col("of"))
    empty = F.col("n_shingles") == 0
    return result.select(
        "doc_id", "key", "n_shingles", F.when(~empty, F.col("group")).alias("group"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(empty, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    )


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other documents it links with) of each row of ``docs``."""
    return row_groups(docs).select("doc_id", "n_shingles", "component_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each group one row stays, that with the smallest ``doc_id`` (nulls last; then the smallest hash of the text); rows
    without words all stay.  Rows are told apart by id and text; of wholly alike ones of a group one stays."""
    groups = row_groups(docs.select("doc_id", "text")).where("group IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    first = groups.groupBy("group").agg(F.min(order).alias("first"))
    members = groups.groupBy("group", "doc_id", "key").agg(F.count(F.lit(1)).alias("n")).join(first, "group")
    stays = members["doc_id"].eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    # what happens to rows: only those that don't simply stay
    verdicts = members.select("doc_id", "key", F.when(stays, F.lit("one")).otherwise(F.lit("none")).alias("verdict"), "n").where("verdict = 'none' OR n > 1")
    verdicts = materialise(verdicts.select(F.col("doc_id").alias("of_id"), F.col("key").alias("of_key"), "verdict"), "verdicts")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_key"))
    judged = rows.join(verdicts, F.col("own_id").eqNullSafe(F.col("of_id")) & (F.col("own_key") == F.col("of_key")), "left")
    kept = judged.where("verdict IS NULL").select("row")
    if not verdicts.where("verdict = 'one'").isEmpty():
        kept = kept.unionByName(judged.where("verdict = 'one'").dropDuplicates(["own_id", "own_key"]).select("row"))
    return kept.select("row.*")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, one by one: for small tables.
ORACLES = {
    "op1_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * k >= 80 * (len(x.g) + len(y.g) - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS doc_id, count(*) AS links FROM u GROUP BY a)
SELECT doc_id, len(g)::bigint AS n_shingles, component_id, coalesce(links, 0)::bigint AS n_links FROM s JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
}
QUERIES = {"op1_ngram_join": op1_ngram_join}
