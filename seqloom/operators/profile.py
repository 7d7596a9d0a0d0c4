"""Profile of the input: lengths, chunks, k-mer diversity, set similarity.

Sequences are rows (seq_ord, seq).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators import packed
from seqloom.shipping import ship

#: Fixed values of the chunk-size fit and its bounds, and of the fragment-length rule.
SCALE, POWER, LEAST, MOST = 1.7805e18, -3.2505, 100, 10000
DIVERSE, SHORT, LONG = 0.9, 16, 32
#: Symbols of a block that windows are cut from.
BLOCK = 64
#: Windows of a piece of a long sequence.
STEP = 1 << 15


def sequences(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    from seqloom.functions.symbols import as_sequence

    return rows.select(F.col(id_column).alias("seq_ord"), as_sequence(F.col(text_column)).alias("seq"))


def mean_length(seqs: DataFrame) -> DataFrame:
    return seqs.agg(F.coalesce(F.avg(F.length("seq")), F.lit(0.0)).alias("avg_len"))


def chunk_size(avg_len: Column) -> Column:
    """Sequences of a chunk; a mean length of 0 gives the largest chunk."""
    fit = F.floor(F.lit(SCALE) * F.pow(avg_len, F.lit(POWER)))
    return F.when(avg_len <= 0, F.lit(MOST)).otherwise(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), fit))).cast("int")


def chunks(seqs: DataFrame, n: int, bits: int = 10) -> DataFrame:
    """seqs with chunk_id (from 1) and seq_idx (from 0 within the chunk), in order of seq_ord.

    Numbering runs in two steps, within ranges of 2^bits ids and over the ranges' counts, so no task sorts all rows.
    """
    rows = seqs.withColumn("range", F.shiftright("seq_ord", bits))
    counts = rows.groupBy("range").agg(F.count(F.lit(1)).alias("c"))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    bases = counts.select("range", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("range").orderBy("seq_ord")) - 1
    rows = rows.withColumn("local", local).join(bases, "range")
    place = F.col("base") + F.col("local")
    return rows.select(*seqs.columns, (F.floor(place / n) + 1).cast("int").alias("chunk_id"), (place % n).cast("int").alias("seq_idx"))


def windows(seqs: DataFrame, k: int, *columns: str) -> DataFrame:
    """All runs of k symbols: seq_ord, columns, pos, fragment, last (the sequence's last position).

    Shorter sequences have none.  Long sequences are first cut into overlapping blocks, as finding a place in a string
    takes time in proportion to the place.
    """
    rows = seqs.where(F.length("seq") >= k).withColumn("last", F.length("seq") - k)
    blocks = rows.select("seq_ord", *columns, "last", "seq", F.explode(F.sequence(F.lit(0), "last", F.lit(BLOCK))).alias("start"))
    blocks = blocks.select("seq_ord", *columns, "last", "start", F.substring("seq", F.col("start") + 1, F.lit(BLOCK + k - 1)).alias("block"))
    cut = F.transform(F.sequence(F.lit(0), F.length("block") - k), lambda i: F.substring("block", i + 1, F.lit(k)))
    found = blocks.select("seq_ord", *columns, "last", "start", F.posexplode(cut).alias("at", "fragment"))
    return found.select("seq_ord", *columns, (F.col("start") + F.col("at")).alias("pos"), "fragment", "last")


def pieces(seqs: DataFrame, k: int, *columns: str, step: int = STEP, margin: int = 0) -> DataFrame:
    """Sequences cut so that each window begins in one piece: columns, seq_ord, last, piece, start, text.

    Piece p holds the windows from p * step up to the next piece, and ``margin`` more at both sides.
    """
    rows = seqs.where(F.length("seq") >= k).withColumn("last", F.length("seq") - k)
    rows = rows.select(*columns, "seq_ord", "last", "seq", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / step).cast("int"))).alias("piece"))
    rows = rows.withColumn("start", F.greatest(F.col("piece") * step - margin, F.lit(0)))
    size = (F.col("piece") + 1) * step - F.col("start") + margin + k - 1
    return rows.select(*columns, "seq_ord", "last", "piece", "start", F.substring("seq", F.col("start") + 1, size).alias("text"))


def kmer_tallies(seqs: DataFrame, k: int) -> DataFrame:
    """n, n_kmers, first_kmer: how many k-mers occur n times, and the first of them.

    Up to 32 symbols, k-mers travel in packed pieces of their sequences (about 1.5 bytes a symbol), each to the bucket of its
    minimizer, and are counted there; repeated pieces of a task are sent once, with their number.
    """
    if k > 32:
        per = windows(seqs, k).groupBy("fragment").agg(F.count(F.lit(1)).alias("n"))
        return per.groupBy("n").agg(F.count(F.lit(1)).alias("n_kmers"), F.min("fragment").alias("first_kmer"))
    ship(seqs.sparkSession)
    sent = pieces(seqs, k).select("text").mapInArrow(packed.sent_kmers(k), "bucket int, high binary, low binary, n binary, times binary, fragment string, count long")
    found = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(packed.tallied_kmers(k), "n long, n_kmers long, first_kmer string")
    return found.groupBy("n").agg(F.sum("n_kmers").alias("n_kmers"), F.min("first_kmer").alias("first_kmer"))


def kmer_diversity(seqs: DataFrame, k: int = 32, sample: int | None = None, seed: int = 0) -> DataFrame:
    """total, distinct and their ratio (0 without k-mers); optionally of a seeded sample of sequences."""
    per = kmer_tallies(sampled(seqs, sample, seed), k)
    totals = per.agg(F.coalesce(F.sum(F.col("n") * F.col("n_kmers")), F.lit(0)).alias("total"), F.coalesce(F.sum("n_kmers"), F.lit(0)).alias("distinct_kmers"))
    ratio = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("distinct_kmers") / F.col("total"))
    return totals.select("total", "distinct_kmers", ratio.alias("ratio"))


def fragment_length(ratio: Column, given: int | None = None, large: bool = False) -> Column:
    if given:
        return F.lit(given)
    return F.lit(LONG) if large else F.when(ratio >= DIVERSE, F.lit(SHORT)).otherwise(F.lit(LONG))


def kmer_set_sizes(seqs: DataFrame, k: int) -> DataFrame:
    """seq_ord, n_kmers of sequences with any; the sequences are dealt out, not their windows."""
    ship(seqs.sparkSession)
    rows = seqs.where(F.length("seq") >= k).select("seq_ord", "seq").repartition("seq_ord").sortWithinPartitions("seq_ord")
    return rows.mapInArrow(packed.set_sizes(k), "seq_ord long, n_kmers long")


def sampled(seqs: DataFrame, sample: int | None, seed: int = 0) -> DataFrame:
    """All sequences, or a seeded sample of so many."""
    return seqs if sample is None else seqs.orderBy(F.xxhash64(F.lit(seed), "seq_ord"), "seq_ord").limit(sample)


def jaccard_pairs(seqs: DataFrame, k: int) -> DataFrame:
    """a, b (a < b), jaccard of the k-mer sets of all pairs that share a k-mer; all other pairs have 0 (or 1, if both are empty)."""
    sets = windows(seqs, k).select("seq_ord", "fragment").distinct()
    sizes = sets.groupBy("seq_ord").agg(F.count(F.lit(1)).alias("n"))
    a, b = sets.select(F.col("seq_ord").alias("a"), "fragment"), sets.select(F.col("seq_ord").alias("b"), "fragment")
    shared = a.join(b, "fragment").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    x, y = sizes.select(F.col("seq_ord").alias("a"), F.col("n").alias("na")), sizes.select(F.col("seq_ord").alias("b"), F.col("n").alias("nb"))
    return shared.join(x, "a").join(y, "b").select("a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def mean_jaccard(seqs: DataFrame, k: int, sample: int | None = None, seed: int = 0) -> DataFrame:
    """Mean over all pairs (of a seeded sample); fewer than two sequences give 1.  Pairs that share nothing are only counted."""
    seqs = sampled(seqs, sample, seed)
    n = seqs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.length("seq"), F.lit(0)) < k).alias("empty"), F.lit(0.0).alias("total"))
    shared = jaccard_pairs(seqs, k).agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("empty"), F.coalesce(F.sum("jaccard"), F.lit(0.0)).alias("total"))
    both = n.unionByName(shared).agg(*[F.sum(c).alias(c) for c in ("n", "empty", "total")])  # two rows
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    return both.select(F.when(F.col("n") < 2, F.lit(1.0)).otherwise((F.col("total") + pairs("empty")) / pairs("n")).alias("mean_jaccard"))


def mean_jaccard_of_samples(seqs: DataFrame, k: int, sample: int, samples: int) -> DataFrame:
    """Mean of the means of several seeded samples."""
    means = [mean_jaccard(seqs, k, sample, seed) for seed in range(samples)]
    rows = means[0]
    for more in means[1:]:
        rows = rows.unionByName(more)
    return rows.agg(F.avg("mean_jaccard").alias("mean_jaccard"))
