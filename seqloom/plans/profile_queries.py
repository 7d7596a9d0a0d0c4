"""Queries over the profile of the input: scans, lengths, chunks, k-mers, similarity, functions, islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import symbols
from seqloom.operators import islands, profile
from seqloom.plans.storage import shared_path
from seqloom.sources.fasta import read_fasta, write_fasta

CHUNK, K = 100, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores where the files alone would leave some idle; large inputs stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sequences(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sequences(table(spark, sf_dir, "benchmark"), "item_id", "text")


def sequence_expression(text: str) -> str:
    return f"""translate(lower(regexp_replace(coalesce({text}, ''), '[^A-Za-z]', '', 'g')),
      'abcdefghijklmnopqrstuvwxyz', 'ATCGATCGATCGATCGATCGATCGAT')"""


def sequence_sql(source: str, key: str, name: str = "s") -> str:
    return f"{name} AS (SELECT {key} AS seq_ord, {sequence_expression('text')} AS seq FROM {source})"


def window_sql(k: int, source: str = "s", name: str = "w", extra: str = "") -> str:
    return f"""{name} AS (SELECT seq_ord{extra}, i AS pos, substr(seq, i + 1, {k}) AS fragment, length(seq) - {k} AS last
      FROM (SELECT *, unnest(range(0, length(seq) - {k} + 1)) AS i FROM {source} WHERE length(seq) >= {k}))"""


S, R = sequence_sql("documents", "doc_id"), sequence_sql("benchmark", "item_id")


def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences written as FASTA, one folder for each chunk, and read back."""
    path = shared_path(spark, "fasta")
    chunked = profile.chunks(seqs(spark, sf_dir), CHUNK)
    write_fasta(chunked, path, "seq_ord", by="chunk_id")
    rows = read_fasta(spark, path, clean=True)
    return rows.select(F.col("seq_id").cast("long").alias("seq_ord"), F.length("seq").cast("long").alias("len"), F.md5(F.col("seq").cast("binary")).alias("md5"))


def fasta_records(spark, sf_dir):
    """Every nation and region name as a record in a folder of its own, read back by a glob."""
    path = shared_path(spark, "records")
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("name")))
    rows = names.select(F.regexp_replace("name", " ", "_").alias("seq_id"), symbols.as_sequence(F.col("name")).alias("seq"))
    write_fasta(rows.withColumn("record", F.col("seq_id")), path, by="record")
    return read_fasta(spark, f"{path}/record=*/*.txt").select("header", "seq_id", "seq")


def seq_lengths(spark, sf_dir):
    return seqs(spark, sf_dir).select("seq_ord", F.length("seq").cast("long").alias("len"))


def avg_length_chunk_size(spark, sf_dir):
    mean = profile.mean_length(seqs(spark, sf_dir))
    return mean.select(F.round("avg_len", 6).alias("avg_len"), profile.chunk_size(F.col("avg_len")).cast("long").alias("chunk_size"))


def chunk_assign(spark, sf_dir):
    return profile.chunks(seqs(spark, sf_dir), CHUNK).select("seq_ord", F.col("chunk_id").cast("long"), F.col("seq_idx").cast("long"))


def chunk_summary(spark, sf_dir):
    rows = profile.chunks(seqs(spark, sf_dir), CHUNK).groupBy(F.col("chunk_id").cast("long").alias("chunk_id"))
    return rows.agg(F.count(F.lit(1)).alias("n_seqs"), F.sum(F.length("seq")).alias("total_len"))


def kmer_counts(spark, sf_dir):
    """How many k-mers occur how often."""
    return profile.kmer_tallies(seqs(spark, sf_dir), profile.LONG)


def kmer_diversity(spark, sf_dir):
    return profile.kmer_diversity(seqs(spark, sf_dir)).select("total", "distinct_kmers", F.round("ratio", 6).alias("ratio"))


def fragment_length_choice(spark, sf_dir):
    rows = profile.kmer_diversity(seqs(spark, sf_dir))
    return rows.select(profile.fragment_length(F.col("ratio")).cast("long").alias("fragment_length"))


def kmer_set_size(spark, sf_dir):
    return profile.kmer_set_sizes(seqs(spark, sf_dir), 21)


def jaccard_pairs(spark, sf_dir):
    return profile.jaccard_pairs(reads(spark, sf_dir), 6).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


def mean_jaccard(spark, sf_dir):
    return profile.mean_jaccard(reads(spark, sf_dir), 6).select(F.round("mean_jaccard", 9).alias("mean_jaccard"))


def unambiguous_filter(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    return words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.count_if(symbols.unambiguous(F.col("word"))).alias("n_unambiguous"))


def pack_unpack(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(symbols.pack(F.col("l_orderkey"), F.col("l_linenumber")).alias("packed"))
    return rows.select("packed", symbols.high_bits(F.col("packed")).alias("high"), symbols.low_bits(F.col("packed")).alias("low"))


def symbol_codes(spark, sf_dir):
    cells = seqs(spark, sf_dir).select(F.explode(F.split("seq", "")).alias("symbol")).where("symbol <> ''")
    counts = cells.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    codes = [symbols.code_of(F.col("symbol"), a).cast("long") for a in (symbols.ALIGNED, symbols.EMITTED)]
    return counts.select("symbol", "n", codes[0].alias("aligned_code"), codes[1].alias("emitted_code"))


def with_backbone(spark: SparkSession, sf_dir: str, k: int = 8) -> tuple[DataFrame, str, int]:
    """All sequences, the backbone (the longest of them), and the length of the windows to anchor on it."""
    rows = seqs(spark, sf_dir)
    backbone = rows.orderBy(F.length("seq").desc(), "seq_ord").select("seq").first()
    return rows, backbone["seq"] if backbone else "", k


ANCHORS = f"""{S}, {window_sql(8)}, b AS (SELECT seq_ord FROM s ORDER BY length(seq) DESC, seq_ord LIMIT 1),
p AS (SELECT fragment, min(pos) AS val FROM w WHERE seq_ord = (SELECT seq_ord FROM b) GROUP BY fragment HAVING count(*) = 1),
a AS (SELECT seq_ord, pos AS idx, val FROM w LEFT JOIN p USING (fragment))"""
ISLAND_SUMS = "count(*)::bigint AS n_blocks, sum(weight)::bigint AS weight, sum(v0)::bigint AS v0, sum(i1)::bigint AS i1, sum(diff)::bigint AS diff"


def island_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("seq_ord").agg(F.count(F.lit(1)).alias("n_blocks"), *[F.sum(c).alias(c) for c in ("weight", "v0", "i1", "diff")])


def islands_strict(spark, sf_dir):
    return island_sums(islands.strict_islands_of_windows(*with_backbone(spark, sf_dir)))


def islands_diagonal(spark, sf_dir):
    return island_sums(islands.diagonal_islands_of_windows(*with_backbone(spark, sf_dir)))


def null_runs(spark, sf_dir):
    rows = islands.null_runs_of_windows(*with_backbone(spark, sf_dir)).groupBy("seq_ord")
    return rows.agg(F.count(F.lit(1)).alias("n_runs"), F.sum(F.col("last") - F.col("first") + 1).alias("n_null"), F.sum("before").alias("before"), F.coalesce(F.sum("after"), F.lit(0)).alias("after"))


def interval_union(spark, sf_dir):
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000))
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("grp"), F.col("event_id").alias("payload"), hour.alias("lo"), (hour + F.floor("value") % 4).alias("hi")
    )
    return islands.interval_union(rows)


ISLANDS_SQL = """WITH {anchors},
v AS (SELECT *, val - idx AS diff, {new} AS new FROM a WHERE val IS NOT NULL WINDOW o AS (PARTITION BY seq_ord ORDER BY idx)),
i AS (SELECT *, sum(coalesce(new, true)::int) OVER (PARTITION BY seq_ord ORDER BY idx) AS island FROM v),
g AS (SELECT seq_ord, min(val) AS v0, max(val) AS v1, min(idx) AS i0, max(idx) AS i1, min(diff) AS diff, count(*) AS n FROM i GROUP BY seq_ord, island)
SELECT seq_ord, {sums} FROM (SELECT *, {weight} AS weight FROM g) GROUP BY seq_ord"""

QUERIES = {
    f.__name__: f
    for f in (
        fasta_round_trip, seq_lengths, avg_length_chunk_size, chunk_assign, chunk_summary, kmer_counts, kmer_diversity, fragment_length_choice, kmer_set_size,
        fasta_records, jaccard_pairs, mean_jaccard, unambiguous_filter, pack_unpack, symbol_codes, islands_strict, islands_diagonal, null_runs, interval_union,
    )
}

DIVERSITY = f"WITH {S}, {window_sql(32)}, t AS (SELECT count(*)::bigint AS total, count(DISTINCT fragment)::bigint AS distinct_kmers FROM w)"
PAIRS = f"""WITH {R}, {window_sql(6)}, d AS (SELECT DISTINCT seq_ord, fragment FROM w),
n AS (SELECT s.seq_ord, count(fragment) AS n FROM s LEFT JOIN d USING (seq_ord) GROUP BY ALL),
c AS (SELECT x.seq_ord AS a, y.seq_ord AS b, count(*) AS shared FROM d x JOIN d y ON x.fragment = y.fragment AND x.seq_ord < y.seq_ord GROUP BY ALL),
j AS (SELECT x.seq_ord AS a, y.seq_ord AS b, CASE WHEN x.n + y.n = 0 THEN 1.0 ELSE coalesce(shared, 0) / (x.n + y.n - coalesce(shared, 0)) END AS jaccard, shared
  FROM n x JOIN n y ON x.seq_ord < y.seq_ord LEFT JOIN c ON c.a = x.seq_ord AND c.b = y.seq_ord)"""
ORACLES = {
    "fasta_round_trip": f"WITH {S} SELECT seq_ord, length(seq)::bigint AS len, md5(seq) AS md5 FROM s",
    "seq_lengths": f"WITH {S} SELECT seq_ord, length(seq)::bigint AS len FROM s",
    "avg_length_chunk_size": f"""WITH {S}, m AS (SELECT coalesce(avg(length(seq)), 0) AS a FROM s)
SELECT round(a, 6) AS avg_len, CASE WHEN a <= 0 THEN 10000 ELSE greatest(100, least(10000, floor(1.7805e18 * pow(a, -3.2505)))) END::bigint AS chunk_size FROM m""",
    "chunk_assign": f"""WITH {S}, n AS (SELECT seq_ord, row_number() OVER (ORDER BY seq_ord) - 1 AS p FROM s)
SELECT seq_ord, (p // 100 + 1)::bigint AS chunk_id, (p % 100)::bigint AS seq_idx FROM n""",
    "chunk_summary": f"""WITH {S}, n AS (SELECT seq, row_number() OVER (ORDER BY seq_ord) - 1 AS p FROM s)
SELECT (p // 100 + 1)::bigint AS chunk_id, count(*)::bigint AS n_seqs, sum(length(seq))::bigint AS total_len FROM n GROUP BY ALL""",
    "kmer_counts": f"""WITH {S}, {window_sql(32)}, c AS (SELECT fragment, count(*)::bigint AS n FROM w GROUP BY fragment)
SELECT n, count(*)::bigint AS n_kmers, min(fragment) AS first_kmer FROM c GROUP BY n""",
    "kmer_diversity": f"{DIVERSITY} SELECT total, distinct_kmers, round(CASE WHEN total = 0 THEN 0.0 ELSE distinct_kmers / total END, 6) AS ratio FROM t",
    "fragment_length_choice": f"{DIVERSITY} SELECT CASE WHEN total > 0 AND distinct_kmers / total >= 0.9 THEN 16 ELSE 32 END::bigint AS fragment_length FROM t",
    "kmer_set_size": f"WITH {S}, {window_sql(21)} SELECT seq_ord, count(DISTINCT fragment)::bigint AS n_kmers FROM w GROUP BY seq_ord",
    "fasta_records": f"""WITH n AS (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region)
SELECT replace(name, ' ', '_') AS header, replace(name, ' ', '_') AS seq_id, {sequence_expression('name')} AS seq FROM n""",
    "jaccard_pairs": f"{PAIRS} SELECT a, b, round(jaccard, 9) AS jaccard FROM j WHERE shared > 0",
    "mean_jaccard": f"{PAIRS} SELECT round(coalesce(avg(jaccard), 1), 9) AS mean_jaccard FROM j",
    "unambiguous_filter": """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents)
SELECT doc_id, count(*)::bigint AS n_words, count_if(regexp_full_match(word, '[ATCGatcg]*'))::bigint AS n_unambiguous FROM w GROUP BY doc_id""",
    "pack_unpack": """SELECT (l_orderkey * 4294967296 + l_linenumber)::bigint AS packed, l_orderkey::bigint AS high, l_linenumber::bigint AS low FROM lineitem""",
    "symbol_codes": f"""WITH {S}, c AS (SELECT unnest(string_split(seq, '')) AS symbol FROM s)
SELECT symbol, count(*)::bigint AS n, (instr('-ATCGRYMKSWHBVDN', symbol) - 1)::bigint AS aligned_code, (instr('ATCGRYMKSWHBVDN', symbol) - 1)::bigint AS emitted_code
FROM c WHERE symbol <> '' GROUP BY symbol""",
    "islands_strict": ISLANDS_SQL.format(anchors=ANCHORS, new="idx - lag(idx) OVER o <> 1 OR val - lag(val) OVER o <> 1", weight="v1 - v0", sums=ISLAND_SUMS),
    "islands_diagonal": ISLANDS_SQL.format(anchors=ANCHORS, new="val - idx <> lag(val - idx) OVER o", weight="n", sums=ISLAND_SUMS),
    "null_runs": f"""WITH {ANCHORS},
f AS (SELECT *, val IS NULL AS gap, lag(val) OVER o AS bef, lead(val) OVER o AS aft, coalesce((val IS NULL) <> lag(val IS NULL) OVER o, true)::int AS new
  FROM a WINDOW o AS (PARTITION BY seq_ord ORDER BY idx)),
r AS (SELECT *, sum(new) OVER (PARTITION BY seq_ord ORDER BY idx) AS run FROM f),
g AS (SELECT seq_ord, min(idx) AS i0, max(idx) AS i1, coalesce(arg_min(coalesce(bef, -1), idx), -1) AS bef, arg_max(coalesce(aft, -1), idx) AS aft
  FROM r WHERE gap GROUP BY seq_ord, run)
SELECT seq_ord, count(*)::bigint AS n_runs, sum(i1 - i0 + 1)::bigint AS n_null, sum(CASE WHEN bef < 0 THEN 0 ELSE bef END)::bigint AS before,
       coalesce(sum(CASE WHEN aft < 0 THEN NULL ELSE aft END), 0)::bigint AS after FROM g GROUP BY seq_ord""",
    "interval_union": """WITH e AS (SELECT user_id AS grp, event_id AS payload, floor(epoch_us(ts) / 3600000000)::bigint AS lo,
  floor(epoch_us(ts) / 3600000000)::bigint + floor(value)::bigint % 4 AS hi FROM events),
m AS (SELECT *, coalesce(max(hi) OVER (PARTITION BY grp ORDER BY lo, hi, payload ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < lo, true)::int AS new FROM e),
p AS (SELECT *, sum(new) OVER (PARTITION BY grp ORDER BY lo, hi, payload) AS part FROM m)
SELECT grp, min(lo)::bigint AS lo, max(hi)::bigint AS hi, count(*)::bigint AS n, sum(payload)::bigint AS payloads FROM p GROUP BY grp, part""",
}
