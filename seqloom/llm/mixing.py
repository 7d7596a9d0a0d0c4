"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1].  Its integral, scaled to the source's target, is the
source's cumulative token demand; a document's place in its source's stream, pushed through the inverse of that demand,
is its training position, and the mix is the documents range-sorted by position.

Targets are a water level: ``min(level * weight, cap * source size)``, so what capped sources can't take goes to the
others by weight.  Prefix sums run in two steps (within buckets of a key's hash, then over bucket totals), so no task
ever holds a whole source.

Edge cases: null text or text without words has size 0 (it is placed, and takes 0 words); null source is a source of
its own, ordered last; a null ``doc_id`` is kept; repeated rows are separate documents, rows of one id and size ordered by their text; an empty table gives an empty
mix; other columns are not read, and carried only by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table, word_count

CYCLE = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Slope of a schedule's weight over time by place in the cycle: w(t) = 1 + slope * (2t - 1).
SLOPES = (0.5, -0.5, 0.0)


def stream_key(seed: int) -> Column:
    """Order of a source's stream; its first three digits are one of 4096 buckets, sorted one at a time."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def source_targets(sizes: DataFrame, cycle=CYCLE, share=SHARE, cap=CAP) -> DataFrame:
    """One row per source: source, slot (place in the cycle), source_size, target.

    ``sizes`` has source and size.  The only global windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in cycle])
    per = per.withColumn("slot", ((F.row_number().over(order) - 1) % len(cycle)).cast("int"))
    per = per.withColumn("weight", F.element_at(weights, F.col("slot") + 1).cast("long"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Sources by the level at which they reach their cap: before a source, all earlier ones are capped.
    by_level = Window.orderBy((F.lit(cap) * F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    capped = F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", (F.lit(float(share)) * total - capped) / open_weight)
    full = (F.lit(cap) * F.col("source_size")).cast("double")
    per = per.withColumn("fits", F.col("level") * F.col("weight") <= full)
    # The level that holds is the first at which the next source isn't capped; with none, all are full.
    level = F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), full / F.col("weight"))).over(everything)
    target = F.when(level.isNull(), full).otherwise(F.least(level * F.col("weight"), full))
    return per.withColumn("target", target).select("source", "slot", "source_size", "target")


def position_at(share: Column, slope: Column) -> Column:
    """Training time at which a source has seen ``share`` of its demand.

    Demand by time t under w(t) = 1 + s(2t - 1) is t(1 - s) + s t^2; this is its inverse on [0, 1].
    """
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when(slope == 0, share).otherwise(F.abs(root - (1 - slope)) / F.abs(2 * slope))


def streams(docs: DataFrame, seed: int, carry: list[str]) -> DataFrame:
    """doc_id, source, size, key, tie (orders rows of one id), bucket, stream (the source, never null) and ``carry`` as one struct."""
    stream = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), "source"))
    kept = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), stream_key(seed).alias("key"), F.xxhash64("text").alias("tie"), stream.alias("stream"), *kept)
    return rows.withColumn("bucket", F.substring("key", 1, 3))


def assign_positions(docs: DataFrame, seed: int = 0, cycle=CYCLE, share=SHARE, cap=CAP, slopes=SLOPES, carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, key, copies, and ``row`` with the ``carry`` columns.

    ``copies`` lists (copy, taken, whole, position), one entry for each pass over the source; taken is how many of the
    copy's words lie before the target, whole tells whether at least half of it does.
    """
    rows = streams(docs, seed, carry or [])
    narrow = materialise(rows.select("doc_id", "source", "size", "key", "tie", "stream", "bucket") if not carry else rows.select("source", "size", "stream", "bucket"), "mix-sizes")
    rows = rows if carry else narrow
    targets = source_targets(narrow, cycle, share, cap)
    totals = narrow.groupBy("stream", "bucket").agg(F.sum("size").alias("bucket_size"), F.first("source").alias("source"))
    ahead = Window.partitionBy("stream").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("base", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
    info = totals.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    info = info.select("stream", "bucket", "base", "slot", "source_size", "target")
    within = Window.partitionBy("stream", "bucket").orderBy("key", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("local", F.coalesce(F.sum("size").over(within), F.lit(0))).join(info, ["stream", "bucket"])
    start = F.col("base") + F.col("local")
    slope = F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), F.col("slot") % len(slopes) + 1)
    words = F.floor(F.col("target"))

    def copy(n: Column) -> Column:
        at = n * F.col("source_size") + start
        taken = F.greatest(F.lit(0), F.least(F.col("size"), words - at)).cast("long")
        share_at = F.when(F.col("target") > 0, F.least(F.lit(1.0), at / F.col("target"))).otherwise(F.lit(1.0))
        whole = (at <= words) & (2 * taken >= F.col("size"))
        return F.struct(n.alias("copy"), taken.alias("taken"), whole.alias("whole"), position_at(share_at, slope).alias("position"))

    copies = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), copy)
    kept = ["row"] if carry else []
    return rows.select("doc_id", "size", "source", "source_size", "target", "key", copies.alias("copies"), *kept)


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The mix: one row per whole copy of a document (doc_id, key, copy, taken, position), range-sorted by position."""
    rows = assign_positions(docs, **options).select("doc_id", "key", F.inline("copies")).where("whole")
    return rows.drop("whole").orderBy("position", "key", F.col("doc_id").asc_nulls_first(), "copy")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, whole copies only, range-sorted by position, with the columns of ``docs``."""
    rows = assign_positions(docs, carry=docs.columns, **options)
    rows = rows.select("key", "row", F.explode(F.filter("copies", lambda c: c["whole"])).alias("of")).select("key", "row", "of.position")
    return rows.repartitionByRange("position", "key").sortWithinPartitions("position", "key").select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign_positions(table(spark, sf_dir, "documents"))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["taken"])
    first = F.round(F.col("copies").getItem(0)["position"], 6)
    return rows.select("doc_id", "size", F.col("source_size").cast("long"), "target", taken.alias("taken"), first.alias("position")).orderBy("position", "doc_id")


ORACLES = {
    "op8_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size, md5('0:' || coalesce(doc_id::varchar, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(n - 1) % 3 + 1] AS weight, [0.5, -0.5, 0.0][(n - 1) % 3 + 1]::double AS slope FROM s),
l AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER b, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT min_by(level, 2 * source_size / weight) AS level FROM l WHERE level * weight <= 2 * source_size),
t AS (
  SELECT source, slope, source_size, CASE WHEN v.level IS NULL THEN 2.0 * source_size ELSE least(v.level * weight, 2 * source_size) END::double AS target
  FROM l, v),
c AS (
  SELECT doc_id, size, source_size, target, slope,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CASE WHEN target > 0 THEN least(1, place / target) ELSE 1 END AS x FROM c)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target)::bigint - place)) + greatest(0, least(size, floor(target)::bigint - source_size - place)))::bigint AS taken,
       round(CASE WHEN slope = 0 THEN x ELSE abs(sqrt((1 - slope) * (1 - slope) + 4 * slope * x) - (1 - slope)) / abs(2 * slope) END, 6) AS position
FROM f""",
}
QUERIES = {"op8_mixing": op8_mixing}
