"""From a FASTA file to an alignment in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import alignment, profile
from seqloom.plans import align, storage
from seqloom.sources.fasta import checked_path, read_fasta, report_text, write_fasta

#: Fixed values of the large-scale mode; k of the diversity that chooses the fragment length.
LARGE_CHUNK, LARGE_FRAGMENT, DIVERSITY_K = 5000, 32, 32


def sizes(seqs: DataFrame, fragment: int | None = None, chunk: int | None = None, large: bool = False, sample: int | None = None) -> tuple[int, int]:
    """Fragment length and chunk size: those given, those of the large-scale mode, or by the input's diversity and mean length."""
    if chunk is None:
        chunk = LARGE_CHUNK if large else profile.mean_length(seqs).select(profile.chunk_size(F.col("avg_len"))).first()[0]
    if fragment is None:
        ratio = None if large else profile.kmer_diversity(seqs, DIVERSITY_K, sample).first()["ratio"]
        fragment = LARGE_FRAGMENT if large else seqs.sparkSession.range(1).select(profile.fragment_length(F.lit(ratio))).first()[0]
    return int(fragment), int(chunk)


def align_file(
    spark: SparkSession, source: str, target: str, fragment: int | None = None, chunk: int | None = None, large: bool = False, only_build: bool = False,
    draw: bool | None = None, chunk_files: bool = False,
) -> align.Aligned | None:
    """Aligns the sequences of ``source`` (a file, folder or glob) into the folder ``target``.

    sequences, graphs, consensus, parameters, alignment (sparse columns and names), report.txt and, for fewer than DRAWN_BELOW chunks or
    if ``draw`` says so, align_result.fasta; with ``chunk_files`` also chunk_fasta, one folder for each chunk.
    """
    checked_path(source), checked_path(target)
    rows = read_fasta(spark, source, clean=True).withColumn("seq_ord", F.monotonically_increasing_id())
    rows.select("seq_ord", "seq_id", "seq").write.mode("overwrite").parquet(f"{target}/sequences")
    rows = spark.read.parquet(f"{target}/sequences")
    seqs = rows.select("seq_ord", "seq")
    fragment, chunk = sizes(seqs, fragment, chunk, large)
    if only_build:
        storage.save_graphs(align.merge_levels(storage.written(align.build_graphs(seqs, fragment, chunk)), storage.written), f"{target}/graphs")
        return None
    result = align.aligned(seqs, fragment, chunk, storage.written)
    storage.save_graphs(result.levels, f"{target}/graphs")
    result.consensus.write.mode("overwrite").parquet(f"{target}/consensus")
    result.parameters.write.mode("overwrite").parquet(f"{target}/parameters")
    names = result.named().join(rows.select(F.col("seq_ord").alias("row"), "seq_id"), "row")
    storage.save_alignment(result.columns(), names, f"{target}/alignment")
    report = spark.createDataFrame([(report_text([r.asDict() for r in result.report.orderBy("param_id").collect()]),)], "value string")  # a row a parameter set
    report.coalesce(1).write.mode("overwrite").text(f"{target}/report.txt")
    if draw or draw is None and result.n_chunks < align.DRAWN_BELOW:
        drawn = result.rows().join(rows.select(F.col("seq_ord").alias("row"), "seq_id"), "row").orderBy("row")
        write_fasta(drawn, f"{target}/align_result.fasta", "seq_id", "aligned", mode="overwrite")
    if chunk_files:
        drawn = result.rows().join(names, "row").withColumn("chunk_id", F.floor(F.col("number") / chunk) + 1)
        write_fasta(drawn, f"{target}/chunk_fasta", "seq_id", "aligned", by="chunk_id", mode="overwrite")
    return result


def stored_scores(spark: SparkSession, target: str) -> DataFrame:
    """Sum of pairs and entropy of a stored alignment, from its sparse columns."""
    columns, names = storage.load_alignment(spark, f"{target}/alignment")
    counts = alignment.counts_of(columns, names.count())
    return alignment.alignment_score(alignment.column_scores(alignment.base_counts(counts)))
