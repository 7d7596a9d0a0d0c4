"""python -m seqloom -i sequences.fasta -o folder: aligns the sequences of a FASTA file."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from seqloom.plans.run import align_file
from seqloom.shipping import ship


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="seqloom", description=__doc__)
    parser.add_argument("-i", "--input", required=True, help="FASTA file, folder or glob")
    parser.add_argument("-o", "--output", required=True, help="folder for the results")
    parser.add_argument("-f", "--fragment-length", type=int, help="default: by the diversity of k-mers")
    parser.add_argument("-t", "--threads", type=int, help="run on this machine with so many threads; default: as Spark is configured")
    parser.add_argument("-c", "--chunk-size", type=int, help="sequences of a chunk; default: by the mean length")
    parser.add_argument("-l", "--large-scale", action="store_true", help="chunks of 5000 and fragments of 32 unless given; no look at the input first")
    parser.add_argument("-b", "--only-build", action="store_true", help="build the graphs, don't align")
    return parser


def main(given: list[str] | None = None) -> None:
    args = arguments().parse_args(given)
    builder = SparkSession.builder.appName("seqloom")
    spark = (builder.master(f"local[{args.threads}]") if args.threads else builder).getOrCreate()
    ship(spark)
    result = align_file(spark, args.input, args.output, args.fragment_length, args.chunk_size, args.large_scale, args.only_build)
    if result is not None:
        result.report.orderBy("param_id").show(truncate=False)


if __name__ == "__main__":
    main()
