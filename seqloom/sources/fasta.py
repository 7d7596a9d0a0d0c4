"""FASTA files as tables, and tables as FASTA files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.symbols import cleaned


def read_fasta(spark: SparkSession, path: str, clean: bool = False) -> DataFrame:
    """header (without '>'), seq_id (its first word), seq of each record of a file, folder or glob; blank lines are skipped.

    Records are split by the text reader itself, so large files are read in parallel.  ``clean`` gives upper case and U as T.
    """
    records = spark.read.text(path, lineSep="\n>").where(F.trim("value") != "")
    text = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")
    header = F.regexp_extract(text, "^([^\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace(text, "^[^\n]*", ""), "\\s", "")
    rows = records.select(header.alias("header"), F.regexp_extract(header, r"^\s*(\S*)", 1).alias("seq_id"), seq.alias("seq"))
    return rows.withColumn("seq", cleaned(F.col("seq"))) if clean else rows


def write_fasta(rows: DataFrame, path: str, id_column: str = "seq_id", seq_column: str = "seq", by: str | None = None, mode: str = "errorifexists") -> None:
    """One record for each row; with ``by``, one folder for each value of that column (chunks, or single records)."""
    record = F.concat(F.lit(">"), F.col(id_column).cast("string"), F.lit("\n"), F.col(seq_column)).alias("value")
    if by is None:
        rows.select(record).write.mode(mode).text(checked_path(path))
    else:
        rows.select(record, by).repartition(by).write.mode(mode).partitionBy(by).text(checked_path(path))


def checked_path(path: str) -> str:
    """The path, unless it climbs, hides a home folder or holds a NUL."""
    plain = re.sub(r"^[a-z][a-z0-9+.-]*://", "", path)
    if "\0" in plain or "//" in plain or ".." in plain.split("/") or plain.startswith("~"):
        raise ValueError(f"unsafe path: {path!r}")
    return path


def report_text(rows: list[dict]) -> str:
    """Rows of a report as an aligned table; floats with five decimals."""
    if not rows:
        return ""
    cells = [list(rows[0])] + [[f"{v:.5f}" if isinstance(v, float) else str(v) for v in r.values()] for r in rows]
    widths = [max(len(r[i]) for r in cells) for i in range(len(cells[0]))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells)
