"""Symbols of aligned sequences: codes, degenerate bases, packing of two numbers into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Alignment codes are the places in ALIGNED, emission codes those in EMITTED; what degenerate bases stand for.
ALIGNED = "-ATCGRYMKSWHBVDN"
EMITTED = "ATCGRYMKSWHBVDN"
STANDS_FOR = {
    "A": "A", "T": "T", "C": "C", "G": "G", "R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "GC", "W": "AT",
    "H": "ATC", "B": "GTC", "V": "GAC", "D": "GAT", "N": "ATCG",
}
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def as_sequence(text: Column) -> Column:
    """A text's ASCII letters, a to z taken as A T C G over and over; null is the empty sequence."""
    bases = ("ATCG" * 7)[:26]
    return F.translate(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", "")), LETTERS, bases)


def cleaned(seq: Column) -> Column:
    """Upper case, RNA's U as T."""
    return F.translate(F.upper(seq), "U", "T")


def code_of(symbol: Column, alphabet: str) -> Column:
    """Place of a symbol in an alphabet; unknown symbols count as N."""
    at = F.instr(F.lit(alphabet), symbol)
    return F.when(at > 0, at - 1).otherwise(F.lit(alphabet.index("N"))).cast("int")


def unambiguous(seq: Column) -> Column:
    """Whether a string has only A, T, C, G of either case; null has not, the empty string has."""
    return F.coalesce(seq.rlike("^[ATCGatcg]*$"), F.lit(False))


def pack(high: Column, low: Column, bits: int = 32) -> Column:
    """Two numbers in one BIGINT; null if either doesn't fit its bits (the sign bit stays free)."""
    fits = (high >= 0) & (low >= 0) & (high < F.lit(1 << (63 - bits))) & (low < F.lit(1 << bits))
    return F.when(fits, F.shiftleft(high.cast("long"), bits).bitwiseOR(low.cast("long")))


def high_bits(packed: Column, bits: int = 32) -> Column:
    return F.shiftrightunsigned(packed, bits)


def low_bits(packed: Column, bits: int = 32) -> Column:
    return packed.bitwiseAND(F.lit((1 << bits) - 1))


def log_sum_exp(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """ln of the sum of exp(column) for each key, safe for values far below zero; minus infinity where all are."""
    rows = rows.withColumn("_top", F.max(column).over(Window.partitionBy(*keys)))
    part = F.when(F.col("_top") == float("-inf"), F.lit(0.0)).otherwise(F.exp(F.col(column) - F.col("_top")))
    found = rows.groupBy(*keys).agg(F.first("_top").alias("_top"), F.sum(part).alias("_sum"))
    return found.select(*keys, F.when(F.col("_top") == float("-inf"), F.col("_top")).otherwise(F.col("_top") + F.log("_sum")).alias(column))
