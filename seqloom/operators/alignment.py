"""Alignments as tables: layout, cells, sparse columns, scores, reports.

cells: row, col, sym (alignment code; 0 is a gap)
columns (sparse): col, main, minors (array of sym and rows), n_rows
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.symbols import ALIGNED, STANDS_FOR, code_of

#: Fixed value: columns with a smaller share of gaps than this are core columns.
CORE = 0.7


def naive_cells(seqs: DataFrame) -> DataFrame:
    """Row by row, each symbol in the column of its position (from 0); shorter rows end in gaps that aren't stored."""
    blocks = seqs.select("seq_ord", "seq", F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(512))).alias("start"))
    blocks = blocks.select("seq_ord", "start", F.split(F.substring("seq", F.col("start") + 1, F.lit(512)), "").alias("symbols"))
    rows = blocks.select("seq_ord", "start", F.posexplode("symbols").alias("at", "symbol")).where("symbol <> ''")
    return rows.select(F.col("seq_ord").alias("row"), (F.col("start") + F.col("at")).alias("col"), code_of(F.col("symbol"), ALIGNED).alias("sym"))


def column_layout(slots: DataFrame, length: int | None = None) -> DataFrame:
    """slots: pos, n_insert (insert columns before match column pos).  Gives first insert column and match column."""
    before = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # one row per profile position
    width = F.coalesce(F.sum(F.col("n_insert") + 1).over(before), F.lit(0))
    return slots.select("pos", "n_insert", width.alias("first_insert"), (width + F.col("n_insert")).alias("match_col"))


def place_cells(states: DataFrame, layout: DataFrame) -> DataFrame:
    """states: row, pos, state (0 match, 2 insert), run (of inserts still to come), symbol.  Inserts are right-justified."""
    rows = states.join(layout, "pos")
    col = F.when(F.col("state") == 0, F.col("match_col")).otherwise(F.col("first_insert") + F.col("n_insert") - F.col("run") - 1)
    return rows.select("row", col.alias("col"), code_of(F.col("symbol"), ALIGNED).alias("sym"))


#: Row numbers of one piece of a sparse column.
PIECE = 1 << 16


def pieces_of(mains: DataFrame, n_rows: int, step: int) -> DataFrame:
    """mains with each piece of a column, and the rows of the piece."""
    rows = mains.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n_rows - 1) // step).cast("long"))))
    return rows.withColumn("span", F.sequence(F.col("piece") * step, F.least(F.lit(n_rows).cast("long"), (F.col("piece") + 1) * step) - 1))


def sparse_columns(cells: DataFrame, mains: DataFrame, n_rows: int | None = None, step: int = PIECE) -> DataFrame:
    """mains: col, main.  Gives col, main, piece, sym, rows: symbols other than the main one with their rows, in pieces of
    ``step`` row numbers, so no list grows with the number of rows; a column of main symbols only has one row without rows.

    With ``n_rows`` rows are numbered from 0, and gaps (which cells don't store) in columns with another main symbol are listed.
    """
    piece = F.floor(F.col("row") / step)
    minors = cells.join(mains, "col").where("sym <> main").groupBy("col", piece.alias("piece"), "sym").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    if n_rows:
        held = cells.where("sym <> 0").groupBy("col", piece.alias("piece")).agg(F.collect_list(F.col("row").cast("long")).alias("held"))
        gaps = pieces_of(mains.where("main <> 0").select("col"), n_rows, step).join(held, ["col", "piece"], "left")
        missing = F.array_except("span", F.coalesce("held", F.array().cast("array<bigint>")))
        minors = minors.unionByName(gaps.select("col", "piece", F.lit(0).alias("sym"), missing.alias("rows")).where(F.size("rows") > 0))
    return mains.select("col", "main").join(minors, "col", "left")


def cells_of(columns: DataFrame, n_rows: int, step: int = PIECE) -> DataFrame:
    """The cells (row, col, sym, without gaps) of sparse columns whose rows are numbered from 0."""
    listed = columns.where("rows IS NOT NULL")
    minors = listed.where("sym <> 0").select(F.explode(F.col("rows").cast("array<bigint>")).alias("row"), "col", "sym")
    others = listed.groupBy("col", "piece").agg(F.flatten(F.collect_list(F.col("rows").cast("array<bigint>"))).alias("others"))
    mains = pieces_of(columns.where("main <> 0").select("col", "main").distinct(), n_rows, step).join(others, ["col", "piece"], "left")
    rest = F.array_except("span", F.coalesce("others", F.array().cast("array<bigint>")))
    return minors.unionByName(mains.select(F.explode(rest).alias("row"), "col", F.col("main").alias("sym")))


def counts_of(columns: DataFrame, n_rows: int) -> DataFrame:
    """col, sym, n of sparse columns, without listing the main symbol's rows."""
    minors = columns.where("rows IS NOT NULL").groupBy("col", "sym").agg(F.sum(F.size("rows")).alias("n"))
    mains = columns.groupBy("col", F.col("main").alias("sym")).agg((F.lit(n_rows) - F.coalesce(F.sum(F.size("rows")), F.lit(0))).alias("n"))
    return minors.unionByName(mains).where("n > 0").select("col", "sym", F.col("n").cast("long").alias("n"))


def rebased(columns: DataFrame, n_rows: int, step: int = PIECE) -> DataFrame:
    """Sparse columns with each column's most frequent symbol as the main one, and the others listed anew."""
    return sparse_columns(cells_of(columns, n_rows, step), majority_mains(counts_of(columns, n_rows)), n_rows, step)


def symbol_counts(cells: DataFrame, n_rows) -> DataFrame:
    """col, sym, n with gaps filled up to ``n_rows`` (a number, or a one-row DataFrame with column n_rows)."""
    counts = cells.groupBy("col", "sym").agg(F.count(F.lit(1)).alias("n"))
    held = counts.where("sym <> 0")
    totals = held.groupBy("col").agg(F.sum("n").alias("held"))
    rows = F.lit(n_rows) if isinstance(n_rows, int) else F.lit(n_rows.first()[0])
    gaps = totals.select("col", F.lit(0).alias("sym"), (rows - F.col("held")).alias("n")).where("n > 0")
    return held.unionByName(gaps)


def majority_mains(counts: DataFrame) -> DataFrame:
    """col, main: the most frequent symbol, ties to the smaller code."""
    return counts.groupBy("col").agg(F.max_by("sym", F.struct("n", -F.col("sym"))).alias("main"))


def base_counts(counts: DataFrame) -> DataFrame:
    """col and the counts of A, T, C, G and gaps; a degenerate base counts as equal parts of what it stands for."""

    def of(base: str) -> Column:
        parts = [F.when(F.col("sym") == ALIGNED.index(s), F.col("n") / len(b)) for s, b in STANDS_FOR.items() if base in b]
        return F.sum(F.coalesce(*parts, F.lit(0.0))).alias(f"n_{base.lower()}")

    gap = F.sum(F.when(F.col("sym") == 0, F.col("n")).otherwise(0)).cast("double").alias("n_gap")
    return counts.groupBy("col").agg(*[of(b) for b in "ATCG"], gap)


def column_scores(bases: DataFrame) -> DataFrame:
    """col, pos, neg, entropy, gap_share: sum of pairs (match 1, mismatch -1, base against gap -2, gaps 0) in closed form."""
    n = [F.col(f"n_{b}") for b in "atcg"]
    gap, held = F.col("n_gap"), n[0] + n[1] + n[2] + n[3]
    squares = n[0] * n[0] + n[1] * n[1] + n[2] * n[2] + n[3] * n[3]
    total = held + gap

    def term(x: Column) -> Column:
        return F.when(x > 0, -(x / total) * F.log(x / total)).otherwise(0.0)

    entropy = term(n[0]) + term(n[1]) + term(n[2]) + term(n[3]) + term(gap)
    return bases.select(
        "col", ((squares - held) / 2).alias("pos"), (-(held * held - squares) / 2 - 2 * held * gap).alias("neg"),
        entropy.alias("entropy"), (gap / total).alias("gap_share"), total.alias("n_rows"),
    )


def alignment_score(scores: DataFrame) -> DataFrame:
    """One row: columns, pos, neg, sp (scaled by pairs and columns), entropy, core_entropy (mean over core columns)."""
    rows = scores.agg(
        F.count(F.lit(1)).alias("n_cols"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("n_rows").alias("n"),
        F.sum("entropy").alias("entropy"), F.avg(F.when(F.col("gap_share") < CORE, F.col("entropy"))).alias("core_entropy"),
    )
    pairs = F.col("n") * (F.col("n") - 1) * F.col("n_cols")
    sp = F.when((F.col("n") < 2) | (F.col("n_cols") == 0), F.lit(0.0)).otherwise(2 * (F.col("pos") + F.col("neg")) / pairs)
    return rows.select("n_cols", "pos", "neg", F.coalesce(sp, F.lit(0.0)).alias("sp"), F.coalesce("entropy", F.lit(0.0)).alias("entropy"), F.coalesce("core_entropy", F.lit(0.0)).alias("core_entropy"))


def merge_alignments(parts: DataFrame) -> DataFrame:
    """parts: part, pos, n_insert.  Insert columns of each position over all parts, and how far each part is padded."""
    widest = parts.groupBy("pos").agg(F.max("n_insert").alias("n_insert"))
    layout = column_layout(widest)
    padded = parts.select("part", "pos", F.col("n_insert").alias("own")).join(layout, "pos")
    return padded.select("part", "pos", "own", (F.col("n_insert") - F.col("own")).alias("padding"), (F.col("first_insert") + F.col("n_insert") - F.col("own")).alias("first_own"), "match_col")


def row_offsets(parts: DataFrame) -> DataFrame:
    """parts: part, n_rows.  First row of each part when they are put one below the other."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", "n_rows", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("first_row"))


def merged_cells(cells: DataFrame, parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """cells (part, row, col, sym) of alignments to one profile, put one below the other in the columns of all.

    parts: part, pos, n_insert; sizes: part, n_rows.  A part's inserts stay beside its match columns.
    """
    before = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    own = parts.select("part", "pos", "n_insert", F.coalesce(F.sum(F.col("n_insert") + 1).over(before), F.lit(0)).alias("own_first"))
    new = merge_alignments(parts).select("part", "pos", "first_own")
    columns = own.join(new, ["part", "pos"]).select("part", F.posexplode(F.sequence(F.col("own_first"), F.col("own_first") + F.col("n_insert"))).alias("at", "col"), "first_own")
    moved = columns.select("part", "col", (F.col("first_own") + F.col("at")).alias("new_col"))
    rows = cells.join(moved, ["part", "col"]).join(F.broadcast(row_offsets(sizes).select("part", "first_row")), "part")
    return rows.select((F.col("row") + F.col("first_row")).alias("row"), F.col("new_col").alias("col"), "sym")


def ranked_report(scores: DataFrame) -> DataFrame:
    """scores: param_id, sp, entropy, length.  Marks the largest sp and the smallest entropy, ties to the first."""
    best = scores.agg(F.max_by("param_id", F.struct("sp", -F.col("param_id"))).alias("by_sp"), F.min_by("param_id", F.struct("entropy", "param_id")).alias("by_entropy"))
    rows = scores.join(F.broadcast(best), (F.col("param_id") == F.col("by_sp")) | (F.col("param_id") == F.col("by_entropy")), "left")
    return rows.select(
        "param_id", "sp", "entropy", "length", F.coalesce(F.col("param_id") == F.col("by_sp"), F.lit(False)).alias("best_sp"),
        F.coalesce(F.col("param_id") == F.col("by_entropy"), F.lit(False)).alias("best_entropy"),
    )


def drawn(entries: Column, n_cols: int) -> Column:
    """Text of sorted entries (col, s): gaps fill the room between neighbours."""
    last = F.concat(F.array(F.lit(-1).cast("long")), F.transform(entries, lambda x: x["col"].cast("long")))
    before = F.slice(last, 1, F.size(entries))
    parts = F.zip_with(entries, before, lambda x, p: F.concat(F.repeat(F.lit("-"), (x["col"] - p - 1).cast("int")), x["s"]))
    return F.concat(F.array_join(parts, ""), F.repeat(F.lit("-"), (F.lit(n_cols - 1) - F.element_at(last, -1)).cast("int")))


def rendered_rows(cells: DataFrame, rows: DataFrame, n_cols: int) -> DataFrame:
    """row, aligned: each row as text, gaps as '-'.  ``rows`` has the rows to render (row)."""
    letter = F.substring(F.lit(ALIGNED), F.col("sym") + 1, F.lit(1))
    held = cells.where("sym <> 0").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", letter.alias("s")))).alias("at"))
    found = rows.select("row").join(held, "row", "left")
    return found.select("row", F.when(F.col("at").isNull(), F.repeat(F.lit("-"), F.lit(n_cols))).otherwise(drawn(F.col("at"), n_cols)).alias("aligned"))


def reference_row(mains: DataFrame, n_cols: int) -> DataFrame:
    """One row (row is null) of each column's main symbol."""
    letter = F.substring(F.lit(ALIGNED), F.col("main") + 1, F.lit(1))
    held = mains.where("main <> 0").agg(F.array_sort(F.collect_list(F.struct("col", letter.alias("s")))).alias("at"))  # as long as the alignment
    return held.select(F.lit(None).cast("long").alias("row"), drawn(F.col("at"), n_cols).alias("aligned"))
