"""Quality rules whose cutoffs carry a guarantee on false rejections.

Four signals of a text (symbols per word, repeated lines, repeated words, characters per word) each get a ladder of fixed
cutoffs, from loose to strict.  A setting is a set of signals and a rung: it rejects a text that is above the rung's cutoff
of any of its signals.  On labelled rows of a stratum, a setting is certified if the exact binomial test rejects "it turns
away more than ALPHA of the good rows"; so the bound holds for the verdict, not for each signal alone.  The rungs of a set
are tested from loose to strict, at DELTA / (sets * strata) each, until one fails: a fixed sequence needs no correction
among its own tests, and Bonferroni's correction covers sets and strata.  Of a stratum's certified settings the one that
rejects most rows labelled bad holds (then the most good rows, then the first); with none certified only the base rule judges there.
Everything is DataFrame functions.

Edge cases: null or empty text has no words and fails the base rule (fewer than 50 words); a null ``lang`` is a stratum
of its own; labels without a quality, or of unknown documents, are ignored; a document with repeated label rows counts once,
as good if any of them says so, and one whose rows are repeated counts once in each of its strata, by its worst row;
without labels no setting is certified; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, materialise, table

SYMBOLS = "#*$%&|<>"
#: Share of good rows that may be rejected in a stratum, and the chance that it is exceeded in any.
ALPHA, DELTA = 0.01, 0.05
#: signal -> cutoffs from loose to strict; a text is above a cutoff if num > cutoff * den (whole numbers, in thousandths).
LADDERS = {
    "symbols": ("n_symbols", "n_words", (2000, 1200, 800, 500, 300, 200, 100)),
    "lines": ("n_dup_lines", "n_lines", (900, 700, 500, 400, 300, 200, 100)),
    "repeats": ("n_repeat_words", "n_words", (500, 400, 300, 250, 200, 150, 100)),
    "length": ("word_chars", "n_words", (20000, 15000, 12000, 10000, 9000, 8000, 7000)),
}
RUNGS = 7
SETS = [c for n in range(len(LADDERS), 0, -1) for c in combinations(LADDERS, n)]


def text_signals(text: Column) -> dict[str, Column]:
    """Counts of one text, computed inside its row: nothing is shuffled."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return {
        "words": words,
        "word_chars": F.char_length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "lines": F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != ""),
    }


def once(rows: DataFrame, *columns) -> DataFrame:
    """Like select, but a step that the optimizer doesn't merge into the next: a list built here is built once.

    Merged into a lambda that looks at a list's places, the list would be built again for each of them.
    """
    return rows.select(F.inline(F.array(F.struct(*columns))))


def documents_signals(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the counts of each document."""
    s = text_signals(F.col("text"))
    rows = once(docs, "doc_id", F.coalesce(F.concat(F.lit("lang "), "lang"), F.lit("")).alias("stratum"), *[v.alias(k) for k, v in s.items()])
    rows = rows.select(
        "doc_id", "stratum", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "words",
    )
    grams = F.when(
        F.size("words") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("words") - 3),
            lambda i: F.struct(F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("w"), i.alias("i")),
        ),
    ).otherwise(F.array())
    counts = ["doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    rows = once(rows, *counts, F.sort_array(grams).alias("grams"))
    # zip each sorted window with its neighbours; a place counts if either neighbour has the same window
    flags = F.filter(
        F.transform(
            "grams",
            lambda g, i: F.when(
                ((i > 0) & (F.get("grams", i - 1)["w"] == g["w"])) | F.coalesce(F.get("grams", i + 1)["w"] == g["w"], F.lit(False)), g["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    rows = once(rows, *counts, F.sort_array(flags).alias("places"))
    covered = F.transform("places", lambda p, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get("places", i - 1))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(*counts, total.alias("n_repeat_words"))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term in logarithms."""
    step = F.lit(p / (1 - p))
    start = F.struct((n * F.log1p(F.lit(-p))).alias("term"), F.exp(n * F.log1p(F.lit(-p))).alias("sum"))

    def add(acc, i):
        term = acc["term"] + F.log((n - i + 1) / i * step)
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(terms, start, add)["sum"]


def first_rung(signal: str) -> Column:
    """Loosest rung whose cutoff a text is above; RUNGS if none.  A text above a cutoff is above all stricter ones."""
    num, den, cuts = LADDERS[signal]
    return F.coalesce(*[F.when(1000 * F.col(num) > c * F.col(den), F.lit(i)) for i, c in enumerate(cuts)], F.lit(RUNGS))


def certified_settings(signals: DataFrame, labels: DataFrame, alpha=ALPHA, delta=DELTA) -> DataFrame:
    """stratum and, for each signal, the certified rung (null: the signal doesn't judge there), one row for each stratum that has any.

    Rows that already fail the base rule say nothing about the settings and are left out.
    """
    known = labels.where("quality IN (0, 1)").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("good"))
    rows = signals.where(~base_failed()).join(known, F.col("doc_id") == F.col("id"))
    rows = rows.groupBy("id", "stratum", "good").agg(*[F.min(first_rung(s)).alias(s) for s in LADDERS])
    cells = rows.groupBy("stratum", *LADDERS).agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))  # few rows from here on
    sets = F.explode(F.array(*[F.struct(F.lit(i).alias("set"), F.least(F.lit(RUNGS), *[F.col(s) for s in c]).alias("rung")) for i, c in enumerate(SETS)]))
    met = cells.select("stratum", "good", "bad", sets.alias("of")).groupBy("stratum", "of.set", "of.rung").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    tests = met.groupBy("stratum", "set").agg(
        F.sum("good").alias("n"),
        *[F.sum(F.when(F.col("rung") <= r, F.col(c)).otherwise(0)).alias(f"{c}{r}") for r in range(RUNGS) for c in ("good", "bad")],
    )
    tests = tests.withColumn("strata", F.size(F.collect_set("stratum").over(Window.partitionBy())))  # one row for each stratum and set
    level = F.lit(delta) / (F.col("strata") * len(SETS))

    def certified(r: int) -> Column:
        k = F.col(f"good{r}")
        # a rate of alpha or more can't be certified, and its sum isn't formed
        return (k < F.col("n") * alpha) & (binomial_cdf(F.when(k < F.col("n") * alpha, k).otherwise(F.lit(0)), F.col("n"), alpha) <= level)

    passed = tests.withColumn("rung", F.coalesce(*[F.when(~certified(r), F.lit(r - 1)) for r in range(RUNGS)], F.lit(RUNGS - 1))).where("rung >= 0")
    rejects = lambda c: F.element_at(F.array(*[F.col(f"{c}{r}") for r in range(RUNGS)]), F.col("rung") + 1)
    best = passed.groupBy("stratum").agg(F.max_by(F.struct("set", "rung"), F.struct(rejects("bad"), rejects("good"), -F.col("set"))).alias("best"))
    in_set = lambda s: F.col("best.set").isin([i for i, c in enumerate(SETS) if s in c])
    return best.select("stratum", *[F.when(in_set(s), F.col("best.rung")).alias(s) for s in LADDERS])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, stratum, counts, base_failed and kept of each document."""
    signals = materialise(documents_signals(docs), "signals")
    settings = certified_settings(signals, labels).select(F.col("stratum").alias("of"), *[F.col(s).alias(f"rung_{s}") for s in LADDERS])
    rows = signals.join(settings, F.col("stratum") == F.col("of"), "left")
    over = [F.coalesce(first_rung(s) <= F.col(f"rung_{s}"), F.lit(False)) for s in LADDERS]
    rejected = over[0] | over[1] | over[2] | over[3]
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    first = ", ".join(
        f"CASE {' '.join(f'WHEN 1000 * {num} > {c} * {den} THEN {i}' for i, c in enumerate(cuts))} ELSE {RUNGS} END AS {s}" for s, (num, den, cuts) in LADDERS.items()
    )
    tail = (
        "list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)"
        f" + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA}))))"
    )
    sets = " UNION ALL ".join(f"SELECT stratum, {i} AS set, least({', '.join(c)}, {RUNGS}) AS rung, good FROM c" for i, c in enumerate(SETS))
    in_set = lambda s: f"set IN ({', '.join(str(i) for i, c in enumerate(SETS) if s in c)})"
    cuts = ", ".join(f"CASE WHEN {in_set(s)} THEN rung END AS rung_{s}" for s in LADDERS)
    over = " OR ".join(f"coalesce({s} <= rung_{s}, false)" for s in LADDERS)
    return f"""
WITH t AS (
  SELECT doc_id, coalesce('lang ' || lang, '') AS stratum, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, w, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) AS g FROM t),
u AS (SELECT doc_id, unnest(g) AS win, unnest(range(1, len(g) + 1)) AS pos FROM g),
r AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM u) WHERE c >= 2),
p AS (SELECT doc_id, count(DISTINCT pos + d)::bigint AS n FROM r, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
s AS (
  SELECT t.doc_id, stratum, len(w)::bigint AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint AS n_symbols, len(l)::bigint AS n_lines,
         (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines, coalesce(p.n, 0)::bigint AS n_repeat_words
  FROM t LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {first} FROM s),
a AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
c AS (
  SELECT doc_id, stratum, good, {', '.join(f'min({s}) AS {s}' for s in LADDERS)}
  FROM b JOIN a USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
m AS ({sets}),
x AS (
  SELECT stratum, set, r, sum(good) AS n, coalesce(sum(good) FILTER (rung <= r), 0)::bigint AS k, coalesce(sum(1 - good) FILTER (rung <= r), 0) AS bad
  FROM m, (SELECT unnest(range(0, {RUNGS})) AS r) GROUP BY ALL),
y AS (SELECT *, coalesce(k < n * {ALPHA} AND {tail} <= {DELTA} / ((SELECT count(DISTINCT stratum) FROM m) * {len(SETS)}), false) AS passes FROM x),
z AS (SELECT *, bool_and(passes) OVER (PARTITION BY stratum, set ORDER BY r) AS holds FROM y),
h AS (SELECT stratum, set, r AS rung FROM z WHERE holds QUALIFY row_number() OVER (PARTITION BY stratum, set ORDER BY r DESC) = 1),
e AS (SELECT stratum, {cuts} FROM h JOIN z USING (stratum, set) WHERE z.r = h.rung QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY bad DESC, k DESC, set) = 1)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept
FROM b LEFT JOIN e USING (stratum)"""


ORACLES = {"op7_quality_rules": _oracle()}
QUERIES = {"op7_quality_rules": op7_quality_rules}
