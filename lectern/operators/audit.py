"""Outcomes of audited calls: classes, shares with intervals, quantiles, homogeneity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.words import is_function_word

Z = 1.959963984540054
# Classes of a reviewer's answer and the groups they belong to.
GROUPS = {
    "call_failed": "no_output",
    "empty_response": "no_output",
    "unparseable": "no_output",
    "fixed_no_text": "no_output",
    "fixed_rejected_short": "no_output",
    "fixed_identical": "same_text",
    "fixed_expanded": "expanded",
    "ok": "ok",
    "fixed_changed": "changed",
}


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % interval of a share, within 0 and 1."""
    p, z2 = k / n, Z * Z
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def shares(rows: DataFrame, by: list[str], kind: str, domain: list[str]) -> DataFrame:
    """k of n and the interval for each value of a fixed domain, zeros included."""
    each = rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(F.col(kind) == d).alias(f"k_{i}") for i, d in enumerate(domain)))
    long = each.select(*by, "n", F.explode(F.array(*(F.struct(F.lit(d).alias(kind), F.col(f"k_{i}").alias("k")) for i, d in enumerate(domain)))).alias("v")).select(*by, f"v.{kind}", "v.k", "n")
    low, high = wilson(F.col("k"), F.col("n"))
    return long.withColumn("share", F.col("k") / F.col("n")).withColumn("low", low).withColumn("high", high)


def parsed(response: Column) -> dict[str, Column]:
    """The parts of a reviewer's answer: VERDICT, ISSUES and TEXT."""
    return {
        "verdict": F.upper(F.trim(F.regexp_extract(response, r"(?i)VERDICT:\s*(\w+)", 1))),
        "issues": F.trim(F.regexp_extract(response, r"(?i)ISSUES:[ \t]*([^\n]*)", 1)),
        "text": F.trim(F.regexp_extract(response, r"(?is)TEXT:\s*(.*)$", 1)),
    }


def outcome(rows: DataFrame, floor: float = 0.5, wider: float = 1.05) -> DataFrame:
    """category and group of each call. rows: failed, response, original, verdict, fixed, n_fixed, n_original, target."""
    same = F.trim(F.regexp_replace("fixed", r"\s+", " ")) == F.trim(F.regexp_replace("original", r"\s+", " "))
    category = (
        F.when(F.col("failed"), "call_failed").when(F.trim("response") == "", "empty_response").when(F.col("verdict") == "OK", "ok").when(F.col("verdict") != "FIXED", "unparseable")
        .when(F.col("n_fixed") == 0, "fixed_no_text").when(F.col("n_fixed") < floor * F.col("target"), "fixed_rejected_short").when(same, "fixed_identical")
        .when(F.col("n_fixed") > wider * F.greatest("n_original", "target"), "fixed_expanded").otherwise("fixed_changed")
    )
    out = rows.withColumn("category", category)
    group = F.lit(None)
    for c, g in GROUPS.items():
        group = F.when(F.col("category") == c, g).otherwise(group)
    return out.withColumn("group", group)


def chi_square(rows: DataFrame, row: str, column: str) -> DataFrame:
    """Statistic and degrees of freedom of a contingency table."""
    cells = rows.groupBy(row, column).agg(F.count("*").alias("o"))
    by_row, by_column = rows.groupBy(row).agg(F.count("*").alias("r")), rows.groupBy(column).agg(F.count("*").alias("c"))
    n = by_row.agg(F.sum("r").alias("n"), F.count("*").alias("rows"))
    expected = by_row.join(F.broadcast(by_column)).join(F.broadcast(n)).withColumn("e", F.col("r") * F.col("c") / F.col("n"))  # a table of classes by classes
    full = expected.join(cells, [row, column], "left").withColumn("o", F.coalesce("o", F.lit(0)))
    return full.agg(F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e")).alias("chi2"), ((F.count_distinct(row) - 1) * (F.count_distinct(column) - 1)).alias("df"))


def best_trial(rows: DataFrame) -> DataFrame:
    """Of each group's trials the one nearest to the target among the sane ones, else among all."""
    order = Window.partitionBy("group_id").orderBy(F.desc("sane"), F.abs(F.col("words") - F.col("target")), "trial")
    return rows.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def sanity_issues(rows: DataFrame, longest: int = 30, gram: int = 6) -> DataFrame:
    """issues, an array of names: a run of words, at least as long as the mean sentence, that are neither in the
    vocabulary nor function words; a word of more than ``longest`` letters; a run of ``gram`` words that occurs twice.

    rows: text and vocabulary, an array of lower-case words."""
    words = F.regexp_extract_all(F.col("text"), F.lit("([A-Za-z']+)"), F.lit(1))
    sentences = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    rows = rows.withColumn("words", words).withColumn("low", F.transform("words", F.lower))
    known = F.map_from_entries(F.transform(F.array_distinct("vocabulary"), lambda w: F.struct(w, F.lit(True))))
    unknown = F.transform("low", lambda w: ~is_function_word(w) & ~F.map_contains_key("known", w))
    rows = rows.withColumn("known", known).withColumn("unknown", unknown)
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("most"))
    step = lambda a, u: F.struct(F.when(u, a["run"] + 1).otherwise(0).alias("run"), F.greatest(a["most"], F.when(u, a["run"] + 1).otherwise(0)).alias("most"))
    run = F.aggregate("unknown", zero, step, lambda a: a["most"])
    mean = F.greatest(F.lit(1), F.bround(F.size("words") / F.greatest(F.size(sentences), F.lit(1))).cast("int"))
    grams = F.when(F.size("low") >= 2 * gram, F.transform(F.sequence(F.lit(1), F.size("low") - (gram - 1)), lambda i: F.array_join(F.slice("low", i, gram), " "))).otherwise(F.array().cast("array<string>"))
    issues = F.array(
        F.when((F.size("words") > 0) & (run >= mean), "invented_run"), F.when(F.exists("words", lambda w: F.length(w) > longest), "long_word"),
        F.when(F.size(F.array_distinct(grams)) < F.size(grams), "repeated_phrase"),
    )
    return rows.withColumn("issues", F.array_compact(issues)).drop("words", "low", "known", "unknown")
