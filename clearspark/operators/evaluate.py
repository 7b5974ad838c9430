"""Scoring of outcomes: tallies by grouping sets, precision and recall of steps, character error, latency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearspark.functions import text as T

LEVELS = ("conservative", "balanced", "aggressive")
#: The level that undoes each trick. Fixed values.
TRICK_LEVEL = {
    **dict.fromkeys(("zero-width", "tag-characters", "styled-alphabet", "fullwidth", "html-entity", "url-percent", "backslash-escape", "base64", "base64url", "hex", "binary", "decimal-codes", "rot13", "caesar", "reverse"), "conservative"),
    **dict.fromkeys(("combining-marks", "homoglyph", "accent-substitution", "leetspeak", "separator"), "balanced"),
    **dict.fromkeys(("repeated-chars", "shorthand", "misspelling", "emoji-word"), "aggressive"),
}
NORMALISING = ("shorthand", "misspelling", "emoji-word")
RECORDED_AS = {"base64url": "base64"}


def in_scope(tricks, level: str):
    """Whether a level is expected to undo all of the tricks."""
    allowed = [t for t, own in TRICK_LEVEL.items() if LEVELS.index(own) <= LEVELS.index(level)]
    return F.size(F.array_except(tricks, F.array(*map(F.lit, allowed)))) == 0


def facts(outcomes: DataFrame, level: str = "balanced") -> DataFrame:
    """outcomes (text, expected, tricks, output, transforms, second_pass, mode, category, origin, caseless,
    expected_rewritten; the last two may be null) with what the tallies count."""
    folded = lambda c: F.lower(F.col(c))
    exact = (folded("output") == folded("expected")) | F.coalesce(folded("output") == folded("expected_rewritten"), F.lit(False))
    clean = F.size("tricks") == 0
    differs = ~T.same(F.col("output"), F.col("expected"), F.col("caseless"))
    informal = F.coalesce(F.col("category") == "shorthand", F.lit(False)) | F.coalesce(F.col("origin") == "sms", F.lit(False))
    rewritten = informal & differs & (F.size(F.array_except("transforms", F.array(*map(F.lit, NORMALISING)))) == 0)
    scale = F.greatest(F.length("expected"), F.lit(1))
    before, after = F.levenshtein(folded("text"), folded("expected")), F.when(exact, 0).otherwise(F.levenshtein(folded("output"), folded("expected")))
    return outcomes.withColumns({
        "clean": clean,
        "scope": ~clean & in_scope("tricks", level),
        "false_change": F.when(clean, differs & ~rewritten),
        "normalised": F.when(clean & informal, rewritten),
        "recovered": F.when(~clean, exact),
        "recovered_with_capitals": F.when(~clean, ~differs),
        "made_worse": F.when(~clean, after > before),
        "error_before": F.when(~clean, F.least(before / scale, F.lit(1.0))),
        "error_after": F.when(~clean, F.least(after / scale, F.lit(1.0))),
        "idempotent": F.col("second_pass") == F.col("output"),
        "length_class": T.length_class(F.col("expected")),
    })


def tallies(rows: DataFrame, hit: str, *sets: tuple[str, ...]) -> DataFrame:
    """total, hits and rate of a flag by several groupings at once: one pass and one shuffle (GROUPING SETS)."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, columns))
    counted = grouped.agg(F.count(hit).alias("total"), F.sum(F.col(hit).cast("bigint")).alias("hits"), F.grouping_id().alias("gid"))
    return counted.withColumn("rate", F.when(F.col("total") > 0, F.col("hits") / F.col("total")))


def precision_recall(rows: DataFrame) -> DataFrame:
    """Of each step name: found rightly, wrongly, missed, precision, recall. rows: gold, found (arrays of names)."""
    recorded = F.transform("gold", lambda t: F.when(t == "base64url", "base64").otherwise(t))
    sets = {"right": F.array_intersect(recorded, "found"), "wrong": F.array_except("found", recorded), "missed": F.array_except(recorded, "found")}

    def named_as(kind: str, these):
        return F.transform(these, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind")))

    each = [named_as(kind, these) for kind, these in sets.items()]
    named = rows.select(F.explode(F.concat(*each)).alias("x")).select("x.*")
    count = lambda k: F.count_if(F.col("kind") == k)
    return named.groupBy("name").agg(
        count("right").alias("n_right"),
        count("wrong").alias("n_wrong"),
        count("missed").alias("n_missed"),
        (count("right") / F.nullif(count("right") + count("wrong"), F.lit(0))).alias("precision"),
        (count("right") / F.nullif(count("right") + count("missed"), F.lit(0))).alias("recall"),
    )


def latency(rows: DataFrame, value: str) -> DataFrame:
    """median, p95 (a value of the data) and maximum."""
    return rows.agg(F.median(value).alias("median"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"), F.max(value).alias("largest"))
