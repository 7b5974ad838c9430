"""Spans as rows: (key, start, end). Overlap joins, greedy choice, shifts of offsets, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    return (F.col(a_start) < F.col(b_end)) & (F.col(b_start) < F.col(a_end))


def find_spans(df: DataFrame, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ix, start, end, value of every match, in code points. The text is cut once, by pattern and rest,
    and lengths add up; the position functions of SQL count other units."""
    parts = F.regexp_extract_all(F.col(text), F.lit(rf"(?sU)({pattern})|(?:(?!{pattern}).)+"), F.lit(0))
    cut = df.select(key, F.posexplode(parts).alias("ix", "value"))
    before = Window.partitionBy(key).orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("start", F.coalesce(F.sum(F.length("value")).over(before), F.lit(0)))
    return placed.where(F.col("value").rlike(rf"(?sU)^(?:{pattern})$")).withColumn("end", F.col("start") + F.length("value"))


def without_overlap(candidates: DataFrame, kept: DataFrame, key: str = "doc_id") -> DataFrame:
    """Candidates that no kept span of the same document overlaps: an anti-join on the key, never a cross join."""
    other = kept.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return candidates.join(other, (F.col(key) == F.col("_k")) & overlaps("start", "end", "_s", "_e"), "left_anti")


def greedy(spans: Column) -> Column:
    """Of an array of struct<weight, start, end, ...>: the heaviest first, none that overlaps a chosen one; in text order."""
    kind = F.transform(spans, lambda x: F.struct((-x["weight"]).alias("order"), x["start"].alias("start"), x["end"].alias("end"), x["weight"].alias("weight")))
    none = F.filter(kind, lambda x: F.lit(False))
    chosen = F.aggregate(
        F.array_sort(kind), none, lambda done, x: F.when(F.exists(done, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])), done).otherwise(F.concat(done, F.array(x)))
    )
    return F.array_sort(F.transform(chosen, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["weight"].alias("weight"))))


def shifted(edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Edits (key, start, end, after) with `at`: where each lands once those to its left are applied."""
    before = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.length("after") - (F.col("end") - F.col("start"))).over(before), F.lit(0))
    return edits.withColumn("at", F.col("start") + moved)


def islands(rows: DataFrame, flag: str, key: str = "doc_id", order: str = "ix") -> DataFrame:
    """key, first, last, n of every run of neighbouring rows whose flag holds."""
    w = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("_run", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where(F.col(flag)).groupBy(key, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """Neighbouring ranges (lo, hi, name) of one name become one."""
    w = Window.partitionBy("name").orderBy("lo")
    new = F.when(F.col("lo") == F.lag("hi").over(w) + 1, 0).otherwise(1)
    run = ranges.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("name", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def in_ranges(points: DataFrame, ranges: DataFrame, point: str = "cp", bucket: int = 256) -> DataFrame:
    """points with the name of the range they lie in, else Unknown. A range join by buckets: ranges are
    cut at multiples of `bucket`, so the join is on equal buckets and not on inequalities alone."""
    cut = ranges.select("name", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))).alias("_b"))
    on = (F.floor(F.col(point) / bucket) == F.col("_b")) & F.col(point).between(F.col("lo"), F.col("hi"))
    return points.join(F.broadcast(cut) if cut.limit(100_001).count() <= 100_000 else cut, on, "left").withColumn("script", F.coalesce("name", F.lit("Unknown"))).drop("name", "lo", "hi", "_b")
