"""The same rules over streams. Undoing disguises needs no state; counts by window and de-duplication do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearspark.kernel.lexicon import Resources
from clearspark.operators.unmask import changed, names, unmask


def unmask_stream(stream: DataFrame, resources: Resources, level: str = "conservative", text: str = "text") -> DataFrame:
    """A streaming (or batch) DataFrame with `result`; nothing is kept between rows."""
    return unmask(stream, resources, level, text)


def disguise_rate(undone: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Texts and changed texts by event-time window; events later than the watermark are left out."""
    marked = undone.withWatermark(ts, late).withColumn("changed", changed(F.col("result")).cast("bigint"))
    return marked.groupBy(F.window(ts, width)).agg(F.count("*").alias("n"), F.sum("changed").alias("n_changed"))


def trick_rate(undone: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Texts by window and trick found."""
    each = undone.withWatermark(ts, late).withColumn("trick", F.explode(names(F.col("result.steps"))))
    return each.groupBy(F.window(ts, width), "trick").agg(F.count("*").alias("n"))


def without_repeats(stream: DataFrame, ts: str = "ts", late: str = "10 minutes", text: str = "text") -> DataFrame:
    """Texts that were not seen within the watermark; the state holds hashes only that long."""
    hashed = stream.withColumn("text_hash", F.sha2(F.col(text), 256)).withWatermark(ts, late)
    return hashed.dropDuplicatesWithinWatermark(["text_hash"]).drop("text_hash")
