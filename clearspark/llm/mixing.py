"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source should be taken `target / size of its source` times: a whole number of
copies and a fraction. The fractions are rounded by the pivotal method on words: two documents a and b
exchange probability so that size_a * p_a + size_b * p_b stays the same, in one of two directions,
drawn so that both probabilities keep their expectation, until one of them is 0 or 1. So every step keeps
the source's expected words, and one fractional document at most is left of any set.

Documents are dealt to buckets by hash of their id, so a source with a third of all rows is spread
over all buckets; a bucket leaves one residual a source. Residuals are combined
through a reduction tree, `fan` buckets at a time, until one a source is left, which is drawn by its probability. Only ids,
sizes and sources are shuffled, never texts. Draws come from hashes of ids, and the order is fixed,
so runs agree whatever the partitions are.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating; what a source's bound
(3 times its size) leaves over is shared again by weight until none is above. This water level is found by
aggregates over the table of sources; the driver gets three numbers a round, and a count of sources a range
of names, from which sources get their places without being sorted in one task.

Within a bucket and a source, documents that still share one probability are taken by size: each is paired with
the group of all smaller ones, as one unit of their words, so the large ones become integral first and little is
left to the end. (Of two single documents the smaller becomes integral, which would leave the largest one's
words to the last draw.) Residuals of buckets, each with a probability of its own, are paired one with another.

Defined cases: null or empty text has size 0 and nothing is taken; a source of size 0 has target 0;
an empty table gives no row; rows of equal or null ids, and equal rows, are rounded one by one; very long texts
are counted whole; names of other columns do not matter, they are not read by mix() and carried by mixed().
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearspark.llm.common import Scratch, fresh

FAN = 64
BUCKET_ROWS = 1 << 15
PART_SOURCES = 4096
RANGE_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`: starts of runs of other characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def places(sizes: DataFrame, scratch: Scratch, rows: int) -> DataFrame:
    """The sources with `place`, from 0 in code point order, null last: sorted within ranges of names, which follow one another."""
    low = (1 << 33) - 1  # monotonically_increasing_id() numbers a partition's rows in these bits
    parts = 1 + rows // RANGE_SOURCES
    sorted_ = sizes.repartitionByRange(parts, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    numbered = scratch.write(sorted_.withColumn("id", F.monotonically_increasing_id()), "places")
    part, own = F.shiftright("id", 33), F.col("id").bitwiseAND(low)
    counts = sorted((r.part, r.n) for r in numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row a range
    before = F.lit(0).cast("bigint")
    starts, at = {}, 0
    for k, n in counts:
        starts[k], at = at, at + n
    if len(starts) > 1:
        before = F.element_at(F.create_map(*(F.lit(x) for kv in starts.items() for x in kv)), part).cast("bigint")
    return numbered.withColumn("place", before + own).drop("id")


def targets(sizes: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size -> with target. One row a source."""
    scratch = Scratch(sizes.sparkSession)
    sizes = scratch.write(sizes, "sources")
    rank = F.col("place")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights) + 1).cast("int")).cast("double")
    table = places(sizes, scratch, sizes.count()).withColumn("weight", w).drop("place")
    bound = F.col("source_size").cast("double") * most
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else bound <= F.lit(level) * F.col("weight")
        got = table.agg(
            F.sum(F.col("source_size").cast("double")).alias("total"),
            F.coalesce(F.sum(F.when(full, bound)), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count_if(full).alias("n"),
        ).first()
        if not got.total or got.n == capped or not got.open:
            break
        level, capped = (got.total - got.fixed) / got.open, got.n
    return table.withColumn("target", F.least(bound, F.lit(level or 0.0) * F.col("weight")))


def pivot(rows: Iterator[tuple[float, float, int]]) -> tuple[list[int], int, float]:
    """Pivotal rounding of (size, probability, draw); draw: 62 random bits of the row.

    Returns per row 1, 0, or -1 for the one that stays fractional, that row's place and its probability.
    """
    state: list[int] = []
    held, size, p = -1, 0.0, 0.0
    for k, (s, q, bits) in enumerate(rows):
        if s <= 0 or q <= 1e-12 or q >= 1 - 1e-12:
            state.append(1 if q > 0.5 else 0)
            continue
        state.append(-1)
        if held < 0:
            held, size, p = k, s, q
            continue
        up, down = min((1 - p) * size, q * s), min(p * size, (1 - q) * s)  # words that may go to the held one, or from it
        if (bits / (1 << 62)) * (up + down) < down:
            moved = up
        else:
            moved = -down
        p, q = p + moved / size, q - moved / s
        done = [x <= 1e-12 or x >= 1 - 1e-12 for x in (p, q)]
        if done[1]:
            state[k] = int(q > 0.5)
            if done[0]:
                state[held] = int(p > 0.5)
                held = -1
        else:
            state[held] = int(p > 0.5)
            held, size, p = k, s, q
    return state, held, p


def pivot_rest(rows: list[tuple[float, int]], p: float) -> tuple[list[int], int, float]:
    """Pivotal rounding of (size, draw) rows that share one probability, largest first.

    A document is paired with all that follow it, which act as one of their total size and common
    probability: the same exchange of words, and it is the large documents that become integral first.
    """
    state = [-1] * len(rows)
    rest = float(sum(s for s, _ in rows))
    for k, (s, bits) in enumerate(rows):
        rest -= s
        if s <= 0 or p <= 1e-12 or p >= 1 - 1e-12:
            state[k] = int(p > 0.5)
            continue
        if rest <= 0:
            state[k + 1 :] = [0] * (len(rows) - k - 1)  # of size 0
            return state, k, p
        up, down = min((1 - p) * s, p * rest), min(p * s, (1 - p) * rest)
        moved = up if (bits / (1 << 62)) * (up + down) < down else -down
        mine, p = p + moved / s, p - moved / rest
        if 1e-12 < mine < 1 - 1e-12:  # the rest has become integral
            state[k + 1 :] = [int(p > 0.5)] * (len(rows) - k - 1)
            return state, k, mine
        state[k] = int(mine > 0.5)
    return state, -1, 0.0


SCHEMA = "node bigint, part bigint, row bigint, source string, size bigint, p double, draw bigint, extra int"


def _round(rows: DataFrame) -> DataFrame:
    """One level of the tree: the rows of each (node, part of the sources) are folded source by source,
    large documents first. extra is 0 or 1 where decided, null for the residuals."""

    def fold(key, table):
        table = table.sort_by([("size", "descending"), ("draw", "ascending"), ("row", "ascending")])
        columns = table.to_pydict()
        by: dict[str | None, list[int]] = {}
        for k, s in enumerate(columns["source"]):
            by.setdefault(s, []).append(k)
        extra: list[int | None] = [None] * len(table)
        p = list(columns["p"])
        for places in by.values():
            if len({p[k] for k in places}) == 1:
                state, held, left = pivot_rest([(columns["size"][k], columns["draw"][k]) for k in places], p[places[0]])
            else:
                state, held, left = pivot((columns["size"][k], p[k], columns["draw"][k]) for k in places)
            for k, x in zip(places, state, strict=True):
                extra[k] = x if x >= 0 else None
            if held >= 0:
                p[places[held]] = left
        kept = {c: table.column(c) for c in ("node", "part", "row", "source", "size")}
        return pa.table({**kept, "p": pa.array(p, pa.float64()), "draw": table.column("draw"), "extra": pa.array(extra, pa.int32())})

    return rows.groupBy("node", "part").applyInArrow(fold, SCHEMA)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0, keep: str | None = None) -> DataFrame:
    """One row a row of docs: doc_id, source, size, source_size, target, copies; `kept` is the column `keep`."""
    scratch = Scratch(docs.sparkSession)
    kept = [F.col(keep).alias("kept")] if keep else []
    sized = scratch.write(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("h"), *kept), "sizes")
    sources = scratch.write(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    n = sized.count()
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    many = sources.count()
    rows = (
        sized.join(F.broadcast(sources) if many <= 10_000 else sources, sized.source.eqNullSafe(sources.source))
        .select("doc_id", sized.source, "size", "source_size", "target", "h", *(["kept"] if keep else []), F.floor(rate).cast("int").alias("whole"), (rate - F.floor(rate)).alias("p"))
        .withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size", "h"), 2))
        .drop("h")
    )
    # each row gets a number of its own only to be found again; of equal rows any may get any result
    rows = scratch.write(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    nodes, parts = max(1, -(-n // BUCKET_ROWS)), 1 + many // PART_SOURCES
    level = rows.select(
        F.pmod(F.xxhash64("draw"), F.lit(nodes)).alias("node"),
        F.pmod(F.xxhash64("source"), F.lit(parts)).alias("part"),
        *("row", "source", "size", "p", "draw"),
    )
    decided = []
    while True:
        level = scratch.write(_round(level), f"level{len(decided)}")
        decided.append(level.where("extra is not null").select("row", "extra"))
        left = level.where("extra is null")
        if nodes == 1:
            break
        nodes = -(-nodes // FAN)
        level = left.drop("extra").withColumn("node", F.floor(F.col("node") / FAN).cast("bigint"))
    # the last residual of a source
    decided.append(left.select("row", (F.col("draw") / float(1 << 62) < F.col("p")).cast("int").alias("extra")))
    chosen = decided[0]
    for x in decided[1:]:
        chosen = chosen.unionByName(x)
    copies = (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies")
    return rows.join(chosen, "row", "left").select("doc_id", "source", "size", "source_size", "target", copies, *(["kept"] if keep else []))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; rows it takes 0 times are left out.

    Rows are numbered once and written, so a row is found again by its number, whatever else agrees with it.
    """
    scratch, row, copies = Scratch(docs.sparkSession), fresh(docs, "row"), fresh(docs, "copies")
    numbered = scratch.write(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    taken = mix(numbered, id_col, source_col, text_col, seed, keep=row).where("copies > 0").select(F.col("kept").alias(row), F.col("copies").alias(copies))
    return numbered.join(taken, row).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).drop(row, copies)


def op10(documents: DataFrame) -> DataFrame:
    return mix(documents).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def target_table(documents: DataFrame) -> DataFrame:
    """source, source_size, target: what the mix aims at, without the draws."""
    sizes = documents.select("source", n_words(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    return targets(sizes).select("source", "source_size", "target")


def target_oracle(most: int = 3) -> str:
    """Targets in closed form, in DuckDB: sources by the level that fills them; the first level below the next bound holds."""
    return f"""
WITH sized AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS source_size FROM documents GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized),
ranked AS (SELECT *, {most} * source_size / weight AS full_at, row_number() OVER (ORDER BY {most} * source_size / weight, source) AS k FROM weighed),
levels AS (SELECT k, full_at, (sum(source_size) OVER () - {most} * (sum(source_size) OVER (ORDER BY k) - source_size)) / (sum(weight) OVER () - sum(weight) OVER (ORDER BY k) + weight) AS level FROM ranked),
held AS (SELECT min(level) AS level FROM levels WHERE k = (SELECT min(k) FROM levels WHERE level <= full_at))
SELECT source, source_size, least({most} * source_size, coalesce(level, 0) * weight)::DOUBLE AS target FROM weighed, held"""
