"""Quality rules as weak supervision.

Each rule looks at counts of one document and votes good (1), bad (0) or abstains (-1). Expectation
maximisation over all documents' votes estimates, without labels, how often each rule gives each
vote for good documents and for each kind of bad ones; a document's posterior probability of being good then
decides, instead of a demand that every rule passes.

Python counts words and windows per document (one pass, nothing shuffled). The counts, a few numbers
a row, are written to the shared folder, so that the second pass does not read texts again. Vote
patterns are counted in Spark; there are at most 3^rules of them, so EM on the driver has a bound
that does not depend on the number of documents.

Defined cases: null text has no words and fails the base rule; rows are judged one by one, equal
rows alike; an empty table gives an empty result; nulls and clashing names in other columns do not
matter, since only the id and the text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearspark.llm.common import Scratch, space_words

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_same_next", "n_lines", "n_upper", "n_letters", "n_long", "n_marked")


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows of `width` that occur twice or more. Exact: ranks of windows are doubled, not hashed."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    rank, size = ids, 1
    while size < width:
        step = min(size, width - size)
        pair = rank[: len(rank) - step] * np.int64(rank.max() + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        size += step
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    words = space_words(text)
    if not words:
        symbols = len(text) - len(text.translate(None, SYMBOLS)) if text else 0
        return (0, 0, symbols) + (0,) * (len(FIELDS) - 3)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    flat = b"".join(words)
    chars = len(flat.decode())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines, dup = set(), 0
    n_lines = 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\r\x0b\x0c"):
            n_lines += 1
            if line in lines:
                dup += 1
            lines.add(line)
    string = flat.decode()
    upper = sum(map(str.isupper, string)) if string != string.lower() else 0
    letters = chars - symbols
    long = sum(len(w) > 40 for w in seen)
    marked = 0
    if symbols:
        signs = np.fromiter((len(w.translate(None, SYMBOLS)) < len(w) for w in seen), bool, len(seen))
        marked = int(signs[ids].sum())
    return (len(words), chars, symbols, dup, repeated_words(ids), int((ids[1:] == ids[:-1]).sum()), n_lines, upper, letters, long, marked)


@F.arrow_udf(T.StructType([T.StructField(x, T.LongType()) for x in FIELDS]))
def measures(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        rows = [measure(t) for t in batch.cast(pa.binary()).to_pylist()]
        yield pa.StructArray.from_arrays(
            [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(FIELDS))], names=list(FIELDS)
        )


def _vote(value: Column, good: float, bad: float) -> Column:
    """1 up to `good`, 0 from `bad` on, else no vote."""
    return F.when(value <= good, 1).when(value >= bad, 0).otherwise(-1)


def votes() -> dict[str, Column]:
    """The rules: vote columns over the measures. Each defect is seen by two rules or more, from different
    sides: a defect that one rule alone sees can't be told from that rule's own errors without labels. A document without words gets no vote but that on length."""
    n = F.col("n_words")
    share = lambda c, of="n_words": F.col(c) / F.greatest(F.col(of), F.lit(1))
    mean = share("word_chars")
    some = lambda v: F.when(n > 0, v).otherwise(-1)
    return {
        "length": F.when(n < 20, 0).when(n >= 50, 1).otherwise(-1),
        "symbols": some(_vote(share("n_symbols"), 0.05, 0.3)),
        "symbol_chars": some(_vote(share("n_symbols", "word_chars"), 0.01, 0.05)),
        "marked_words": some(_vote(share("n_marked"), 0.03, 0.15)),
        "dup_lines": some(_vote(share("n_dup_lines", "n_lines"), 0.05, 0.3)),
        "repeats": some(_vote(share("n_repeat_words"), 0.1, 0.3)),
        "runs": some(_vote(share("n_same_next"), 0.02, 0.15)),
        "word_length": some(F.when((mean >= 3) & (mean <= 10), 1).when((mean < 2) | (mean > 14), 0).otherwise(-1)),
        "capitals": some(_vote(share("n_upper", "word_chars"), 0.1, 0.4)),
        "long_words": some(_vote(share("n_long"), 0.005, 0.1)),
    }


#: Kinds of defect and the rules that should agree on each. They only start the estimation: all rules are estimated for all classes.
DEFECTS = (("symbols", "symbol_chars", "marked_words"), ("dup_lines", "repeats", "runs", "capitals"))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int, defects: tuple[tuple[int, ...], ...], rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """EM for the shares of the classes and P(vote | class) of each rule, from counted vote patterns.

    Class 0 is good; every kind of defect is a class of its own, since a document with one defect passes the
    rules on the others. A pattern starts in a defect's class if two of its rules vote bad (or its only one).
    One added vote of each kind keeps probabilities off 0. Returns log shares (class) and log-probabilities
    (class, rule, vote + 1); a rule that does not vote is no evidence.
    """
    v = np.array([p for p, _ in patterns], int).reshape(len(patterns), rules)
    n = np.array([c for _, c in patterns], float)
    classes = len(defects) + 1
    belief = np.full((len(n), classes), 0.02)
    belief[:, 0] = 1.0
    for k, own in enumerate(defects, 1):
        against = (v[:, list(own)] == 0).sum(1) >= min(2, len(own))
        belief[against, 0], belief[against, k] = 0.05, 1.0
    belief /= belief.sum(1, keepdims=True)
    for _ in range(rounds):
        weight = belief * n[:, None]
        shares = np.log((weight.sum(0) + 1) / (n.sum() + classes))
        tables = np.zeros((classes, rules, 3))
        for rule in range(rules):
            votes = np.stack([(weight * (v[:, rule] == x)[:, None]).sum(0) for x in (0, 1)], 1) + 1
            tables[:, rule, 1:] = np.log(votes / votes.sum(1, keepdims=True))
        odds = shares[None, :] + sum(tables[:, rule, v[:, rule] + 1].T for rule in range(rules))
        new = np.exp(odds - odds.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        moved, belief = np.abs(new - belief).max(initial=0), new
        if moved < 1e-9:
            break
    return shares, tables


def quality(docs: DataFrame, keep: list[str], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """`keep` columns of docs with the measures, the votes, `posterior` and `kept` (posterior >= threshold)."""
    scratch = Scratch(docs.sparkSession)
    found = docs.select(*keep, measures(F.col(text_col)).alias("_m")).select(*keep, "_m.*")
    rules = votes()
    found = scratch.write(found.withColumns({f"vote_{k}": v for k, v in rules.items()}), "votes")
    names = [f"vote_{k}" for k in rules]
    counted = [(tuple(r[:-1]), r[-1]) for r in found.groupBy(*names).count().collect()]  # at most 3^rules rows
    shares, tables = estimate(counted, len(names), tuple(tuple(list(rules).index(r) for r in d) for d in DEFECTS))
    likelihoods = []
    for k, share in enumerate(shares):
        total = F.lit(float(share))
        for name, table in zip(names, tables[k], strict=False):
            total = total + F.when(F.col(name) == 1, float(table[2])).when(F.col(name) == 0, float(table[1])).otherwise(0.0)
        likelihoods.append(total)
    against = sum((F.exp(F.least(x - likelihoods[0], F.lit(500.0))) for x in likelihoods[1:]), F.lit(0.0))
    return found.withColumn("posterior", 1 / (1 + against)).withColumn("kept", F.col("posterior") >= threshold)


def op3(documents: DataFrame) -> DataFrame:
    found = quality(documents.select("doc_id", "text"), ["doc_id"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.select(
        "doc_id",
        *FIELDS[:5],
        failed.alias("base_failed"),
        (F.col("kept") & ~failed).alias("kept"),
        "posterior",
    )


def base_oracle(window: int = WINDOW) -> str:
    """The base columns by definition, in DuckDB."""
    run = " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER s" for k in range(1, window))])
    return f"""
WITH docs AS (SELECT row_number() OVER () AS key, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
lines AS (SELECT key, unnest(string_split(text, chr(10))) AS line FROM docs),
same AS (SELECT key, line, count(*) - 1 AS more FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY key, line),
dup AS (SELECT key, sum(more)::BIGINT AS n FROM same GROUP BY key),
words AS (SELECT key, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM docs),
runs AS (SELECT key, i, {run} AS win FROM words WINDOW s AS (PARTITION BY key ORDER BY i)),
twice AS (SELECT key, win FROM runs WHERE win IS NOT NULL GROUP BY key, win HAVING count(*) > 1),
hit AS (SELECT key, count(DISTINCT place) AS n FROM (SELECT key, unnest(range(i, i + {window})) AS place FROM runs JOIN twice USING (key, win)) GROUP BY key),
base AS (SELECT key, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM docs)
SELECT doc_id, n_words, word_chars, n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(hit.n, 0)::BIGINT AS n_repeat_words,
  n_words < 20 OR 100 * coalesce(hit.n, 0) > 30 * n_words AS base_failed
FROM base LEFT JOIN dup USING (key) LEFT JOIN hit USING (key)"""
