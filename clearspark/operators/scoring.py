"""Lexicon, letter sequences and the English score as joins and aggregates.

Tokens are exploded beside their document, so the aggregates combine before they shuffle one row a
document. Look-up tables are broadcast only while their row count stays under BROADCAST_ROWS;
beyond that they join by shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearspark.functions import text as T
from clearspark.kernel.lexicon import WORD, Resources, sequences, spelt
from clearspark.scratch import Scratch

BROADCAST_ROWS = 1_000_000


def small(table: DataFrame) -> DataFrame:
    """The table, marked for broadcast if it is proven small."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def build_lexicon(docs: DataFrame, min_docs: int = 5, text: str = "text", one_in: int | None = None) -> DataFrame:
    """word, n_docs: small-letter words of two letters and more that stand in at least `min_docs` documents, and, with
    `one_in`, in one of so many: then there are at most so many times the mean number of distinct words a document has."""
    if one_in:
        min_docs = max(min_docs, docs.count() // one_in)
    found = docs.select(F.explode(F.array_distinct(T.words(F.lower(text)))).alias("word"))
    return found.where(F.length("word") > 1).groupBy("word").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def build_grams(docs: DataFrame, min_count: int = 3, size: int = 4, text: str = "text") -> DataFrame:
    """gram, cnt, total: sequences counted at least `min_count` times; total counts all."""
    counted = docs.select(F.explode(T.grams(F.col(text), size)).alias("gram")).groupBy("gram").agg(F.count("*").alias("cnt"))
    total = counted.agg(F.sum("cnt").alias("total"))
    return counted.where(F.col("cnt") >= min_count).crossJoin(F.broadcast(total))  # one row


def known_tokens(tokens: DataFrame, lexicon: DataFrame, token: str = "token") -> DataFrame:
    """tokens with `known`: the lexicon has the token as it is, in small letters or capitalised, also without 's."""
    by = small(lexicon.groupBy(F.lower("word").alias("low")).agg(F.collect_set("word").alias("forms")))  # spellings of one word
    bare = F.regexp_replace(F.col(token), "’", "'")
    cut = F.regexp_replace(bare, "'s$", "")

    def probes(t):
        return F.array(t, F.lower(t), F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 20))))

    joined = tokens.withColumns({"_a": bare, "_b": cut})
    for side in ("_a", "_b"):
        joined = joined.join(by.select(F.col("low").alias(f"{side}low"), F.col("forms").alias(f"{side}forms")), F.lower(side) == F.col(f"{side}low"), "left")
    met = F.coalesce(F.arrays_overlap("_aforms", probes(F.col("_a"))), F.lit(False)) | F.coalesce(F.arrays_overlap("_bforms", probes(F.col("_b"))), F.lit(False))
    one = F.length(token) == 1
    return joined.withColumn("known", F.when(one, F.col(token).isin("a", "A", "i", "I")).otherwise(met)).drop(
        *(f"{s}{x}" for s in ("_a", "_b") for x in ("", "low", "forms"))
    )


def tokens(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return docs.select(key, F.posexplode(T.words(F.col(text))).alias("ix", "token"))


def coverage(docs: DataFrame, lexicon: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, covered, total: letters in known words, and in all words, of two letters and more. Documents without such a word have no row."""
    each = docs.select(key, F.explode(T.words(F.col(text))).alias("token")).where(F.length("token") > 1)
    letters = F.length("token") - F.length(F.regexp_replace("token", "[^'’]", ""))
    return known_tokens(each, lexicon).groupBy(key).agg(
        F.sum(F.when(F.col("known"), letters).otherwise(0)).alias("covered"), F.sum(letters).alias("total")
    )


def fit(docs: DataFrame, grams: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, fit: mean log10 probability of the letter sequences; unseen ones count half."""
    each = docs.select(key, F.explode(T.grams(F.col(text))).alias("gram"))
    table = small(grams.select("gram", F.log10(F.col("cnt") / F.col("total")).alias("p")))
    unseen = grams.select(F.log10(0.5 / F.first("total")).alias("unseen"))
    joined = each.join(table, "gram", "left").crossJoin(F.broadcast(unseen))  # one row
    return joined.groupBy(key).agg(F.avg(F.coalesce("p", "unseen")).alias("fit"))


def english_score(docs: DataFrame, lexicon: DataFrame, grams: DataFrame, text: str = "text", key: str = "doc_id", gibberish: float = -6.5, english: float = -4.0) -> DataFrame:
    """key, score for every row: half coverage, half usual sequences; 0 without a word."""
    both = docs.select(key).join(coverage(docs, lexicon, text, key), key, "left").join(fit(docs, grams, text, key), key, "left")
    usual = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("fit") - gibberish) / (english - gibberish)))
    score = 0.5 * F.col("covered") / F.col("total") + 0.5 * usual
    return both.select(key, F.coalesce(F.when((F.col("total") > 0) & F.col("fit").isNotNull(), score), F.lit(0.0)).alias("score"))


def stored(table: DataFrame) -> DataFrame:
    """The table, worked out once and written to the shared folder: to be read by several jobs, and counted for nothing."""
    return Scratch(table.sparkSession).write(table, "table")


def resources(lexicon: DataFrame, grams: DataFrame, lookalikes: dict[str, str] | None = None, most_words: int = 2_000_000, **scale) -> Resources:
    """The kernel's inputs from tables. Both are dictionaries of a language; a table over the bound is an error, not cut.

    Each table is worked out once. A lexicon of the words that stand in a given share of all documents, and sequences of a
    few letters, stay under a bound that does not depend on the number of documents.
    """
    words = lexicon.select("word").limit(most_words + 1).collect()
    rows = grams.select("gram", "cnt", "total").limit(most_words + 1).collect()
    if max(len(words), len(rows)) > most_words:
        raise ValueError(f"more than {most_words} words or sequences")
    extra = {"lookalikes": lookalikes} if lookalikes else {}
    return Resources(frozenset(r.word for r in words), {r.gram: r.cnt for r in rows}, rows[0].total if rows else 0, **extra, **scale)


#: Distinct words that a task holds at once; beyond it hands on what it has counted.
MOST_HELD = 300_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, item, n: in how many texts a word of two letters and more stands, and how often a sequence of four letters."""
    words, grams = Counter(), np.zeros(27**4, np.int64)

    def rows(kind: str, items: list[str], n: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(n), pa.string()), pa.array(items, pa.string()), pa.array(n, pa.int64())], ["kind", "item", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text is None:
                continue
            words.update(set(WORD.findall(text.lower())))
            found = sequences(text)
            if len(found) > 50_000:
                grams += np.bincount(found, minlength=27**4)
            else:
                np.add.at(grams, found, 1)
        if len(words) > MOST_HELD:
            yield rows("word", list(words), list(words.values()))
            words.clear()
    yield rows("word", list(words), list(words.values()))
    seen = np.flatnonzero(grams).tolist()
    yield rows("gram", list(map(spelt, seen)), grams[seen].tolist())
    yield rows("total", [""], [int(grams.sum())])


def learn(docs: DataFrame, min_docs: int = 5, one_in: int | None = None, min_count: int = 3, text: str = "text", most_words: int = 2_000_000, **scale) -> Resources:
    """The kernel's inputs from texts: `resources` of what `build_lexicon` and `build_grams` give, counted in one pass."""
    if one_in:
        min_docs = max(min_docs, docs.count() // one_in)
    counted = docs.select(text).mapInArrow(_counted, "kind string, item string, n bigint").groupBy("kind", "item").agg(F.sum("n").alias("n"))
    enough = F.when(F.col("kind") == "word", (F.length("item") > 1) & (F.col("n") >= min_docs)).when(F.col("kind") == "gram", F.col("n") >= min_count).otherwise(True)
    found: dict[str, dict[str, int]] = {"word": {}, "gram": {}, "total": {"": 0}}
    for r in counted.where(enough).limit(2 * most_words + 2).collect():
        found[r.kind][r["item"]] = r.n
    if max(map(len, found.values())) > most_words:
        raise ValueError(f"more than {most_words} words or sequences")
    return Resources(frozenset(found["word"]), found["gram"], found["total"][""] if found["gram"] else 0, **scale)
