"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A block is a line of a text, or, wherever lines break, as many consecutive words of the whole text as the template
has (a template wrapped over lines is such a window). A template matches a block if at least `threshold` of the
template's distinct words are in the block. Words of templates are ordered by how many documents hold them, counted
over the whole table, rare ones first; a block is the set of its template words in this order. With a needed overlap
of t words, one of the first |T| - t + 1 of a template must be in the block (prefix filter), the block needs t such
words (length filter), and the first shared word must leave t words in the block's own order too: it is among
the block's first |B| - t + 1 (position filter). The prefix filter is
tried on the whole text before it is cut to blocks. A window that starts with a template word is tried only if
enough words of the template stand in it. What passes is compared exactly. Templates are a fixed list,
so the join needs no shuffle; the one aggregate has a row for each template word.

Base labels are the phrases' places: words standing consecutively.

Defined cases: null text is empty and has no word; a block or document without words matches nothing; texts of any length
are read whole; rows are judged one by one, equal rows alike; templates that share a label and reach the same score
give it once; an empty table gives no row; other columns are carried, but for those named like the added ones, which
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearspark.llm.common import fresh

#: Base phrases and their labels. Fixed values.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Templates of the method and their labels. Fixed values.
TEMPLATES = (
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
)
THRESHOLD = 0.8
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z only, as a translation: lower() would change other letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the lowered text, in order."""
    return F.filter(F.split(lowered(text), SPLIT), lambda w: w != "")


def orders(docs: DataFrame, text_col: str, threshold: float) -> tuple[list[str], list[tuple[str, list[str], int, int]]]:
    """All template words, rare first by document frequency over all rows, and the templates as (label, words in that
    order, needed overlap, length in words)."""
    own = sorted({w for t, _ in TEMPLATES for w in t.split()})
    held = F.array_intersect(words(F.col(text_col)), F.array(*map(F.lit, own)))
    counts = {r.word: r.n for r in docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    own.sort(key=lambda w: (counts.get(w, 0), w))
    out = []
    for text, label in TEMPLATES:
        distinct = sorted(set(text.split()), key=own.index)
        out.append((label, distinct, max(1, -int(-len(distinct) * threshold // 1)), len(text.split())))
    return own, out


def _containment(block: Column, template: list[str], need: int) -> Column:
    """Shared share of the template's words, or null where a filter shows that `need` can't be reached. block: template words, rare first."""
    prefix = F.array(*map(F.lit, template[: len(template) - need + 1]))
    first = F.slice(block, 1, F.greatest(F.size(block) - (need - 1), F.lit(0)))  # where the first shared word may stand in the block
    shared = F.size(F.array_intersect(block, F.array(*map(F.lit, template))))
    return F.when((F.size(block) >= need) & F.arrays_overlap(first, prefix) & (shared >= need), shared / len(template))


def _window_containment(hits: Column, template: list[str], need: int, length: int) -> Column:
    """The best shared share of the template's words in `length` consecutive words, or null where `need` isn't reached.

    `hits` are the text's template words with their places. A best window may start at a word of the template.
    """
    prefix = F.array(*map(F.lit, template[: len(template) - need + 1]))
    held = lambda m: F.array_distinct(F.transform(m, lambda x: x["word"]))

    def best(m: Column) -> Column:
        def shared(h: Column, k: Column) -> Column:
            end = h["at"] + length
            inside = F.filter(F.slice(m, k + 1, length), lambda x: x["at"] < end)
            # in a window with `need` words the hit that is need - 1 places on must stand
            return F.when(F.get(m, k + (need - 1))["at"] < end, F.size(held(inside)))

        passes = (F.size(m) >= need) & F.arrays_overlap(held(m), prefix) & (F.size(held(m)) >= need)
        return F.when(passes, F.array_max(F.transform(m, shared)))

    # within an array, so that the hits of the template are found once and not for each start
    mine = F.filter(hits, lambda x: x["word"].isin(*template))
    found = F.element_at(F.transform(F.array(mine), best), 1)
    return F.when(found >= need, found / len(template))


def matches(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, out: str = "found") -> DataFrame:
    """docs with array `out` of struct<label, score>: the best containment of each template that some block reaches."""
    own, templates = orders(docs, text_col, threshold)
    rare = sorted({w for _, t, need, _ in templates for w in t[: len(t) - need + 1]})
    tried = f"(?i)(?<![a-z0-9\\x{{80}}-\\x{{10FFFF}}])(?:{'|'.join(rare)})(?![a-z0-9\\x{{80}}-\\x{{10FFFF}}])"
    ranked = F.array(*map(F.lit, own))
    blocks = F.filter(F.transform(F.split(F.col(text_col), "\n"), lambda x: F.array_intersect(ranked, words(x))), lambda b: F.size(b) > 0)
    hits = F.filter(F.transform(words(F.col(text_col)), lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(*own))
    at_lines, at_hits = fresh(docs, "blocks"), fresh(docs, "hits")
    line = lambda t, need: F.array_max(F.transform(at_lines, lambda b: _containment(b, t, need)))
    best = lambda t, need, n: F.greatest(line(t, need), _window_containment(F.col(at_hits), t, need, n))
    scores = F.array(*[F.struct(F.lit(label).alias("label"), best(t, need, n).alias("score")) for label, t, need, n in templates])
    may = F.col(text_col).rlike(tried)
    found = docs.withColumns({at_lines: F.when(may, blocks), at_hits: F.when(may, hits)})
    none = F.array().cast("array<struct<label:string,score:double>>")
    return found.withColumn(out, F.coalesce(F.filter(scores, lambda x: x["score"].isNotNull()), none)).drop(at_lines, at_hits)


def phrases(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word and base_labels (a sorted array)."""
    all_words = words(F.col(text_col))
    joined = F.concat(F.lit(" "), F.array_join(all_words, " "), F.lit(" "))
    name = fresh(docs, "joined")
    found = docs.withColumn(name, F.when(F.col(text_col).rlike(r"(?i)license|cc"), joined)).withColumn(
        "n_words", F.coalesce(F.size(all_words), F.lit(0)).cast("bigint")
    )
    found = found.withColumn("n_words", F.when(F.col(text_col).isNull(), F.lit(0).cast("bigint")).otherwise(F.col("n_words")))
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES:
        held = F.coalesce(F.contains(F.col(name), F.lit(f" {phrase} ")), F.lit(False))
        counts.append(F.when(held, F.regexp_count(name, F.lit(f" {phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(held, spaces(F.substring_index(name, f" {phrase} ", 1))))
        lasts.append(F.when(held, F.col("n_words") - spaces(F.substring_index(name, f" {phrase} ", -1)) - len(phrase.split())))
        labels.append(F.when(held, F.lit(label)))
    return found.withColumns({
        "n_base": sum(counts[1:], counts[0]).cast("bigint"),
        "first_word": F.array_min(F.array(*firsts)).cast("bigint"),
        "last_word": F.array_max(F.array(*lasts)).cast("bigint"),
        "base_labels": F.array_sort(F.array_compact(F.array(*labels))),
    }).drop(name)


def op7(documents: DataFrame) -> DataFrame:
    found = phrases(matches(documents.select("doc_id", "text")))
    every = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("found", lambda x: x["label"]))))
    best = F.array_max(F.transform("found", lambda x: x["score"]))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same by definition, in DuckDB: every template against every line, no filter."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
    at = ", ".join(f"('{p}','{label}',{len(p.split())})" for p, label in PHRASES)
    listed = ", ".join(f"('{t}','{label}')" for t, label in TEMPLATES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {low} AS low FROM documents),
w AS (SELECT r, doc_id, low, regexp_extract_all(low, '{word}') AS ws FROM d),
p(phrase, label, n) AS (VALUES {at}),
hits AS (
  SELECT r, label, i - 1 AS place FROM (SELECT r, ws, label, phrase, n, unnest(range(1, len(ws) + 1)) AS i FROM w, p WHERE contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || phrase || ' '))
  WHERE array_to_string(ws[i : i + n - 1], ' ') = phrase),
base AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM hits GROUP BY r),
t(template, label) AS (VALUES {listed}),
tw AS (SELECT template, label, list_distinct(string_split(template, ' ')) AS words FROM t),
line AS (SELECT r, list_distinct(regexp_extract_all(unnest(string_split(low, chr(10))), '{word}')) AS words FROM d),
met AS (SELECT r, label, len(list_intersect(tw.words, line.words)) / len(tw.words) AS score FROM line, tw
  WHERE len(list_intersect(tw.words, line.words)) >= ceil(len(tw.words) * {THRESHOLD}::DOUBLE - 1e-9)),
own AS (SELECT r, list(label) AS labels, max(score) AS score FROM met GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
  greatest(coalesce(own.score, 0.0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN own USING (r)"""
