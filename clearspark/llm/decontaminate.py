"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of all items is built once on the driver and broadcast. Documents stream through it
word by word: the automaton's state and the length matched so far tell, at each word, the longest
run of words that ends there and occurs in some item. Documents are only read; nothing is shuffled.

Bound on what is broadcast and held by a worker: one automaton of at most `block_words` item words (two states a
word). A larger benchmark is cut into several automata, one after another: rows are numbered and written once,
each automaton is scanned in a job of its own that writes hits only, and is then given back. The hits
are united per row. Results do not depend on the cut.

Defined cases: null or empty text has no words; a null item text, or one without words, has no
window; rows of one item_id are one item; an item without an id hits words but is neither named nor
counted among the items; rows with equal or null doc_id are judged row by row; an empty benchmark hits
nothing; texts of any length are scanned whole. Other columns are carried unchanged, whatever their names: what is
added is one struct, which takes the place of a column of its own name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearspark.llm.common import Scratch, alnum_words, fresh

WINDOW = 13
SCHEMA = (
    "struct<n_words:bigint,n_hit:bigint,n_items:bigint,items:array<string>,"
    "spans:array<struct<start:bigint,end:bigint,matched:bigint>>>"
)


class SuffixAutomaton:
    """Generalised suffix automaton over words, with the items of every window marked on its states."""

    def __init__(self, items: list[tuple[object | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.length, self.link, self.next = [0], [-1], [{}]
        texts = []
        for item, words in items:
            if words:
                text = [self.ids.setdefault(w, len(self.ids)) for w in words]
                texts.append((set() if item is None else {str(item)}, text))
                last = 0
                for c in text:
                    last = self._extend(last, c)
        self.shortest = min((min(len(t), window) for _, t in texts), default=0)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.at_window = [0] * len(self.length)  # the state of the last `window` words
        for s in order:
            above = self.link[s]
            self.at_window[s] = s if self.length[above] < window <= self.length[s] else self.at_window[above]
        self.items: dict[int, set[str]] = {}  # of a full window, by its state
        ends: dict[int, dict[int, set[str]]] = {}
        for item, text in texts:
            state = 0
            for i, c in enumerate(text):
                state = self.next[state][c]
                if i + 1 >= window:
                    self.items.setdefault(self.at_window[state], set()).update(item)
            if len(text) < window:
                ends.setdefault(state, {}).setdefault(len(text), set()).update(item)
        self.short: dict[int, list[tuple[int, frozenset[str]]]] = {}  # whole items of fewer words that end here
        for s in order:
            own = [(n, frozenset(x)) for n, x in ends.get(s, {}).items()]
            if own or self.link[s] in self.short:
                self.short[s] = own + self.short.get(self.link[s], [])

    def _add(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of q for the strings that are only one word longer than those of p."""
        copy = self._add(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # another item has brought this string
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = self._add(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int, int]], set[str]]:
        """Hit spans (start, end, longest matching length there), merged, and the items that occur."""
        found: list[tuple[int, int, int]] = []
        items: set[str] = set()
        if not self.shortest or len(words) < self.shortest:
            return found, items
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        out = np.concatenate(([-1], np.flatnonzero(ids < 0), [len(words)]))
        for k in np.flatnonzero(np.diff(out) > self.shortest):  # only runs of item words can hold a window
            state = matched = 0
            for i in range(out[k] + 1, out[k + 1]):
                c = int(ids[i])
                while state and c not in self.next[state]:
                    state = self.link[state]
                    matched = self.length[state]
                if c in self.next[state]:
                    state = self.next[state][c]
                    matched += 1
                hit = 0
                if matched >= self.window:
                    hit = matched
                    items |= self.items[self.at_window[state]]
                for n, own in self.short.get(state, ()):
                    if matched >= n:
                        hit = max(hit, n)
                        items |= own
                if hit:
                    start, best = i + 1 - hit, hit
                    while found and found[-1][1] >= start:
                        start, best = min(start, found[-1][0]), max(best, found.pop()[2])
                    found.append((start, i + 1, best))
        return found, items


def _scanner(shared, column_type: str = SCHEMA):
    @F.arrow_udf(column_type)
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = shared.value
        kind = pa.struct(
            [
                ("n_words", pa.int64()),
                ("n_hit", pa.int64()),
                ("n_items", pa.int64()),
                ("items", pa.list_(pa.string())),
                ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int64())]))),
            ]
        )
        for batch in texts:
            rows = []
            for text in batch.cast(pa.binary()).to_pylist():
                words = alnum_words(text)
                spans, items = automaton.scan(words)
                rows.append(
                    {
                        "n_words": len(words),
                        "n_hit": sum(b - a for a, b, _ in spans),
                        "n_items": len(items),
                        "items": sorted(items),
                        "spans": [{"start": a, "end": b, "matched": m} for a, b, m in spans],
                    }
                )
            yield pa.array(rows, kind)

    return scan


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list]:
    block, n = [], 0
    for item, text in benchmark.select(id_col, text_col).orderBy(id_col, text_col).toLocalIterator():
        words = alnum_words(text.encode()) if text else []
        if words:
            block.append((item, words))
            n += len(words)
        if n >= block_words:
            yield block
            block, n = [], 0
    if block:
        yield block


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = 200_000,
    out: str = "contamination",
) -> DataFrame:
    """Every row of docs with a struct `out`: n_words, n_hit, n_items, items and merged hit spans (in words)."""
    blocks = _blocks(benchmark, item_id, item_text, block_words)
    first, second = next(blocks, []), next(blocks, None)
    sc = docs.sparkSession.sparkContext
    if second is None:
        return docs.withColumn(out, _scanner(sc.broadcast(SuffixAutomaton(first, window)))(F.col(text_col)))
    scratch = Scratch(docs.sparkSession)
    row, found = fresh(docs, "row"), None
    rows = scratch.write(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    for k, block in enumerate(chain((first, second), blocks)):
        automaton = sc.broadcast(SuffixAutomaton(block, window))
        # every row in the first pass, for the number of words; later ones bring hits alone
        hits = rows.select(F.col(row).alias("row"), _scanner(automaton)(F.col(text_col)).alias("c"))
        part = scratch.write(hits if k == 0 else hits.where("c.n_hit > 0"), f"hits{k}")
        automaton.destroy()
        found = part if found is None else found.unionByName(part)
    united = found.groupBy("row").agg(
        F.max("c.n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("c.items")))).alias("items"),
        _folded(F.array_sort(F.flatten(F.collect_list("c.spans")))).alias("spans"),
    )
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"]).alias("n_hit")
    one = united.select(F.col("row").alias(row), F.struct("n_words", hit, F.size("items").cast("bigint").alias("n_items"), "items", "spans").alias(out))
    return rows.drop(*[c for c in rows.columns if c.lower() == out.lower()]).join(one, row).drop(row)


def _folded(spans):
    """Sorted spans, made disjoint: one span for each stretch of hit words, with its longest match."""
    grown = lambda last, x: F.struct(
        last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), F.greatest(last["matched"], x["matched"]).alias("matched")
    )
    return F.aggregate(
        spans,
        F.array().cast("array<struct<start:bigint,end:bigint,matched:bigint>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown(F.element_at(done, -1), x))),
        ).otherwise(F.concat(done, F.array(x))),
    )


def contaminated(found: str = "contamination", share: int = 20):
    """The coverage limit: some word is hit, and at least one of `share` words."""
    return (F.col(f"{found}.n_hit") > 0) & (share * F.col(f"{found}.n_hit") >= F.col(f"{found}.n_words"))


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, cut in zip(texts.cast(pa.binary()).to_pylist(), spans.to_pylist(), strict=True):
        if not cut or text is None:
            out.append(None if text is None else text.decode())
            continue
        flat = bytes(text)
        starts, ends, inside = [], [], False
        for i, b in enumerate(flat):
            word = b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A
            if word and not inside:
                starts.append(i)
            elif inside and not word:
                ends.append(i)
            inside = word
        if inside:
            ends.append(len(flat))
        kept, at = [], 0
        for x in cut:
            kept.append(flat[at : starts[x["start"]]])
            at = ends[x["end"] - 1]
        out.append(b"".join([*kept, flat[at:]]).decode())
    return pa.array(out, pa.string())


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_matched: int = WINDOW, share: int = 20, drop: bool = False, **how
) -> DataFrame:
    """docs without benchmark passages: rows over the coverage limit lose every hit span, or go (`drop`);
    below that limit spans whose longest match has at least `min_matched` words are cut, unless `drop`."""
    name = fresh(docs, "found")
    found = contamination(docs, benchmark, text_col, out=name, **how)
    over = contaminated(name, share)
    if drop:
        return found.where(~over).drop(name)
    spans = F.when(over, F.col(f"{name}.spans")).otherwise(F.filter(f"{name}.spans", lambda x: x["matched"] >= min_matched))
    return found.withColumn(text_col, _without(F.col(text_col), spans)).drop(name)


def op1(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of the contract: one row a document."""
    found = contamination(documents.select("doc_id", "text"), benchmark)
    c = "contamination"
    return found.select(
        "doc_id",
        f"{c}.n_words",
        f"{c}.n_hit",
        f"{c}.n_items",
        F.sha2(F.array_join(f"{c}.items", ","), 256).alias("items_sha256"),
        contaminated(c).alias("contaminated"),
    )


def brute_force(text: str | None, items: list[tuple[object, str | None]], window: int = WINDOW) -> tuple:
    """The contract by definition, for tests: every window against every place."""
    words = alnum_words(text.encode() if text else None)
    hit, found = set(), set()
    for item, body in items:
        own = alnum_words(body.encode() if body else None)
        n = min(len(own), window)
        for a in range(len(own) - n + 1) if n else ():
            for i in range(len(words) - n + 1):
                if words[i : i + n] == own[a : a + n]:
                    hit.update(range(i, i + n))
                    found |= set() if item is None else {str(item)}
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)


def oracle(window: int = WINDOW) -> str:
    """The same by definition, in DuckDB: all windows of all items against all runs of as many words."""
    words = r"regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    # runs of n words from word i on, for the lengths that some item has
    run = lambda n: " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER s" for k in range(1, n))])
    runs = lambda t: " UNION ALL ".join(
        f"SELECT {t}.key AS key, i, {n} AS n, {run(n)} AS win FROM {t} WHERE {n} IN (SELECT n FROM lengths) WINDOW s AS (PARTITION BY {t}.key ORDER BY i)"
        for n in range(1, window + 1)
    )
    return f"""
WITH items AS (SELECT row_number() OVER () AS key, item_id, {words} AS ws FROM benchmark),
lengths AS (SELECT DISTINCT least(len(ws), {window}) AS n FROM items WHERE len(ws) > 0),
docs AS (SELECT row_number() OVER () AS key, doc_id, {words} AS ws FROM documents),
iw AS (SELECT key, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM items),
dw AS (SELECT key, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM docs),
ir AS ({runs("iw")}),
dr AS ({runs("dw")}),
windows AS (SELECT DISTINCT item_id, n, win FROM ir JOIN items USING (key) WHERE win IS NOT NULL AND n = least(len(ws), {window})),
hits AS (SELECT dr.key, i, dr.n, item_id FROM dr JOIN windows ON dr.n = windows.n AND dr.win = windows.win),
words AS (SELECT key, count(DISTINCT place) AS n_hit FROM (SELECT key, unnest(range(i, i + n)) AS place FROM hits) GROUP BY key),
found AS (SELECT key, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY key)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN words USING (key) LEFT JOIN found USING (key)"""
