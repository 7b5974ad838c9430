"""Exact Jaccard join of word-shingle sets, by set relations.

1. Each document's set of shingles is hashed. Equal sets are one class; only classes go on, so copies
   never pair up.
2. Candidates: sets of similar size whose Jaccard similarity reaches the threshold differ in at most d
   shingles. The shingles' universe is cut (by hash) into d + 1 + e parts: in at least 1 + e of
   them both sets are equal. A set's signature of a part is the hash of its shingles there; sets that share a
   signature are candidates. Parts of one or two shingles, and empty ones, say too little and have no
   signature: a set with at most e of them still has one signature at least in common with each linked set. Two
   sets that both have more are found by an exact prefix join instead, over shingles ordered rare first by
   counts over all such sets. So no signature is shared but by sets with three shingles and more in common.
3. Signatures are longs, one a part. A task ties sets that share one before anything is shuffled, so a signature that a
   third of all sets have is sent once a chunk; no list of a signature's sets is ever gathered.
4. Ties make clusters, which hold every linked pair. A cluster of up to `block` sets is joined exactly in one
   task. In a larger one each set is first joined with the set it shares most signatures with, and others
   tied to that; what these links unite needs no more joining in itself. The largest united component stays apart, and
   all other sets are joined with it and with one another in blocks. A group of near copies of one document is so
   joined in a number of texts that grows with its size, not with its square.
5. The join of sets in a task: index lists are ordered by position in blocks, so that whole blocks are skipped by
   position; what is left passes the length and position filters; and the overlaps of a set with all others
   are derived from those of a highly similar set (that of the most lists in common) whose answers are known:
   only the shingles in which the two differ are counted.
6. Only links that unite two sets leave a task: fewer than there are sets, never all pairs of a group.
   Connected components of these are the classes' components.

Defined cases: null text and text without words have the empty set, size 0, and are linked with nothing
(their component is their own doc_id); a text of fewer words than a shingle has one element; rows of
equal or null doc_id count as documents of their own; component_id is null only where all linked ids are; texts of
any length are read whole; other columns are not read, and keep_one() carries them; an empty table gives no row.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clearspark.llm.common import Scratch, WordHashes, fresh, mix, rolling, space_words, word_hashes
from clearspark.llm.components import components

SHINGLE, PERCENT = 3, 90
BLOCK = 256
SMALL_PART = 2
CHUNK_SIGNATURES = 1 << 18
TASK_SETS = 1024  # sets of small clusters that go to one task
KNOWN = 8  # sets whose answers are kept
NULL_ID = (1 << 63) - 1  # stands for a null doc_id while minima are taken


def shingles(words: list[bytes], hashes: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of all windows of `width` words; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    if len(words) < width:
        return mix(rolling(h, len(words)) + np.uint64(len(words)))
    return np.unique(rolling(h, width))


def set_key(s: np.ndarray) -> tuple[int, str]:
    """A 64-bit and a 128-bit key of the set."""
    with np.errstate(over="ignore"):
        a = np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))
        b = np.add.reduce(mix(s + np.uint64(0x14057B7EF767814F)))
    return int(a.astype(np.int64)), f"{int(a):016x}{int(b):016x}"


def size_class(n: int, percent: int) -> int:
    """Classes of sizes so that linked sets are in the same class or in neighbouring ones."""
    k, low = 0, 1
    while (high := low * 100 // percent + 1) <= n:
        k, low = k + 1, high
    return k


def class_parts(k: int, percent: int) -> tuple[int, int]:
    """Parts for the joins of class k with itself and the next, and how many near-empty ones may be left out."""
    low = 1
    for _ in range(k):
        low = low * 100 // percent + 1
    largest = low * 100 // percent  # of class k
    partner = largest * 100 // percent
    differ = (largest + partner) * (100 - percent) // (100 + percent)
    spare = (differ + 1) // 25 + (2 if differ >= 20 else 1) if differ >= 3 else 0
    return differ + 1 + spare, spare


def signatures(s: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, bool]:
    """Signatures of a set for the joins of its own size class and the one below, and whether they may lack a link."""
    own, out, weak = size_class(len(s), percent), [np.zeros(0, np.uint64)], False
    for k in (own, own - 1) if own else (own,):
        m, spare = class_parts(k, percent)
        if m == 1:
            continue  # only equal sets can be linked
        part = (mix(s ^ np.uint64(k + 1)) >> np.uint64(20)) % np.uint64(m)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(m + 1))
        with np.errstate(over="ignore"):
            total = np.concatenate(([np.uint64(0)], np.cumsum(mix(s[order] ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)))
            sums = total[bounds[1:]] - total[bounds[:-1]]
            got = mix(sums ^ mix(np.arange(m, dtype=np.uint64) + np.uint64(k << 32)))
        small = np.diff(bounds) <= SMALL_PART
        out.append(got[~small])
        weak |= bool(small.sum() > spare)
    return np.concatenate(out), weak


def tie(signs: np.ndarray, owner: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of a chunk's signatures (sign, owner) are the first of their sign, by `low`; and the owners of the others with the firsts' low."""
    order = np.lexsort((low[owner], signs))
    new = np.ones(len(order), bool)
    new[1:] = signs[order[1:]] != signs[order[:-1]]
    first = np.repeat(low[owner[order[new]]], np.diff(np.r_[np.flatnonzero(new), len(order)]))
    kept = np.zeros(len(signs), bool)
    kept[order[new]] = True
    return kept, owner[order[~new]], first[~new]


class SetJoin:
    """The exact join of one block (or between two) of a cluster."""

    def __init__(self, sets: list[np.ndarray], sides: list[int] | None, percent: int = PERCENT):
        self.order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        self.sides = None if sides is None else np.array([sides[i] for i in self.order])
        flat = np.concatenate([sets[i] for i in self.order])
        _, dense, count = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count))  # rare first
        self.size = np.array([len(sets[i]) for i in self.order])
        ends = np.cumsum(self.size)
        ranks = rank[dense]
        self.sets = [np.sort(ranks[e - n : e]) for e, n in zip(ends, self.size, strict=True)]
        self.percent, self.tokens = percent, len(count)
        # full index: token -> sets
        token = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(self.sets)), self.size)
        by = np.argsort(token, kind="stable")
        self.full, self.full_at = owner[by], np.searchsorted(token[by], np.arange(self.tokens + 1))
        # index of prefixes; lists stand by position, and sets of one position by size
        self.prefix = self.size - self._least(self.size) + 1
        token = np.concatenate([s[:p] for s, p in zip(self.sets, self.prefix, strict=True)])
        owner = np.repeat(np.arange(len(self.sets)), self.prefix)
        place = np.concatenate([np.arange(p) for p in self.prefix])
        by = np.lexsort((owner, place, token))
        self.index, self.place, self.index_at = owner[by], place[by], np.searchsorted(token[by], np.arange(self.tokens + 1))
        self.answers: OrderedDict[int, np.ndarray] = OrderedDict()
        self.root = list(range(len(self.sets)))

    def _least(self, n):
        """The smallest size, and overlap, of a set linked with one of size n."""
        return -(-n * self.percent // 100)

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def _needed(self, x: int, sizes):
        """The overlap that x needs with sets of these sizes."""
        return -(-(self.size[x] + sizes) * self.percent // (100 + self.percent))

    def candidates(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """Earlier sets that pass the position and length filters in some index list of x's prefix, and in how many."""
        least = np.searchsorted(self.size, self._least(self.size[x]))
        furthest = self.size[x] - self._needed(x, self.size[x])  # no smaller set may start to agree at a later position
        found = []
        for i, t in enumerate(self.sets[x][: self.prefix[x]]):
            a, b = self.index_at[t], self.index_at[t + 1]
            b = a + np.searchsorted(self.place[a:b], furthest, "right")  # blocks of later positions are skipped
            if b > a:
                y, j = self.index[a:b], self.place[a:b]
                fits = (y >= least) & (y < x) & (1 + np.minimum(self.size[x] - i - 1, self.size[y] - j - 1) >= self._needed(x, self.size[y]))
                found.append(y[fits])
        y, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
        if self.sides is not None:
            across = self.sides[y] != self.sides[x]
            y, times = y[across], times[across]
        return y, times

    def _counted(self, tokens: np.ndarray) -> np.ndarray:
        lists = [self.full[self.full_at[t] : self.full_at[t + 1]] for t in tokens]
        return np.bincount(np.concatenate(lists), minlength=len(self.sets)) if lists else np.zeros(len(self.sets), np.int64)

    def overlaps(self, x: int, y: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Overlaps of x with every set, derived from those of the most similar candidate whose answers are known."""
        known = [(int(n), int(v)) for v, n in zip(y, times, strict=True) if int(v) in self.answers]
        got = None
        if known:
            near = max(known)[1]
            mine, other = self.sets[x], self.sets[near]
            gone, come = np.setdiff1d(other, mine, assume_unique=True), np.setdiff1d(mine, other, assume_unique=True)
            if len(gone) + len(come) < len(mine):
                got = self.answers[near] - self._counted(gone) + self._counted(come)
                self.answers.move_to_end(near)
        if got is None:
            got = self._counted(self.sets[x])
        self.answers[x] = got
        if len(self.answers) > KNOWN:
            self.answers.popitem(last=False)
        return got

    def linked(self, x: int, y: np.ndarray, shared: np.ndarray) -> np.ndarray:
        return 100 * shared >= self.percent * (self.size[x] + self.size[y] - shared)

    def links(self) -> list[tuple[int, int]]:
        """Links between original numbers that unite the linked sets, none of them needless."""
        out = []
        for x in range(len(self.sets)):
            y, times = self.candidates(x)
            if not len(y) or {self.find(int(v)) for v in y} == {self.find(x)}:
                continue
            if len(y) <= 4:
                shared = np.array([len(np.intersect1d(self.sets[x], self.sets[v], assume_unique=True)) for v in y])
            else:
                shared = self.overlaps(x, y, times)[y]
            for v in y[self.linked(x, y, shared)]:
                a, b = self.find(x), self.find(int(v))
                if a != b:
                    self.root[max(a, b)] = min(a, b)
                    out.append((self.order[x], self.order[int(v)]))
        return out


DOC = pa.schema([
    ("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("key", pa.string()),
    ("signatures", pa.list_(pa.int64())), ("tied", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64())),
])


def _described(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, row (a hash of the text), n, low and key (null for the empty set); and once a task for each set: signatures that
    no set before it in its chunk has, the sets of the others (`tied`), and all shingles if signatures may lack a link."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = word_hashes(3), set()
        rows: list[list] = []
        signs: list[np.ndarray] = []
        owner: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            if signs:
                flat, of = np.concatenate(signs), np.repeat(np.array(owner), [len(x) for x in signs])
                low = np.array([r[3] or 0 for r in rows], np.int64)
                kept, who, first = tie(flat, of, low)
                for k, own in zip(owner, np.split(np.arange(len(flat)), np.cumsum([len(x) for x in signs])[:-1]), strict=True):
                    rows[k][5] = flat[own][kept[own]].view(np.int64)
                order = np.argsort(who, kind="stable")
                who, first = who[order], first[order]
                for part in np.split(np.arange(len(who)), np.flatnonzero(np.diff(who)) + 1) if len(who) else ():
                    rows[who[part[0]]][6] = first[part]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), DOC, strict=True)], schema=DOC)

        for batch in batches:
            ids = (batch.column(c).to_pylist() for c in ("doc_id", "row"))
            for doc, row, text in zip(*ids, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                s = shingles(space_words(text, lower=True), hashes)
                rows.append([doc, row, len(s), None, None, None, None, None])
                if len(s):
                    low, key = set_key(s)
                    rows[-1][3:5] = low, key
                    if low not in seen:
                        seen.add(low)
                        found, weak = signatures(s, percent)
                        signs.append(found)
                        owner.append(len(rows) - 1)
                        held += len(found)
                        if weak:
                            rows[-1][7] = s.view(np.int64)
                if held >= CHUNK_SIGNATURES or len(rows) >= CHUNK_SIGNATURES // 8:
                    yield flush()
                    rows, signs, owner, held = [], [], [], 0
        if rows:
            yield flush()

    kinds = "doc_id bigint, row bigint, n bigint, low bigint, key string, signatures array<bigint>, tied array<bigint>, shingles array<bigint>"
    return docs.mapInArrow(describe, kinds)


def _prefixes(described: DataFrame, percent: int) -> DataFrame:
    """low, sign of the prefix join among sets whose signatures may lack a link: of each, its rarest shingles, as many as
    a linked set can't do without; shingles of one set alone tie nothing."""
    own = described.where("shingles is not null").select("low", "n", "shingles").dropDuplicates(["low"])
    each = own.select("low", "n", F.explode("shingles").alias("sign"))
    counts = each.groupBy("sign").agg(F.count("*").alias("sets"))
    ranked = each.join(counts, "sign").groupBy("low", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "sign"))).alias("r"))
    length = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    return ranked.select("low", F.explode(F.slice("r", F.lit(1), length)).alias("x")).where("x.sets > 1").select("low", "x.sign")


def _ties(described: DataFrame, percent: int) -> DataFrame:
    """a, b, n: sets a that share n signatures with a set b that is the first with them, by number."""
    order = Window.partitionBy("sign").orderBy("low").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    signs = described.where("size(signatures) > 0").select("low", F.explode("signatures").alias("sign"))
    met = [described.where("tied is not null").select(F.col("low").alias("a"), F.explode("tied").alias("b"))]
    for each in (signs, _prefixes(described, percent)):
        met.append(each.select(F.col("low").alias("a"), F.first("low").over(order).alias("b")))
    return met[0].unionByName(met[1]).unionByName(met[2]).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def _joined(members: DataFrame, by: list[str], percent: int) -> DataFrame:
    """Links (a, b: keys) of the sets of each group `by`, cluster by cluster. members: by, cluster, side, key, text.
    Sets of side null are all joined with one another, those of sides 0 and 1 only across."""

    def join(table):
        hashes, links = word_hashes(3), []
        found: dict = {}
        for cluster, side, key, text in zip(*(table.column(c).to_pylist() for c in ("cluster", "side", "key")), table.column("text").cast(pa.binary()).to_pylist(), strict=True):
            found.setdefault(cluster, {})[key, side] = text
        for own in found.values():
            keys, sides = [k for k, _ in own], [s for _, s in own]
            if len(keys) > 1:
                sets = [shingles(space_words(t, lower=True), hashes) for t in own.values()]
                links += [(keys[x], keys[y]) for x, y in SetJoin(sets, None if None in sides else sides, percent).links()]
        return pa.table({"a": pa.array([a for a, _ in links], pa.string()), "b": pa.array([b for _, b in links], pa.string())})

    return members.groupBy(*by).applyInArrow(join, "a string, b string")


def _large_links(large: DataFrame, ties: DataFrame, scratch: Scratch, percent: int, block: int) -> DataFrame:
    """Links of the sets of clusters of more than one block. large: low, cluster, key, text; one row a set."""
    # each set beside the one it shares most signatures with, in blocks of sets that have the same one
    best = ties.join(large.select(F.col("low").alias("a")).distinct(), "a").groupBy("a").agg(F.max(F.struct("n", "b")).alias("x")).select("a", F.col("x.b").alias("centre"))
    centres = best.groupBy("centre").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = large.join(best, large.low == best.a).join(centres, "centre").withColumn("i", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    heads = large.join(centres, large.low == centres.centre).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["centre", "i", "cluster", F.lit(None).cast("int").alias("side"), "key", "text"]
    links = scratch.write(_joined(own.select(*columns).unionByName(heads.select(*columns)), ["centre", "i"], percent), "centre_links")
    united = components(links, scratch, "centres")
    placed = large.join(united, large.key == united.vertex, "left").select("cluster", F.coalesce("root", "key").alias("root"), "key")
    sizes = placed.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    most = sizes.groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"))
    open_ = most.where("most.n < all").select(  # some set is left to be joined
        "cluster",
        F.col("most.root").alias("main"),
        F.ceil(F.col("most.n") / block).cast("int").alias("mains"),
        F.ceil((F.col("all") - F.col("most.n")) / block).cast("int").alias("rests"),
    )
    rows = scratch.write(placed.join(open_, "cluster").join(large.select("key", "text"), "key").withColumn("rest", F.col("root") != F.col("main")), "open")
    number = lambda of: F.pmod(F.xxhash64("key"), F.col(of)).cast("int")
    # blocks of the rest are 0 and on, those of the main component -1 and down; a task joins one of the rest with another block
    rows = rows.withColumn("mine", F.when(F.col("rest"), number("rests")).otherwise(-1 - number("mains")))
    other = F.when(F.col("rest"), F.sequence(-F.col("mains"), F.col("rests") - 1)).otherwise(F.sequence(F.lit(0), F.col("rests") - 1))
    dealt = rows.withColumn("other", F.explode(other)).withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})
    side = F.when(F.col("i") == F.col("j"), F.lit(None).cast("int")).otherwise((F.col("mine") == F.col("j")).cast("int"))
    return links.unionByName(_joined(dealt.select("cluster", "i", "j", side.alias("side"), "key", "text"), ["cluster", "i", "j"], percent))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row a row of docs: doc_id, row (a hash of its text), n_shingles, component_id, key (a digest of its
    set), and first: whether it is the document that stands for its component (equal rows all are)."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("row", F.xxhash64("text"))
    described = scratch.write(_described(docs, percent), "sets")
    ties = scratch.write(_ties(described, percent), "tied")
    clusters = components(ties, scratch, "ties").select(F.col("vertex").alias("low"), F.col("root").alias("cluster"))
    classes = described.where("key is not null").groupBy("key").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "row", "low")).alias("least")
    ).select("key", "least.*")
    members = scratch.write(classes.join(clusters, "low"), "members")
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sets = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID))).join(members.join(sizes, "cluster"), ["doc_id", "row"])
    sets = scratch.write(sets.select("low", "key", "cluster", "blocks", "text").dropDuplicates(["key"]), "texts")
    counted = sets.agg(F.count_if(F.col("blocks") == 1).alias("small"), F.count_if(F.col("blocks") > 1).alias("large")).first()
    task = F.pmod(F.xxhash64("cluster"), F.lit(1 + counted.small // TASK_SETS)).alias("task")
    small = sets.where("blocks = 1").select(task, "cluster", F.lit(None).cast("int").alias("side"), "key", "text")
    links = _joined(small, ["task"], percent)
    if counted.large:
        links = links.unionByName(_large_links(sets.where("blocks > 1").drop("blocks"), ties, scratch, percent, block))
    links = scratch.write(links, "links")
    roots = components(links, scratch, "links_")
    labelled = classes.join(roots, classes.key == roots.vertex, "left").select(
        "key", F.struct("doc_id", "row").alias("least"), F.coalesce("root", "key").alias("root")
    )
    labelled = scratch.write(labelled, "labelled")
    scratch.drop("tied", "members", "texts", "links")
    united = labelled.groupBy("root").agg(F.min("least").alias("component"))
    of = labelled.join(united, "root").select("key", "component")
    own = F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "row")
    return described.join(of, "key", "left").select(
        "doc_id",
        "row",
        F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.nullif("component.doc_id", F.lit(NULL_ID))).alias("component_id"),
        "key",
        (F.col("key").isNull() | (F.col("component") == own)).alias("first"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component, that of the smallest id, and all without a word. Rows that are equal in id and text are one."""
    found = jaccard_components(docs, id_col, text_col, percent).where("first")
    own, row = fresh(docs, "id"), fresh(docs, "row")
    kept = found.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(own), F.col("row").alias(row))
    numbered = docs.withColumns({own: F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)), row: F.xxhash64(text_col)})
    return numbered.join(kept.distinct(), [own, row], "left_semi").dropDuplicates([own, row]).drop(own, row)


def op8(documents: DataFrame) -> DataFrame:
    return jaccard_components(documents).select("doc_id", "n_shingles", "component_id")


def brute_force(docs: list[tuple[int, str | None]], percent: int = PERCENT) -> list[tuple]:
    """The contract by definition, for tests."""
    sets = []
    for _, text in docs:
        w = space_words(text.encode() if text else None, lower=True)
        sets.append({tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set())
    root = list(range(len(docs)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    by = sorted(range(len(docs)), key=lambda i: len(sets[i]))
    for p, i in enumerate(by):
        for j in by[p + 1 :]:
            if 100 * len(sets[i]) < percent * len(sets[j]):
                break
            shared = len(sets[i] & sets[j])
            if sets[i] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)]


def oracle(percent: int = PERCENT) -> str:
    """The same by definition, in DuckDB: equal sets are one class, classes link by shared shingles counted one by one."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS key, doc_id, regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
words AS (SELECT key, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM docs),
runs AS (SELECT key, w || ' ' || lead(w, 1) OVER s || ' ' || lead(w, 2) OVER s AS sh FROM words WINDOW s AS (PARTITION BY key ORDER BY i)),
sets AS (SELECT DISTINCT key, sh FROM runs WHERE sh IS NOT NULL UNION SELECT key, array_to_string(ws, ' ') FROM docs WHERE len(ws) IN (1, 2)),
digests AS (SELECT key, count(*) AS n, sha256(string_agg(sh, chr(10) ORDER BY sh)) AS class FROM sets GROUP BY key),
classes AS (SELECT class, min(key) AS one, any_value(n) AS n FROM digests GROUP BY class),
held AS (SELECT class, n, sh FROM classes JOIN sets ON key = one),
links AS MATERIALIZED (SELECT a.class AS x, b.class AS y FROM held a JOIN held b ON a.sh = b.sh AND a.class <> b.class AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n
  GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reached(x, y) AS (SELECT class, class FROM classes UNION SELECT reached.x, links.y FROM reached JOIN links ON reached.y = links.x),
least AS (SELECT x AS class, min(doc_id) AS component_id FROM reached JOIN digests ON y = class JOIN docs USING (key) GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM docs LEFT JOIN digests USING (key) LEFT JOIN least USING (class)"""
