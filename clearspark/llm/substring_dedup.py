"""Substring removal by Rabin-Karp hashes of every fixed-length word window.

Pass 1 hashes every window of every document. Within a task, chunks of documents are aggregated
first: of each distinct window a chunk sends only the smallest doc_id that has it, so a passage that
a third of all documents share is sent once a chunk and not once a document. Windows go by hash range
to buckets as sorted, packed arrays. Windows that repeat inside a chunk are decided there as to the chunk's own
documents. A bucket then knows, of each hash, the smallest doc_id anywhere.

Pass 2 brings the decisions to the documents' groups, where the texts are read again: repeated windows
merge into maximal removal intervals, which are cut.

A hash has 64 bits plus `extra` bytes of a second, independent one. Buckets and groups are many and of
bounded size, chosen from the bytes of text, and the partitions they are dealt to grow in number with them. A
group is a hash of the doc_id and of a byte of the text's hash, so that rows without an id, or of one
id, are spread too.

Defined cases: a null text has no words; rows with a null doc_id come after all others, whatever their
ids: they lose what others have, take nothing from others, and keep what they share among themselves; rows of equal
doc_id do not take from each other; texts of any length are cut whole; other columns are not read; an
empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearspark.llm.common import rolling, space_words, text_bytes, word_hashes

WINDOW = 13
CHUNK_WINDOWS = 1 << 20
BUCKET_WINDOWS = 1 << 21
GROUP_BYTES = 8 << 20
PART_BYTES = 32 << 20
OWN = np.dtype([("null", "u1"), ("id", "<i8"), ("sub", "u1")])


class Owners(NamedTuple):
    """The documents of some windows, in order: null ids last. An owner's rank is its place; `key` ranks the ids alone."""

    table: np.ndarray  # OWN
    key: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> tuple[Owners, np.ndarray]:
        """The distinct owners among the rows, and each row's rank."""
        order = np.lexsort((rows["sub"], rows["id"], rows["null"]))
        sorted_ = rows[order]
        new_key, new = np.ones(len(rows), bool), np.ones(len(rows), bool)
        new_key[1:] = (sorted_["id"][1:] != sorted_["id"][:-1]) | (sorted_["null"][1:] != sorted_["null"][:-1])
        new[1:] = new_key[1:] | (sorted_["sub"][1:] != sorted_["sub"][:-1])
        rank = np.empty(len(rows), np.int64)
        rank[order] = np.cumsum(new) - 1
        return cls(sorted_[new], np.cumsum(new_key)[new]), rank


def owner_rows(docs: list[tuple[int | None, int]]) -> np.ndarray:
    """doc_id and the byte of its text, as owners."""
    return np.array([(d is None, d or 0, sub) for d, sub in docs], OWN)


def _planes(a: np.ndarray) -> bytes:
    """Bytes of an array, all first bytes first: high bytes of small numbers then pack to nothing."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _unplanes(raw: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def pack(hashes: np.ndarray, extra: np.ndarray, owner: np.ndarray, owners: np.ndarray, extra_bytes: int) -> bytes:
    """Sorted hashes as differences, the second hash's bytes, and owners as places in their own list."""
    used, place = np.unique(owner, return_inverse=True)
    rows = owners[used]
    gaps = np.diff(hashes, prepend=np.uint64(0))
    pieces = [
        np.array([len(hashes), len(rows)], "<i8").tobytes(),
        *(np.ascontiguousarray(rows[c]).tobytes() for c in OWN.names),
        _planes(gaps.astype("<u8")),
        _planes(place.astype("<u4")),
        _planes(extra.astype("<u8"))[: extra_bytes * len(hashes)],
    ]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(pieces))


def unpack(blob: bytes, extra_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hashes, extra, place of each window's owner, and the owners."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw, "<i8", 2)
    at = 16
    rows = np.empty(m, OWN)
    for c in OWN.names:
        rows[c] = np.frombuffer(raw, OWN[c], m, at)
        at += m * OWN[c].itemsize
    hashes = np.cumsum(_unplanes(raw[at : at + 8 * n], n, "<u8"), dtype=np.uint64)
    at += 8 * n
    place = _unplanes(raw[at : at + 4 * n], n, "<u4")
    at += 4 * n
    extra = np.zeros((8, n), np.uint8)
    extra[:extra_bytes] = np.frombuffer(raw, np.uint8, extra_bytes * n, at).reshape(extra_bytes, n)
    return hashes, np.ascontiguousarray(extra.T).view("<u8").ravel(), place, rows


def merged(blobs: list[bytes], extra_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Owners]:
    """hashes, extra and owners' ranks of several packs."""
    parts = [unpack(x, extra_bytes) for x in blobs]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), Owners(np.zeros(0, OWN), np.zeros(0, np.int64))
    owners, rank = Owners.of(np.concatenate([p[3] for p in parts]))
    at = np.cumsum([0, *(len(p[3]) for p in parts)])
    owner = np.concatenate([rank[p[2] + a] for p, a in zip(parts, at, strict=False)])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), owner, owners


class Windows:
    """The two hashes of each window of a text's words."""

    def __init__(self, window: int, extra_bytes: int):
        self.first, self.extra = word_hashes(1), extra_bytes > 0
        self.window, self.most = window, np.uint64((1 << 8 * extra_bytes) - 1)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.of(words)
        a = rolling(h, self.window)
        if not self.extra or not len(a):
            return a, np.zeros(len(a), np.uint64)
        with np.errstate(over="ignore"):  # another base over another mixture of the words' hashes
            b = rolling((h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93), self.window, 0xA0761D6478BD642F)
        return a, b & self.most


def _by_doc(owner: np.ndarray, hashes: np.ndarray, extra: np.ndarray, owners: np.ndarray, groups: int, extra_bytes: int) -> Iterator[tuple[int, bytes]]:
    """Decided windows, packed for the groups of their documents. The hashes come sorted."""
    group = _group(owners, groups)[owner]
    order = np.argsort(group, kind="stable")
    owner, hashes, extra, group = owner[order], hashes[order], extra[order], group[order]
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(group)], strict=True):
        if b > a:
            yield int(group[a]), pack(hashes[a:b], extra[a:b], owner[a:b], owners, extra_bytes)


def _group(owners: np.ndarray, groups: int) -> np.ndarray:
    h = owners["id"].astype(np.uint64)
    with np.errstate(over="ignore"):
        h = h ^ (owners["null"].astype(np.uint64) << np.uint64(8) | owners["sub"]) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)


def _firsts(hashes: np.ndarray, extra: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows sorted by hash and owner, without repeats in one owner: hashes, extra, owner and the first owner of the window."""
    order = np.lexsort((owner, extra, hashes))
    hashes, extra, owner = hashes[order], extra[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (extra[1:] != extra[:-1])
    first = np.repeat(owner[new], np.diff(np.r_[np.flatnonzero(new), len(new)]))
    once = new.copy()
    once[1:] |= owner[1:] != owner[:-1]
    return hashes[once], extra[once], owner[once], first[once]


SENT = pa.schema([("bucket", pa.int64()), ("packed", pa.binary())])
DECIDED = pa.schema([("grp", pa.int64()), ("packed", pa.binary())])


def duplicates(docs: DataFrame, window: int, extra_bytes: int, buckets: int, groups: int, parts: int) -> DataFrame:
    """Windows to remove, by group of documents: (grp, packed). docs: doc_id, sub, text."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Windows(window, extra_bytes)
        held: list[tuple[tuple[int | None, int], np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            owners, rank = Owners.of(owner_rows([d for d, _, _ in held]))
            found = np.concatenate([h for _, h, _ in held]), np.concatenate([e for _, _, e in held])
            hashes, extra, owner, first = _firsts(*found, np.repeat(rank, [len(h) for _, h, _ in held]))
            later = owners.key[owner] > owners.key[first]  # decided here
            rows = [{"bucket": -1 - g, "packed": x} for g, x in _by_doc(owner[later], hashes[later], extra[later], owners.table, groups, extra_bytes)]
            # of windows that later stay or go elsewhere, each is sent with its smallest document
            hashes, extra, owner = hashes[~later], extra[~later], owner[~later]
            bounds = np.searchsorted(hashes, _edges(buckets))
            for b, (x, y) in enumerate(zip(np.r_[0, bounds], np.r_[bounds, len(hashes)], strict=True)):
                if y > x:
                    rows.append({"bucket": b, "packed": pack(hashes[x:y], extra[x:y], owner[x:y], owners.table, extra_bytes)})
            return pa.RecordBatch.from_pylist(rows, SENT)

        for batch in batches:
            docs_ = zip(batch.column("doc_id").to_pylist(), batch.column("sub").to_pylist(), strict=True)
            for doc, text in zip(docs_, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                a, b = hasher.of(space_words(text))
                if len(a):
                    held.append((doc, a, b))
                    n += len(a)
                if n >= CHUNK_WINDOWS:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    def decide(key, table):
        if key[0].as_py() < 0:  # decided in its chunk
            return table.select(["packed"]).add_column(0, "grp", pa.array([-1 - key[0].as_py()] * len(table), pa.int64()))
        hashes, extra, owner, owners = merged(table.column("packed").to_pylist(), extra_bytes)
        hashes, extra, owner, first = _firsts(hashes, extra, owner)
        # a chunk has sent only its smallest document: those of its others are decided by their own chunk
        later = owners.key[owner] > owners.key[first]
        rows = [{"grp": g, "packed": x} for g, x in _by_doc(owner[later], hashes[later], extra[later], owners.table, groups, extra_bytes)]
        return pa.Table.from_pylist(rows, DECIDED)

    sent = docs.mapInArrow(send, "bucket bigint, packed binary")
    return sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(decide, "grp bigint, packed binary")


def _edges(buckets: int) -> np.ndarray:
    return np.array([((b << 64) // buckets) for b in range(1, buckets)], np.uint64)


def removal(words: int, window: int, hit: np.ndarray) -> np.ndarray:
    """True for each word that a removed window covers: windows merge into maximal intervals."""
    edge = np.zeros(words + 1, np.int64)
    starts = np.flatnonzero(hit)
    edge[starts] += 1
    edge[starts + window] -= 1
    return np.cumsum(edge)[:-1] > 0


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, extra_bytes: int = 2) -> DataFrame:
    """One row a row of docs: doc_id, n_words, n_removed, kept_sha256, kept_text (words joined by a space)
    and intervals (start, end in words of each maximal removed interval)."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("sub", F.pmod(F.xxhash64("text"), F.lit(256)).cast("int"))
    size = text_bytes(docs, "text")
    buckets, groups = (max(cores, size // n + 1) for n in (6 * BUCKET_WINDOWS, GROUP_BYTES))
    decided = duplicates(docs, window, extra_bytes, buckets, groups, max(cores, buckets // 2))

    @F.arrow_udf(T.StructType([T.StructField("grp", T.LongType()), T.StructField("packed", T.BinaryType())]))
    def dealt(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        packer = zstandard.ZstdCompressor(level=1)
        for ids, subs, texts in batches:
            group = _group(owner_rows(list(zip(ids.to_pylist(), subs.to_pylist(), strict=True))), groups)
            packed = [None if t is None else packer.compress(t) for t in texts.cast(pa.binary()).to_pylist()]
            yield pa.StructArray.from_arrays([pa.array(group, pa.int64()), pa.array(packed, pa.binary())], names=["grp", "packed"])

    def cut(key, texts, removed):
        hashes, extra, owner, owners = merged(removed.column("packed").to_pylist(), extra_bytes)
        order = np.argsort(owner, kind="stable")
        owner, hashes, extra = owner[order], hashes[order], extra[order]
        rank = {tuple(x): k for k, x in enumerate(owners.table.tolist())}
        hasher, unpacker = Windows(window, extra_bytes), zstandard.ZstdDecompressor()
        rows = []
        for doc, sub, packed in zip(*(texts.column(c).to_pylist() for c in ("doc_id", "sub", "packed")), strict=True):
            text = None if packed is None else unpacker.decompress(packed)
            words = space_words(text)
            me = rank.get((doc is None, doc or 0, sub), -1)
            x, y = np.searchsorted(owner, me, "left"), np.searchsorted(owner, me, "right")
            gone = np.zeros(len(words), bool)
            if y > x and len(words) >= window:
                a, b = hasher.of(words)
                hit = np.isin(a, hashes[x:y])
                if extra_bytes and hit.any():
                    pairs = set(zip(hashes[x:y].tolist(), extra[x:y].tolist(), strict=True))
                    at = np.flatnonzero(hit)
                    hit[at] = [p in pairs for p in zip(a[at].tolist(), b[at].tolist(), strict=True)]
                gone = removal(len(words), window, hit)
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(words)
            step = np.diff(np.r_[0, gone.astype(np.int8), 0])
            rows.append({
                "doc_id": doc,
                "n_words": len(words),
                "n_removed": int(gone.sum()),
                "kept_sha256": hashlib.sha256(kept).hexdigest(),
                "kept_text": None if text is None else kept.decode(),
                "intervals": [{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)],
            })
        return pa.Table.from_pylist(rows, KEPT)

    together = max(cores, size // PART_BYTES)
    sent = docs.select("doc_id", "sub", dealt("doc_id", "sub", "text").alias("d")).select("doc_id", "sub", "d.grp", "d.packed")
    return (
        sent.repartition(together, "grp")
        .groupBy("grp")
        .cogroup(decided.repartition(together, "grp").groupBy("grp"))
        .applyInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string, intervals array<struct<start:bigint,end:bigint>>")
    )


KEPT = pa.schema([
    ("doc_id", pa.int64()),
    ("n_words", pa.int64()),
    ("n_removed", pa.int64()),
    ("kept_sha256", pa.string()),
    ("kept_text", pa.string()),
    ("intervals", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])


def op4(documents: DataFrame) -> DataFrame:
    return dedup(documents).select("doc_id", "n_words", "n_removed", "kept_sha256")


def brute_force(docs: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple]:
    """The contract by definition, for tests."""
    key = lambda d: float("inf") if d is None else d
    words = [(d, space_words(t.encode() if t else None)) for d, t in docs]
    first: dict[tuple, float] = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, float("inf")), key(d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key(d):
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def oracle(window: int = WINDOW) -> str:
    """The same by definition, in DuckDB: windows as joined words, each with the smallest doc_id it starts in."""
    run = " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER s" for k in range(1, window))])
    return f"""
WITH docs AS (SELECT row_number() OVER () AS key, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT key, doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM docs),
runs AS (SELECT key, doc_id, i, {run} AS win FROM words WINDOW s AS (PARTITION BY key ORDER BY i)),
firsts AS (SELECT win, min(doc_id) AS first FROM runs WHERE win IS NOT NULL GROUP BY win),
gone AS (SELECT DISTINCT key, i + k AS i FROM (SELECT key, i, unnest(range({window})) AS k FROM runs JOIN firsts USING (win) WHERE first < doc_id OR (doc_id IS NULL AND first IS NOT NULL))),
kept AS (SELECT key, string_agg(w, ' ' ORDER BY i) AS body, count(*) AS n FROM words ANTI JOIN gone USING (key, i) GROUP BY key)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws) - coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (key)"""
