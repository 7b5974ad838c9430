"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms of a document are its words (hashed), the shapes of its whole words, and what levels these shares reach: words
that follow themselves, lines and words that came before, and signs. From at most `most_labelled` labelled documents (those of smallest hash, so the
bound is a parameter and the choice does not depend on the layout) the driver fits inverse document
frequencies and a truncated SVD. The labelled documents' latent vectors, their labels and the
projection are broadcast: at most most_labelled x rank + dims x rank floats.

Every document is then projected in Arrow batches and compared with every labelled vector in exact
blocked cosine products. The score is the mean label of the `neighbours` nearest, weighted by the eighth power of the
similarity (near copies then count far more than what is merely in the same language). Similarities are taken
to six decimals; where more documents tie at the last place than there are places, they share these places
evenly, so the order of the labelled rows does not matter. No shuffle touches the documents to score.

Defined cases: null or empty text, and text that is orthogonal to all neighbours, gets the share of
label 1 among the labelled; null labels and ids are not learnt from; rows of one doc_id that disagree each
count; without any labels every score is 0.5; rows are judged one by one, equal rows alike; very long texts are
read whole; an empty table gives no row; other columns are not read, and keep_good() carries them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearspark.llm.common import LONGEST_KEY, fresh, space_words

DIMS, RANK = 4096, 64
WORD_DIMS = 3072  # of DIMS, for words; shapes have the others but for the last 64, where shares stand
MOST_LABELLED = 4096
NEIGHBOURS = 25
POWER = 8
#: Shares of a text (words like the one before, repeated lines, repeated words, signs) are terms by the levels they reach.
LEVELS = np.array([0.1, 0.2, 0.35, 0.5, 0.7, 0.85, 0.95])
LEVEL_COUNT = 1000.0
SIGNS = b"#*$%&|<>"


#: Classes of a word's bytes: capital, small or not ASCII, digit; other signs stand for themselves.
_CLASSES = bytes(0x58 if 0x41 <= b <= 0x5A else 0x78 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x39 if 0x30 <= b <= 0x39 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


def _shape(word: bytes) -> bytes:
    """Classes of a word's characters, runs shortened: `Ab%%%` -> Xx%."""
    return _RUN.sub(rb"\1", word.translate(_CLASSES))


class Terms(dict):
    """word -> its two term numbers, packed in one integer; remembered up to `most` words of up to LONGEST_KEY bytes."""

    def __init__(self, most: int = 300_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        shape = DIMS - WORD_DIMS - 64
        a = xxhash.xxh3_64_intdigest(word.lower().strip(b".,;:!?")) % WORD_DIMS
        b = WORD_DIMS + xxhash.xxh3_64_intdigest(_shape(word), 7) % shape
        got = a << 16 | b
        if len(self) < self.most and len(word) <= LONGEST_KEY:
            self[word] = got
        return got

    def vector(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and their weights, log(1 + count)."""
        words = space_words(text)
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        both = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        n = len(words)
        counts = np.bincount(np.concatenate((both >> 16, both & 0xFFFF)), minlength=DIMS).astype(np.float64)
        shapes = counts[WORD_DIMS:]
        shapes *= 40.0 / n  # shapes by share, so that length does not blur them
        lines = text.split(b"\n")
        shares = (
            (both[1:] == both[:-1]).sum() / n,
            (len(lines) - len(set(lines))) / len(lines),
            1 - len(np.unique(both)) / n if n >= 100 else 0.0,
            1 - len(text.translate(None, SIGNS)) / len(text),
        )
        for k, share in enumerate(shares):  # a term for each level that a share reaches
            counts[DIMS - 64 + k * len(LEVELS) : DIMS - 64 + k * len(LEVELS) + int(np.searchsorted(LEVELS, share, "right"))] = LEVEL_COUNT
        at = np.flatnonzero(counts)
        return at, np.log1p(counts[at]).astype(np.float32)


class Model:
    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray, prior: float, neighbours: int):
        self.idf, self.basis, self.vectors, self.labels = idf, basis, vectors, labels
        self.prior, self.neighbours = prior, neighbours

    def project(self, terms: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(terms), self.basis.shape[1]))
        for k, (at, w) in enumerate(terms):
            if len(at):
                out[k] = (w.astype(np.float64) * self.idf[at]) @ self.basis[at]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def score(self, terms: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(terms), 0.5)
        vectors, out = self.project(terms), np.full(len(terms), self.prior)
        k = min(self.neighbours, len(self.labels))
        for a in range(0, len(terms), 256):  # blocks of exact cosine products
            out[a : a + 256] = self.vote(np.round(vectors[a : a + 256] @ self.vectors.T, 6), k)
        return np.clip(out, 0, 1)

    def vote(self, cosine: np.ndarray, k: int) -> np.ndarray:
        """Weighted mean label of the k nearest of each row; those that tie at the k-th place share what places are left."""
        few = np.argpartition(-cosine, min(2 * k, cosine.shape[1] - 1), axis=1)[:, : 2 * k]  # holds the k nearest, mostly with all ties
        near = np.take_along_axis(cosine, few, 1)
        last = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
        ties = (cosine == last).sum(1)
        above, level = near > last, near == last
        places = k - above.sum(1)
        weight = np.clip(near, 0, None) ** POWER
        share = np.where(above, 1.0, level / np.maximum(level.sum(1, keepdims=True), 1) * places[:, None])
        top, total = (weight * share * self.labels[few]).sum(1), (weight * share).sum(1)
        wide = np.flatnonzero(ties > level.sum(1))  # more ties than were looked at: all of them share
        for r in wide:
            own = np.clip(cosine[r], 0, None) ** POWER
            all_ = np.where(cosine[r] > last[r], 1.0, (cosine[r] == last[r]) * places[r] / ties[r]) * own
            top[r], total[r] = (all_ * self.labels).sum(), all_.sum()
        return np.where(total > 0, top / np.where(total > 0, total, 1), self.prior)


def fit(found: list[tuple[np.ndarray, np.ndarray]], labels: list[int], rank: int = RANK, neighbours: int = NEIGHBOURS, seed: int = 0) -> Model:
    """idf and a truncated SVD (by random projection and power steps) of the labelled texts' terms."""
    kept = [k for k, (at, _) in enumerate(found) if len(at)]
    found, y = [found[k] for k in kept], np.array([float(labels[k]) for k in kept])
    n = len(found)
    if not n:
        return Model(np.ones(DIMS, np.float32), np.zeros((DIMS, 1)), np.zeros((0, 1)), y, 0.5, neighbours)
    table = np.zeros((n, DIMS), np.float32)
    for k, (at, w) in enumerate(found):
        table[k, at] = w
    idf = (np.log((1 + n) / (1 + (table > 0).sum(0))) + 0.3).astype(np.float32)
    table *= idf
    table /= np.linalg.norm(table, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    size = min(rank + 16, n, DIMS)
    q = np.linalg.qr(table.T @ rng.standard_normal((n, size), dtype=np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(table.T @ np.linalg.qr(table @ q)[0])[0]
    _, _, right = np.linalg.svd(table @ q, full_matrices=False)
    basis = np.ascontiguousarray((q @ right.T)[:, : min(rank, size)], np.float64)
    model = Model(idf, basis, np.zeros((0, basis.shape[1])), y, float(y.mean()), neighbours)
    model.vectors = model.project(found)
    return model


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, neighbours: int = NEIGHBOURS) -> Model:
    """A model from labelled rows that are not held out; at most `most_labelled`, by smallest hash of doc_id."""
    picked = (
        labels.where("quality is not null and doc_id is not null")
        .where(~held_out(F.col("doc_id")))
        .select("doc_id", F.col("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(most_labelled)
    )
    # a doc_id may stand in many rows: at most as many texts as labels come to the driver
    own = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("h"), _terms("text").alias("t"))
    rows = own.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "h").limit(most_labelled).collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality, r.t.at, r.t.weight))
    found = [(np.array(r.t.at, np.int64), np.array(r.t.weight, np.float32)) for r in rows]
    return fit(found, [r.quality for r in rows], neighbours=neighbours)


@F.arrow_udf(T.StructType([T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("weight", T.ArrayType(T.FloatType()))]))
def _terms(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Terms of labelled texts: at most DIMS numbers a text come to the driver, never the text."""
    terms = Terms()
    for batch in texts:
        found = [terms.vector(t) for t in batch.cast(pa.binary()).to_pylist()]
        yield pa.StructArray.from_arrays(
            [pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([w for _, w in found], pa.list_(pa.float32()))],
            names=["at", "weight"],
        )


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, terms = shared.value, Terms()
        for batch in texts:
            parts = [own.score([terms.vector(t) for t in batch[a : a + 1024].cast(pa.binary()).to_pylist()]) for a in range(0, len(batch), 1024)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return docs.withColumn(out, scored(F.col(text_col)))


def op6(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    docs = documents.select("doc_id", "text")
    found = score(docs, learn(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs without those that the classifier rejects."""
    name = fresh(docs, "score")
    return score(docs, learn(docs, labels), text_col, name).where(F.col(name) >= threshold).drop(name)


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def brute_force(model: Model, terms: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
    """Scores by definition, one document at a time, for tests: sorted similarities, ties sharing the last places."""
    out = []
    for at, w in terms:
        v = np.zeros(model.basis.shape[1])
        for i, x in zip(at, w, strict=True):
            v += float(x) * float(model.idf[i]) * model.basis[i].astype(float)
        norm = float(np.sqrt((v * v).sum()))
        near = sorted(((round(float((v / norm) @ u.astype(float)), 6) if norm else 0.0, float(y)) for u, y in zip(model.vectors, model.labels, strict=True)), reverse=True)
        k = min(model.neighbours, len(near))
        above = [(c, y, 1.0) for c, y in near if c > near[k - 1][0]]
        level = [(c, y) for c, y in near if c == near[k - 1][0]]
        voters = above + [(c, y, (k - len(above)) / len(level)) for c, y in level]
        total = sum(s * max(c, 0) ** POWER for c, _, s in voters)
        out.append(sum(s * y * max(c, 0) ** POWER for c, y, s in voters) / total if total else model.prior)
    return out
