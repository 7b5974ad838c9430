"""Token ids in Arrow stream files of fixed-size lists, and random access to them.

A shard is one Arrow IPC file. Each record batch holds equal-length sequences: `ids`, a
fixed-size list of unsigned 16- or 32-bit ids, and `mask`, a fixed-size list of bits (0 only in the
padding of a shard's last sequence). All values lie flat in one buffer, so sequence i of a batch is
a zero-copy slice; a shard in a file system of the machine is mapped into memory and nothing of it is copied. The
documents' places stand in a second file beside it.

Texts are dealt to shards by ranges of doc_id and encoded in each task. A file is written once, under a name
of its task's attempt, and never renamed or written over, which suits stores without a rename. The attempt that
counts is the one whose row Spark returns; op5() then deletes what other attempts have left. Executors reach the
folder through pyarrow.fs, by the URI that the session names, so the folder can be
on any store that pyarrow knows. What comes to the driver is one row a shard.

Encoding: a text is cut before each single space that is followed by a letter, digit or ASCII sign.
The split pattern of the tokenizer starts a pre-token at exactly such a space, so the ids of the
chunks, joined, are the ids of the text. Chunks are encoded by the library, and remembered by the Python worker, from
task to task, up to a fixed number of chunks of bounded length.

Defined cases: null text is empty and still gets its end id; rows with a null doc_id come last;
rows of equal doc_id stand together, ordered by text; texts of any length are encoded whole; other columns are not
read; an empty table writes no shard and gives no row. Ranges of doc_id are cut by a sample, so rows of one id, or
without one, are dealt to one shard: its size is bounded by theirs, its memory by a batch's.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearspark.llm.common import LONGEST_KEY, Scratch, text_bytes
from clearspark.llm.token_counts import byte_alphabet

LENGTH = 2048
BATCH = 64
#: The byte-level split pattern for ASCII text; an optional space leads each kind of run.
ASCII_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
#: The same for texts whose other characters are letters of the blocks U+00C0 to U+024F (all but two are letters).
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
LATIN_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^ \t-\r{LATIN}0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
NOT_LATIN = re.compile(rf"[^\x00-\x7f{LATIN}]")
#: A space starts a chunk only before these bytes: ASCII signs and first bytes of U+00C0 to U+027F, where no white space is.
SAFE = re.compile(rb" (?=[\x21-\x7e\xc3-\xc9])")
#: Signs that end a word and are a pre-token of their own there.
MARKS = frozenset((b".", b",", b";", b":", b"!", b"?"))
UNSAFE = re.compile(rb" (?![\x21-\x7e\xc3-\xc9])")
#: Lines that can be encoded one by one: no white space at their ends, so the line break between is a pre-token.
LINES = re.compile(rb"[^ \t-\r\x80-\xff](?:[^ \t-\r]*[^ \t-\r\x80-\xff])?(?:\n[^ \t-\r\x80-\xff](?:[^ \t-\r]*[^ \t-\r\x80-\xff])?)+")


def latin_word(chunk: bytes) -> bool:
    """Letters of ASCII and the Latin blocks alone: one pre-token."""
    return len(chunk) <= LONGEST_KEY and (word := chunk.decode()).isalpha() and not NOT_LATIN.search(word)


class Encoder(dict):
    """chunk (without its leading space) -> its ids as little-endian bytes, the library's model doing the work."""

    def __init__(self, path: str, kind: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.kind, self.most = self.library.model, np.dtype(kind), most
        self.letters = byte_alphabet()
        self.table = {i: c for i, c in enumerate(self.letters)}
        self.specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        ids = np.arange(self.library.get_vocab_size(), dtype=self.kind)
        self.bytes_of = [x.tobytes() for x in ids]
        self.pieces: dict[bytes, bytes] = {}
        self.starts: dict[bytes, bytes] = {}
        self.space = self.letters[0x20]

    def tokens(self, letters: str) -> bytes:
        """Ids of one pre-token, in the letters of the byte alphabet."""
        return b"".join([self.bytes_of[t.id] for t in self.model.tokenize(letters)])

    def piece(self, piece: bytes) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = self.tokens(piece.decode("latin-1").translate(self.table))
            if len(self.pieces) < self.most // 2 and len(piece) <= LONGEST_KEY:
                self.pieces[piece] = got
        return got

    def run(self, text: bytes) -> bytes:
        """Ids of any run of text that starts and ends where the library would cut too."""
        if not any(s in text for s in self.specials):
            if text.isascii():
                return b"".join([self.piece(p) for p in ASCII_PIECE.findall(text)])
            string = text.decode()
            if not NOT_LATIN.search(string):
                return b"".join([self.piece(p.encode()) for p in LATIN_PIECE.findall(string)])
        ids = self.library.encode(text.decode(), add_special_tokens=False).ids
        return np.array(ids, self.kind).tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters: one pre-token, and letters of the byte alphabet as they are
            got = self.tokens(self.space + chunk.decode())
        elif chunk[-1:] in MARKS and (chunk[:-1].isalpha() or latin_word(chunk[:-1])):
            got = self[chunk[:-1]] + self.piece(chunk[-1:])
        elif b"\n" in chunk and LINES.fullmatch(chunk):
            first, *rest = chunk.split(b"\n")
            return b"".join([self[first], *(x for line in rest for x in (self.piece(b"\n"), self.bare(line)))])
        elif latin_word(chunk):
            got = self.tokens((b" " + chunk).decode("latin-1").translate(self.table))
        else:
            got = self.run(b" " + chunk)
        if len(self) < self.most and len(chunk) <= LONGEST_KEY:
            self[chunk] = got
        return got

    def bare(self, chunk: bytes) -> bytes:
        """Ids of a chunk without a space before it."""
        got = self.starts.get(chunk)
        if got is None:
            got = self.tokens(chunk.decode()) if chunk.isalpha() else self.run(chunk)
            if len(self.starts) < self.most // 2 and len(chunk) <= LONGEST_KEY:
                self.starts[chunk] = got
        return got

    def encode(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        first, *rest = SAFE.split(text) if UNSAFE.search(text) else text.split(b" ")
        return b"".join([self.run(first) if first else b"", *map(self.__getitem__, rest)])


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else f"file://{uri[5:]}")


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, kind: str) -> Encoder:
    """The encoder that a Python worker keeps from task to task."""
    if (path, kind) not in _encoders:
        _encoders.clear()
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


def _open(store, path: str):
    """A shard for reading: mapped where it lies in the machine's own file system."""
    from pyarrow import fs

    return pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)


class ShardWriter:
    """Cuts a stream of documents' ids into fixed-length sequences and writes them as record batches."""

    def __init__(self, sink, kind: str, length: int = LENGTH, batch: int = BATCH):
        value = pa.from_numpy_dtype(np.dtype(kind))
        self.kind, self.length, self.batch = np.dtype(kind), length, batch
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.parts: list[bytes] = []
        self.held = 0

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.batch * self.length * self.kind.itemsize:
            self.flush(False)

    def flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.parts), self.kind)
        step = self.batch * self.length
        at = 0
        while len(flat) - at >= step or (last and at < len(flat)):
            part = flat[at : at + step]
            at += len(part)
            n = -(-len(part) // self.length) * self.length
            mask = np.zeros(n, bool)
            mask[: len(part)] = True
            full = np.zeros(n, self.kind)
            full[: len(part)] = part
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (full, mask)]
            self.out.write_batch(pa.record_batch(arrays, schema=self.schema))
        self.parts = [flat[at:].tobytes()]
        self.held = len(self.parts[0])

    def close(self) -> None:
        self.flush(True)
        self.out.close()


class ShardReader:
    """Random access: ids of any range of a shard, as zero-copy slices where a range lies in one batch."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        field = self.file.schema.field("ids").type
        self.length, self.at, self.flat = field.list_size, -1, None
        self.per_batch = self.file.get_batch(0).num_rows * self.length if self.file.num_record_batches else 1

    def batch(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at, self.flat = k, self.file.get_batch(k).column("ids").values.to_numpy(zero_copy_only=True)
        return self.flat

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i."""
        k, j = divmod(i, self.per_batch // self.length)
        got = self.file.get_batch(k)
        return got.column("ids")[j].values.to_numpy(), got.column("mask")[j].values.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        parts = []
        while n > 0:
            k, j = divmod(start, self.per_batch)
            part = self.batch(k)[j : j + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write_shards(
    docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, length: int = LENGTH, shard_bytes: int = 32 << 20
) -> DataFrame:
    """Writes the shards and returns one row a shard: shard, its files, n_docs, n_tokens, first_id."""
    small = _ids_fit(tokenizer)
    n = max(docs.sparkSession.sparkContext.defaultParallelism, -(-text_bytes(docs, text_col) // shard_bytes))
    dealt = (
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(n, F.col("doc_id").asc_nulls_last())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        encoder = writer = None
        ids, starts, sizes, at = [], [], [], 0
        kind = "<u2" if small else "<u4"
        store, base = _store(folder)
        name = f"{base}/shard-{shard:06d}-{attempt}.arrow"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(name)
                encoder, writer = _encoder(tokenizer, kind), ShardWriter(sink, kind, length)
                end = np.array([end_id], kind).tobytes()
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                got = encoder.encode(text) + end
                writer.add(got)
                ids.append(doc)
                starts.append(at)
                sizes.append(len(got) // writer.kind.itemsize)
                at += sizes[-1]
        if writer is None:
            return
        writer.close()
        sink.close()
        places = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})
        with store.open_output_stream(f"{name}.places") as out, pa.ipc.new_file(out, places.schema) as file:
            file.write_table(places)
        yield pa.RecordBatch.from_pylist(
            [{"shard": shard, "file": name, "n_docs": len(ids), "n_tokens": at}],
            pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
        )

    return dealt.mapInArrow(write, "shard int, file string, n_docs bigint, n_tokens bigint")


def _ids_fit(tokenizer: str) -> bool:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """One row a document from the files alone: doc_id, start, n_tokens, ids_crc32. `shards`: shard, file, first."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with _open(store, f"{row['file']}.places") as f:
                    places = pa.ipc.open_file(f).read_all().to_pydict()
                with _open(store, row["file"]) as f:
                    reader = ShardReader(f)
                    crc = [
                        zlib.crc32(reader.ids(a, n).astype("<u4").tobytes())
                        for a, n in zip(places["start"], places["n_tokens"], strict=True)
                    ]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(places["doc_id"], pa.int64()),
                    "start": pa.array(np.array(places["start"], np.int64) + row["first"], pa.int64()),
                    "n_tokens": pa.array(places["n_tokens"], pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                })

    return shards.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _tidy(folder: str, kept: set[str]) -> None:
    """Deletes what attempts have left whose rows did not count."""
    from pyarrow import fs

    store, base = _store(folder)
    for info in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if info.is_file and info.base_name.startswith("shard-") and info.base_name.removesuffix(".places") not in kept:
            store.delete_file(info.path)


def op5(documents: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Writes all documents' ids, reads the files back and returns the digest of the contract."""
    spark = documents.sparkSession
    folder = folder or Scratch(spark).path("tokens")
    rows = sorted(write_shards(documents, tokenizer, folder).collect())  # one row a shard
    _tidy(folder, {r.file.rsplit("/", 1)[-1] for r in rows})
    first, shards = 0, []
    for r in rows:
        shards.append((r.shard, r.file, first))
        first += r.n_tokens
    table = spark.createDataFrame(shards, "shard int, file string, first bigint")
    return read_shards(table.repartition(max(1, len(shards)), "shard"), folder)
