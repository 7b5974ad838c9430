"""Token counts by a whole-token shortcut.

Offline, once on the driver, every vocabulary string that ends a word is given to the library's own merge model as a
whole pre-token. Those that come back as exactly one token are proven to be whole tokens; the set, which is no larger
than the vocabulary, is broadcast. A text is
then cut into chunks at white space and chunks into pre-tokens; a pre-token in the proven set counts
as one token without merging, and only the rest is merged, by the library's model. Counts of chunks
are remembered per Python worker, from task to task, up to a fixed number of chunks of bounded length, so memory is bounded.

White space bounds every pre-token of this tokenizer (its split pattern has no white space, and no
canonical composition crosses it), so counts of chunks add up to the count of the text. Chunks that
hold the text of a special token go to the library whole, which handles them as its default.

Defined cases: null text counts as empty, 0 bytes and 0 tokens; texts of any length are counted whole; rows are judged
one by one, equal rows alike; an empty table gives no row; columns of docs that are named like the added ones are
replaced, all others are carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearspark.llm.common import LONGEST_KEY

END = "</w>"
#: The split pattern of the tokenizer for ASCII text in lower case.
ASCII_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
SPACE = b" \t\n\r\x0b\x0c"


def byte_alphabet() -> list[str]:
    """Byte -> character of byte-level models: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Counter(dict):
    """chunk -> number of tokens, given the proven whole tokens."""

    def __init__(self, path: str, whole: frozenset[str], most: int = 300_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.most = self.library.model, most
        table = byte_alphabet()
        self.letters = {b: table[b] for b in range(256)}
        self.specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.whole = whole
        self.pieces: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        if piece in self.whole:
            return 1
        n = self.pieces.get(piece)
        if n is None:
            n = len(self.model.tokenize(piece))
            if len(self.pieces) < self.most and len(piece) <= LONGEST_KEY:
                self.pieces[piece] = n
        return n

    def __missing__(self, chunk: bytes) -> int:
        if any(s in chunk for s in self.specials):
            n = len(self.library.encode(chunk.decode(), add_special_tokens=False).ids)
        elif chunk.isascii():
            lower = chunk.lower().decode().translate(self.letters).encode()  # control bytes get their letters below
            n = 0
            if lower.isascii():
                for piece in ASCII_PIECE.findall(lower):
                    n += self.piece(piece.decode())
            else:
                n = self.general(chunk)
        else:
            n = self.general(chunk)
        if len(self) < self.most and len(chunk) <= LONGEST_KEY:
            self[chunk] = n
        return n

    def general(self, chunk: bytes) -> int:
        """Pre-tokens as the library's own normaliser and splitter give them."""
        text = self.library.normalizer.normalize_str(chunk.decode())
        return sum(self.piece(p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text))

    def count(self, text: bytes | None) -> int:
        return sum(map(self.__getitem__, text.split())) if text else 0


@lru_cache(2)
def prove(path: str) -> frozenset[str]:
    """Vocabulary strings that the model gives back as one token when they are a whole pre-token."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    words = (v[: -len(END)] for v in library.get_vocab(with_added_tokens=False) if v.endswith(END))
    return frozenset(w for w in words if len(library.model.tokenize(w)) == 1)


_counters: dict[tuple[str, int], Counter] = {}


def _counter(path: str, whole, most: int) -> Counter:
    """The counter that a Python worker keeps from task to task."""
    if (path, most) not in _counters:
        _counters.clear()
        _counters[path, most] = Counter(path, whole.value, most)
    return _counters[path, most]


def token_counts(docs: DataFrame, path: str, text_col: str = "text", most: int = 300_000) -> DataFrame:
    """docs with n_bytes and n_tokens of each whole text; `path` is the tokenizer's file on every worker."""
    whole = docs.sparkSession.sparkContext.broadcast(prove(path))

    @F.arrow_udf("bigint")
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(path, whole, most)
        for batch in texts:
            yield pa.array([counter.count(t) for t in batch.cast(pa.binary()).to_pylist()], pa.int64())

    return docs.withColumns({
        "n_bytes": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint"),
        "n_tokens": count(F.col(text_col)),
    })


def op2(documents: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    found = token_counts(documents.select("doc_id", "text"), path)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
