"""Secret scans by grammar inference.

Base secrets have three fixed formats. Their values are the labelled credentials: for each kind, at most
`sample` distinct values (those of smallest hash; a documented bound on what is learnt from) become a prefix tree over
character classes, and statistically compatible states are merged (Hoeffding bound, red and blue
states) into a probabilistic automaton. Candidates are all other maximal runs of the base rule's own value characters, of
six and more, without full stops at their end, in whole texts. Each is scored: it is a secret if an automaton gives it at least the
likelihood a character that nearly all of the kind's own values reach, and makes it likelier than the background does, by
more than secrets are rarer (a log-odds with the shares of labelled values and candidates as prior). The background is a chain over character
classes, counted over every place of every candidate: tasks count, Spark adds up, and a row a pair of classes comes to the driver.

What a candidate scores depends on its classes alone, so a text is translated to classes at once, and scores are
remembered by class pattern. Passes: values of base secrets; the background; the scan. Nothing but distinct base values
and counts is shuffled.

Defined cases: null text is empty; matches that touch or overlap, of several kinds, all count; an added span never
overlaps a base one; a kind without values has no automaton and adds nothing; without base secrets nothing is added; texts
of any length are scanned whole; rows are judged one by one, equal rows alike; an empty table gives no row; `keep`
columns are carried, others are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearspark.llm.common import LONGEST_KEY, Scratch

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LONG_HEX = re.compile(rb"[0-9a-f]{24,}")  # a run of 24 and more is found as the same maximal run
SHORTEST = 6
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_.=-]{6,}")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Character classes by name and their members; other signs of candidates are classes of their own.
CLASSES = ((b"0", b"0123456789"), (b"a", b"abcdef"), (b"g", b"ghijklmnopqrstuvwxyz"), (b"A", b"ABCDEF"), (b"G", b"GHIJKLMNOPQRSTUVWXYZ"))
SIGNS = b"+/_.=-"
_WITHIN = {name[0]: math.log(len(members)) for name, members in CLASSES} | {b: 0.0 for b in SIGNS}
#: To classes; all bytes that no candidate has become spaces.
_CLASS_OF = bytes(next((name[0] for name, members in CLASSES if b in members), b if b in SIGNS else 0x20) for b in range(256))
LOST = -math.log(64) - 1  # of each character behind the end of all labelled values
FEW = 0.05
MOST_PATTERNS = 200_000
SPAN = T.StructType([T.StructField(c, t) for c, t in (("kind", T.IntegerType()), ("start", T.LongType()), ("end", T.LongType()), ("value", T.StringType()))])
_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))


def base_spans(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(kind, start, end, value) in bytes, leftmost and non-overlapping within a kind."""
    found = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        found += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(2, m.start(), m.end(), m[0]) for m in LONG_HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0]))


class Automaton:
    """A probabilistic automaton by state merging: states hold how often strings pass, end and go on."""

    def __init__(self, values: list[bytes], alpha: float = 0.05):
        self.passed, self.ended, self.next = [0], [0], [{}]
        self.margin = math.sqrt(0.5 * math.log(2 / alpha))
        self.parent: list[int] = [0]
        for value in values:
            state = 0
            self.passed[0] += 1
            for name in value.translate(_CLASS_OF):
                if name not in self.next[state]:
                    self.next[state][name] = len(self.next)
                    for column, x in ((self.passed, 0), (self.ended, 0), (self.next, {}), (self.parent, len(self.parent))):
                        column.append(x)
                state = self.next[state][name]
                self.passed[state] += 1
            self.ended[state] += 1
        self._merge()
        found = sorted(self.likelihood(v.translate(_CLASS_OF)) / len(v) for v in values)
        self.floor = found[int(len(found) * 0.01)] if found else 0.0

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self.margin * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _alike(self, p: int, q: int) -> bool:
        """Whether two states' ends and continuations could come from one distribution, all the way down q's tree."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self.passed[p], self.passed[q]
            if not n or not m:
                continue
            if self._differ(self.ended[p], n, self.ended[q], m):
                return False
            for name in self.next[p].keys() | self.next[q].keys():
                x, y = self.next[p].get(name), self.next[q].get(name)
                if self._differ(self.passed[x] if x is not None else 0, n, self.passed[y] if y is not None else 0, m):
                    return False
                if x is not None and y is not None:
                    todo.append((x, y))
        return True

    def _fold(self, p: int, q: int) -> None:
        """q, the root of a tree, becomes part of p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.passed[p] += self.passed[q]
            self.ended[p] += self.ended[q]
            for name, y in self.next[q].items():
                if name in self.next[p]:
                    todo.append((self.next[p][name], y))
                else:
                    self.next[p][name] = y

    def _merge(self) -> None:
        red, seen = [0], {0}
        while True:
            blue = sorted({(-self.passed[y], y, r, name) for r in red for name, y in self.next[r].items() if y not in seen})
            if not blue:
                return
            _, y, r, name = blue[0]
            home = next((x for x in red if self._alike(x, y)), None)
            if home is None:
                red.append(y)
                seen.add(y)
            else:
                self.next[r][name] = home
                self._fold(home, y)

    def likelihood(self, pattern: bytes) -> float:
        """Log-probability of a value of this class pattern, its end included; moves that were not seen count as rare."""
        total, state = 0.0, 0
        for at, name in enumerate(pattern):
            n, y = self.passed[state], self.next[state].get(name)
            spread = n + FEW * (len(self.next[state]) + 20)
            if y is None:  # the class is a rare one here; the value goes on as most do
                if not self.next[state]:
                    return total + math.log(FEW / spread) + LOST * (len(pattern) - at)
                total += math.log(FEW / spread) - _WITHIN[name]
                state = max(self.next[state].values(), key=self.passed.__getitem__)
                continue
            on = sum(self.passed[x] for x in self.next[state].values())  # of merged states, shares count
            total += math.log(((n - self.ended[state]) * self.passed[y] / on + FEW) / spread) - _WITHIN[name]
            state = y
        return total + math.log((self.ended[state] + FEW) / (self.passed[state] + 2 * FEW))


class Grammars:
    """Automata of the kinds, and the chain of all candidates."""

    def __init__(self, labelled: dict[int, list[bytes]]):
        self.kinds = {k: Automaton(v) for k, v in sorted(labelled.items()) if v}
        self.labelled = sum(map(len, labelled.values()))
        self.verdicts: dict[bytes, bool] = {}
        self.set_background({})

    def set_background(self, counts: dict[tuple[int, int], int]) -> None:
        """counts of (class, class that follows it); 0 is the start and the end of a candidate."""
        self.pairs = Counter(counts)
        self.from_ = Counter()
        for (a, _), n in self.pairs.items():
            self.from_[a] += n
        self.prior = math.log((self.labelled + 1) / (self.from_[0] + self.labelled + 1))

    def background(self, pattern: bytes) -> float:
        chain = zip(b"\0" + pattern, pattern + b"\0", strict=True)
        return sum(math.log((self.pairs[a, b] + FEW) / (self.from_[a] + FEW * 12)) for a, b in chain) - sum(_WITHIN[c] for c in pattern)

    def accepts(self, run: bytes) -> bool:
        """Whether a run of this class pattern, without full stops at its end, is a secret."""
        known = self.verdicts.get(run)
        if known is None:
            pattern = run.rstrip(b".")
            known = len(pattern) >= SHORTEST and self._likelier(pattern)
            if len(self.verdicts) < MOST_PATTERNS and len(run) <= LONGEST_KEY:
                self.verdicts[run] = known
        return known

    def _likelier(self, pattern: bytes) -> bool:
        rest = self.background(pattern)
        return any((x := a.likelihood(pattern)) >= a.floor * len(pattern) and x + self.prior > rest for a in self.kinds.values())


def patterns(text: bytes, base: list[tuple[int, int, int, bytes]]) -> bytes:
    """The text as classes, with base spans and all that no candidate has blank: bytes.split() gives the candidates' patterns."""
    flat = text.translate(_CLASS_OF)
    if base:
        flat = bytearray(flat)
        for _, a, b, _ in base:
            flat[a:b] = b" " * (b - a)
    return bytes(flat)


def spans(text: bytes | None, grammars: Grammars) -> tuple[list, list]:
    """Base spans and added ones, in code points."""
    if not text:
        return [], []
    base, added = base_spans(text), []
    flat = patterns(text, base)
    if grammars.kinds and any(grammars.accepts(p) for p in set(flat.split()) if len(p) >= SHORTEST):
        for m in CANDIDATE.finditer(flat.replace(b" ", b"\0")):
            if grammars.accepts(m[0]):
                end = m.end() - (len(m[0]) - len(m[0].rstrip(b".")))
                added.append((3, m.start(), end, text[m.start() : end]))
    if not text.isascii():
        place = lambda i: len(text[:i].decode())
        base, added = ([(k, place(a), place(b), v) for k, a, b, v in x] for x in (base, added))
    return base, added


@F.arrow_udf(T.ArrayType(T.StructType([SPAN["kind"], SPAN["value"]])))
def _labelled(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("value", pa.string())]))
    for batch in texts:
        yield pa.array([[{"kind": k, "value": v.decode()} for k, _, _, v in base_spans(t)] if t else [] for t in batch.cast(pa.binary()).to_pylist()], kind)


def _counts(docs: DataFrame, text_col: str) -> DataFrame:
    """a, b, n: how often class b follows class a in candidates; some rows a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            pairs: Counter = Counter()
            for run, n in held.items():
                pattern = run.rstrip(b".")
                if len(pattern) >= SHORTEST:
                    for pair in zip(b"\0" + pattern, pattern + b"\0", strict=True):
                        pairs[pair] += n
            return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in pairs], pa.int32()), "b": pa.array([b for _, b in pairs], pa.int32()), "n": pa.array(list(pairs.values()), pa.int64())})

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                if text:
                    held.update(p for p in patterns(text, base_spans(text)).split() if len(p) >= SHORTEST)
                if len(held) >= MOST_PATTERNS:
                    yield flush()
                    held.clear()
        yield flush()

    return docs.select(text_col).mapInArrow(count, "a int, b int, n bigint")


def learn(docs: DataFrame, text_col: str, sample: int) -> Grammars:
    """Automata from at most `sample` distinct values of each kind, by smallest hash, and the background of all candidates."""
    scratch = Scratch(docs.sparkSession)
    values = docs.select(F.explode(_labelled(F.col(text_col))).alias("s")).select("s.kind", "s.value").distinct()
    values = scratch.write(values, "values")
    labelled = {}
    for kind in range(3):
        rows = values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample).collect()
        labelled[kind] = sorted(r.value.encode() for r in rows)
    grammars = Grammars(labelled)
    if grammars.kinds:
        rows = _counts(docs, text_col).groupBy("a", "b").agg(F.sum("n").alias("n")).collect()  # pairs of 11 classes
        grammars.set_background({(r.a, r.b): r.n for r in rows})
    scratch.drop()
    return grammars


def scan(docs: DataFrame, keep: list[str], text_col: str = "text", sample: int = 400) -> DataFrame:
    """`keep` columns of docs with arrays `base` and `added` of struct<kind,start,end,value>."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, text_col, sample))

    @F.arrow_udf(T.StructType([T.StructField("base", T.ArrayType(SPAN)), T.StructField("added", T.ArrayType(SPAN))]))
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grammars = shared.value
        for batch in texts:
            found = [spans(t, grammars) for t in batch.cast(pa.binary()).to_pylist()]
            columns = [[[{"kind": k, "start": a, "end": b, "value": v.decode()} for k, a, b, v in row[i]] for row in found] for i in (0, 1)]
            yield pa.StructArray.from_arrays([pa.array(c, _SPAN) for c in columns], names=["base", "added"])

    return docs.select(*keep, find(F.col(text_col)).alias("_found")).select(*keep, "_found.base", "_found.added")


def _joined(column):
    names = F.array(*map(F.lit, KINDS))
    text = F.transform(column, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(text, ",")


def op9(documents: DataFrame) -> DataFrame:
    found = scan(documents.select("doc_id", "text"), ["doc_id"])
    place = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    every = F.array_sort(F.transform(F.concat("base", "added"), place))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_joined(F.array_sort(F.transform("base", place))), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
    )


def brute_added(text: str | None, grammars: Grammars) -> list[tuple[int, int]]:
    """Added spans one candidate at a time, over characters, for tests: scores from the tables, without patterns kept."""
    text, taken = text or "", []
    found = []
    for pattern, ok in ((ASSIGN, lambda m: len(m[2]) >= 6), (ACCESS, lambda m: len(m[0]) >= 20), (HEX, lambda m: len(m[0]) >= 24)):
        wide = re.compile(pattern.pattern.decode(), re.A | (re.I if pattern is ASSIGN else 0))
        taken += [m.span() for m in wide.finditer(text) if ok(m)]
    blank = list(text)
    for a, b in taken:
        blank[a:b] = "\0" * (b - a)
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", "".join(blank)):
        value = m[0].rstrip(".")
        pattern = "".join(next((n.decode() for n, own in CLASSES if c.encode() in own), c) for c in value).encode()
        if len(value) >= 6 and any(
            a.likelihood(pattern) >= a.floor * len(value) and a.likelihood(pattern) + grammars.prior > grammars.background(pattern) for a in grammars.kinds.values()
        ):
            found.append((m.start(), m.start() + len(value)))
    return found


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """The base rules as the contract words them, over characters, for tests."""
    text = text or ""
    found = []
    for k, (pattern, ok) in enumerate(((ASSIGN, lambda m: len(m[2]) >= 6), (ACCESS, lambda m: len(m[0]) >= 20), (HEX, lambda m: len(m[0]) >= 24))):
        wide = re.compile(pattern.pattern.decode(), re.A | (re.I if k == 0 else 0))
        found += [(m.start(), k, m.end()) for m in wide.finditer(text) if ok(m)]
    joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
    return (*(sum(k == x for _, x, _ in found) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest())


def base_oracle() -> str:
    """The base counts by definition, in DuckDB: matches of each kind, less those that are too short."""
    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    words = "|".join(map(either, ("password", "passwd", "secret", "token"))) + f"|{either('api')}_?{either('key')}"
    assign = f"({words})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    count = lambda pattern, group, least: f"len(list_filter(regexp_extract_all(coalesce(text, ''), '{pattern}', {group}), lambda x: length(x) >= {least}))::BIGINT"
    return f"SELECT doc_id, {count(assign, 2, 6)} AS n_assign, {count('AKIA[A-Z0-9]+', 0, 20)} AS n_access, {count('[0-9a-f]+', 0, 24)} AS n_hex FROM documents"
