"""Native column functions on text: tokens, spans to protect, readability, scripts. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearspark.kernel.engine import PROTECTED
from clearspark.kernel.tables import INVISIBLE

WORD = r"[A-Za-z]+(?:['’][A-Za-z]+)*"
DOUBTFUL = r"[\x{200b}\x{2060}\x{feff}\x{00ad}\x{e0000}-\x{e007f}\x00-\x08\x0b-\x1f\x7f-\x{9f}]"
#: length classes of texts: up to but without the bound
LENGTHS = ((20, "under 20"), (60, "20-59"), (150, "60-149"), (None, "150 and more"))


def chunks(text: Column) -> Column:
    """Runs of anything but white space (of all scripts)."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def words(text: Column) -> Column:
    """Latin words, with inner apostrophes."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def letter_count(text: Column) -> Column:
    """Characters in words of two letters and more, apostrophes included."""
    return F.aggregate(words(text), F.lit(0), lambda n, w: n + F.when(F.length(w) > 1, F.length(w)).otherwise(0))


def grams(text: Column, size: int = 4) -> Column:
    """Letter sequences of the normalised text, with a space at either end; empty if under two letters."""
    body = F.trim(F.regexp_replace(F.lower(text), "[^a-z]+", " "))
    padded = F.concat(F.lit(" "), body, F.lit(" "))
    found = F.regexp_extract_all(padded, F.lit(f"(?=(.{{{size}}}))"), F.lit(1))
    return F.when(F.length(body) >= 2, found).otherwise(F.array().cast("array<string>"))


def protected(text: Column, kind: str) -> Column:
    """Spans of one kind that stay as they are, as strings."""
    return F.regexp_extract_all(text, F.lit(f"(?U){PROTECTED[kind]}"), F.lit(0))


def protected_count(text: Column, kind: str) -> Column:
    return F.regexp_count(text, F.lit(f"(?U){PROTECTED[kind]}"))


def readable(text: Column) -> Column:
    """No control, invisible or odd white-space character, other than line breaks and tabs."""
    return ~text.rlike(r"[\p{C}\p{Z}&&[^ \n\r\t]]")


def doubtful(text: Column) -> Column:
    """Holds a character that makes it unlikely that the text is clean."""
    return text.rlike(DOUBTFUL)


def length_class(text: Column) -> Column:
    out = None
    for bound, name in LENGTHS:
        if bound is None:
            return out.otherwise(name)
        test = F.length(text) < bound
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def script_count(text: Column, script: str) -> Column:
    """Characters of one script, by Java's Unicode tables."""
    return F.regexp_count(text, F.lit(rf"\p{{Is{script}}}"))


def mixed_script(word: Column, scripts: tuple[str, ...] = ("Latin", "Greek", "Cyrillic", "Armenian", "Cherokee")) -> Column:
    """Letters of more than one of the scripts in a word."""
    return sum((F.when(word.rlike(rf"\p{{Is{s}}}"), 1).otherwise(0) for s in scripts), F.lit(0)) > 1


def trigger(text: Column) -> Column:
    """Which families of rules can find anything, as bits: most clean texts have none of them set.

    1 not ASCII, 2 an entity, 4 a percent escape, 8 a backslash escape, 16 a stretched letter, 32 a digit or sign in a word
    """
    tests = (r"[^\x00-\x7f]", r"&[#A-Za-z]", r"%[0-9A-Fa-f]{2}", r"\\[xuU]", r"(?i)([a-z])\1{2}", r"[A-Za-z][0-9@$!]|[0-9@$!][A-Za-z]")
    return sum((F.when(text.rlike(t), 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


def same(a: Column, b: Column, caseless: Column | bool = False) -> Column:
    caseless = F.lit(caseless) if isinstance(caseless, bool) else F.coalesce(caseless, F.lit(False))
    return F.when(caseless, F.lower(a) == F.lower(b)).otherwise(a == b)


def hash_split(key: Column) -> Column:
    """dev or test by the first byte of the key's sha256."""
    first = F.conv(F.substring(F.sha2(key, 256), 1, 2), 16, 10).cast("int")
    return F.when(first % 2 == 0, "dev").otherwise("test")


INVISIBLE_CLASS = "".join(rf"\x{{{ord(c):x}}}" for c in INVISIBLE)
