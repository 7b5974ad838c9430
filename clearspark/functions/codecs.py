"""Disguises and how to undo them, as native column functions. Each pair is an exact round trip on clean text.

Encoders are deterministic: what varies is chosen by a hash of `key`. Decoders give null where a span does not
decode strictly; nothing here raises on odd input. No Python runs on the rows.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearspark.functions.text import INVISIBLE_CLASS
from clearspark.kernel.tables import EMOJI, LOOKALIKES, MISSPELT, SHORTHAND

LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
ASCII = "".join(map(chr, range(0x21, 0x7F)))
WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
STYLES = ("MATHEMATICAL BOLD", "MATHEMATICAL SANS-SERIF", "MATHEMATICAL MONOSPACE", "MATHEMATICAL BOLD FRAKTUR", "MATHEMATICAL SANS-SERIF ITALIC", "MATHEMATICAL BOLD ITALIC", "MATHEMATICAL DOUBLE-STRUCK", "MATHEMATICAL SCRIPT")
#: Characters beside which an invisible one may be needed: emoji, and letters of other scripts.
NEEDS = r"[\p{So}\p{Sk}\x{fe0f}[^\p{IsLatin}\p{IsCommon}\p{IsInherited}\p{IsUnknown}]]"
MARKS = r"[\x{0300}-\x{036f}\x{0483}-\x{0489}\x{1ab0}-\x{1aff}\x{1dc0}-\x{1dff}\x{20d0}-\x{20ff}\x{fe20}-\x{fe2f}]"
#: One look-alike for each plain letter that has one, and an accented form for vowels and some others.
GLYPHS = {v: k for k, v in reversed(LOOKALIKES.items()) if len(v) == 1 and v not in "lI"}
ACCENTED = dict(zip("aeiouAEIOUncsz", "ǎĕĭǒŭǍĔĬǑŬňčšž", strict=True))
LEET = dict(zip("aeiost", "431057", strict=True))


def _style(name: str) -> tuple[str, str]:
    """Letters that a style has, plain and styled. Letters that live elsewhere in Unicode are left out."""
    pairs = []
    for c in UPPER + LOWER:
        try:
            pairs.append((c, unicodedata.lookup(f"{name} {'CAPITAL' if c.isupper() else 'SMALL'} {c.upper()}")))
        except KeyError:
            continue
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def pick(key: Column | None, n: int, plain: int = 0) -> Column:
    """A form of n by the key; the plain one without a key."""
    if key is None:
        return F.lit(plain)
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


# Characters


def hide_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<![A-Za-z])([A-Za-z])(?=[A-Za-z]{2})", "$1​")


def zero_width(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<![{INVISIBLE_CLASS}]|{NEEDS})[{INVISIBLE_CLASS}]++(?!{NEEDS})", "")


def hide_tags(text: Column, phrase: str) -> Column:
    return F.concat(text, F.lit("".join(chr(0xE0000 + ord(c)) for c in phrase)))


def tag_characters(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\x{1f3f4})(?<![\x{e0020}-\x{e007e}])[\x{e0020}-\x{e007e}]+\x{e007f}?", "")


def tags_hidden(text: Column) -> Column:
    """What tag characters say: their code points, less the block's start."""
    run = F.regexp_extract(text, r"(?<!\x{1f3f4})(?<![\x{e0020}-\x{e007e}])([\x{e0020}-\x{e007e}]+)", 1)
    plain = "".join(map(chr, range(0x20, 0x7F)))
    return F.translate(run, "".join(chr(0xE0000 + ord(c)) for c in plain), plain)


def styled(text: Column, key: Column) -> Column:
    out = text
    for k, name in enumerate(STYLES):
        out = F.when(pick(key, len(STYLES)) == k, F.translate(text, *_style(name))).otherwise(out)
    return out


def styled_alphabet(text: Column) -> Column:
    pairs = [_style(name) for name in STYLES]
    return F.translate(text, "".join(b for _, b in pairs), "".join(a for a, _ in pairs))


def widen(text: Column) -> Column:
    return F.translate(text, ASCII, WIDE)


def fullwidth(text: Column) -> Column:
    """Full-width forms to ASCII, but in texts of East Asian scripts."""
    east = text.rlike(r"\p{IsHan}|\p{IsHiragana}|\p{IsKatakana}|\p{IsHangul}|\p{IsBopomofo}")
    return F.when(east, text).otherwise(F.translate(text, WIDE, ASCII))


def mark_letters(text: Column, key: Column | None = None) -> Column:
    """A mark on each letter, or a pile of three."""
    return F.regexp_replace(text, "([A-Za-z])", F.when(pick(key, 2) == 0, "$1\u0336").otherwise("$1\u0336\u0332\u0301"))


def combining_marks(text: Column) -> Column:
    return F.regexp_replace(text, MARKS, "")


def look_alike(text: Column) -> Column:
    return F.translate(text, "".join(GLYPHS), "".join(GLYPHS.values()))


def homoglyph(text: Column) -> Column:
    return F.translate(text, "".join(LOOKALIKES), "".join(LOOKALIKES.values()))


def accent(text: Column) -> Column:
    return F.translate(text, "".join(ACCENTED), "".join(ACCENTED.values()))


def accent_substitution(text: Column) -> Column:
    return F.translate(text, "".join(ACCENTED.values()), "".join(ACCENTED))


def leet(text: Column) -> Column:
    """Letters inside words to digits: every a e i o s t but the first letter of a word."""
    out = text
    for letter, digit in LEET.items():
        out = F.regexp_replace(out, rf"(?<=[A-Za-z0-9]){letter}", digit)
    return out


def unleet(text: Column) -> Column:
    """Digits to the letters they stand for: the original, if that has none of these digits."""
    return F.translate(text, "".join(LEET.values()), "".join(LEET))


def _by_word(text: Column, change) -> Column:
    parts = F.regexp_extract_all(text, F.lit(r"(?sU)\w+|\W+"), F.lit(0))
    return F.array_join(F.transform(parts, change), "")


def separate(text: Column, sign: str = "_") -> Column:
    """A sign between the letters of words of four letters and more."""
    return _by_word(text, lambda w: F.when(w.rlike("^[A-Za-z]{4,}$"), F.regexp_replace(w, "(?<=.)(?=.)", sign)).otherwise(w))


def joined(text: Column) -> Column:
    """Single letters joined by underscores, three and more, become a word."""
    return _by_word(text, lambda w: F.when(w.rlike("^[A-Za-z](?:_[A-Za-z]){2,}+$"), F.replace(w, F.lit("_"), F.lit(""))).otherwise(w))


def stretch(text: Column) -> Column:
    """The first vowel behind a consonant of each word of three letters and more, three times."""
    return F.regexp_replace(text, r"(?<![A-Za-z])([A-Za-z]*?[b-df-hj-np-tv-z])([aeiou])(?=[b-df-hj-np-tv-z])", "$1$2$2$2")


def space_out(text: Column) -> Column:
    """All characters apart, words by a wider gap."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.rtrim(F.regexp_replace(w, "(?s)(.)", "$1 "), F.lit(" "))), "   ")


def closed_up(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "   "), lambda w: F.replace(w, F.lit(" "), F.lit(""))), " ")


_ROWS = "qwertyuiop asdfghjkl zxcvbnm"
_NEXT_KEY = (_ROWS.replace(" ", ""), "".join(r[1:] + r[-2] for r in _ROWS.split()))


def slip(text: Column, key: Column, one_in: int = 5) -> Column:
    """A slip of the hand in one of so many words of five small letters and more: two letters swapped, one twice, one left out,
    or the next key instead of it. Never in the first or last letter; word, place and kind are chosen by the key."""

    def typed(word: Column, i: Column) -> Column:
        draw = F.xxhash64(key, i, word)
        at = (F.pmod(F.shiftright(draw, 8), F.length(word) - 2) + 2).cast("int")
        head, own, rest = F.substring(word, F.lit(1), at - 1), F.substring(word, at, F.lit(1)), F.substring(word, at + 1, F.length(word))
        kind = F.pmod(F.shiftright(draw, 32), F.lit(5))
        swapped = F.concat(head, F.substring(rest, F.lit(1), F.lit(1)), own, F.substring(rest, F.lit(2), F.length(word)))
        other = F.when(kind == 2, F.concat(head, own, own, rest)).when(kind == 3, F.concat(head, rest)).when(kind == 4, F.concat(head, F.translate(own, *_NEXT_KEY), rest))
        return F.when(word.rlike("^[a-z]{5,}$") & (F.pmod(draw, F.lit(one_in)) == 0), other.otherwise(swapped)).otherwise(word)

    return F.array_join(F.transform(F.split(text, " "), typed), " ")


def _listed(text: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(F.try_element_at(pairs, F.lower(w)), w)), " ")


def shorten(text: Column) -> Column:
    return _listed(text, {v: k for k, v in reversed(SHORTHAND.items())})


def misspell(text: Column) -> Column:
    return _listed(text, {v: k for k, v in reversed(MISSPELT.items()) if " " not in v and "'" not in v})


def emojify(text: Column) -> Column:
    return _listed(text, {v: k for k, v in reversed(EMOJI.items())})


# Notations


def entities(text: Column, key: Column | None = None) -> Column:
    """Every character as a hexadecimal or a decimal entity; or signs of markup by name and some letters by number."""
    points = F.regexp_extract_all(F.hex(F.encode(text, "UTF-32")), F.lit(".{8}"), F.lit(0))
    decimal = F.array_join(F.transform(points, lambda p: F.concat(F.lit("&#"), F.conv(p, 16, 10), F.lit(";"))), "")
    mixed = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for sign, new in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("e", "&#101;"), ("n", "&#110;"), ("T", "&#84;")):
        mixed = F.replace(mixed, F.lit(sign), F.lit(new))
    form = pick(key, 3, 2)
    return F.when(form == 0, decimal).when((form == 1) & (mixed != text), mixed).otherwise(
        F.regexp_replace(F.hex(F.encode(text, "UTF-32")), "00(.{6})", "&#x$1;")
    )


def _strict(parts: Column) -> Column:
    return F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ""))


#: Entities of markup itself; others that have names are the kernel's.
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0", "amp": "&"}


def html_entity(text: Column) -> Column:
    """Numeric entities (decimal and hexadecimal) and the basic named ones."""
    split = F.regexp_extract_all(text, F.lit(r"(?s)&#[xX][0-9a-fA-F]{1,6};|&#[0-9]{1,7};|&[a-z]{2,4};|[^&]+|&"), F.lit(0))

    def decode(p: Column) -> Column:
        digits = F.regexp_extract(p, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
        number = F.when(p.rlike("^&#[xX]"), F.conv(digits, 16, 16)).otherwise(F.conv(digits, 10, 16))
        point = F.decode(F.unhex(F.lpad(number, 8, "0")), "UTF-32")
        out = F.when(p.rlike("^&#"), point)
        for name, plain in NAMED.items():
            out = out.when(p == f"&{name};", plain)
        return out.otherwise(p)

    return F.array_join(F.transform(split, decode), "")


def percent(text: Column) -> Column:
    return F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "%$1")


def url_percent(text: Column) -> Column:
    """Percent escapes to UTF-8 text, + as it is; null if a run is not UTF-8."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(?:%[0-9A-Fa-f]{2})++|[^%]+|%"), F.lit(0))
    return _strict(F.transform(parts, lambda p: F.when(p.startswith("%") & (F.length(p) > 1), utf8(F.unhex(F.replace(p, F.lit("%"), F.lit(""))))).otherwise(p)))


def backslashes(text: Column, key: Column | None = None) -> Column:
    """Four-digit escapes of all characters; of ASCII texts, for every other key, two-digit ones."""
    short = F.regexp_replace(F.lower(F.hex(F.encode(text, "UTF-8"))), "(..)", r"\\x$1")
    long = F.regexp_replace(F.hex(F.encode(text, "UTF-16BE")), "(.{4})", r"\\u$1")
    return F.when(~text.rlike(r"[^\x00-\x7f]") & (pick(key, 2, 1) == 0), short).otherwise(long)


def backslash_escape(text: Column) -> Column:
    """Runs of three and more escapes of four digits, where a pair of surrogates is one character, or of two, which are UTF-8;
    fewer only where they are the whole text."""
    runs = [rf"(?:\\{mark}[0-9A-Fa-f]{{{n}}})" for mark, n in (("u", 4), ("x", 2))]
    parts = F.regexp_extract_all(text, F.lit(rf"(?s){'|'.join(rf'{r}{{3,}}+|\A{r}{{1,2}}\z' for r in runs)}|\\|[^\\]+"), F.lit(0))
    digits = lambda p, mark: F.unhex(F.replace(p, F.lit(mark), F.lit("")))

    def decode(p: Column) -> Column:
        return F.when(p.startswith("\\u"), F.decode(digits(p, "\\u"), "UTF-16BE")).when(p.startswith("\\x"), F.coalesce(utf8(digits(p, "\\x")), p)).otherwise(p)

    return F.array_join(F.transform(parts, decode), "")


# Bytes


def utf8(data: Column) -> Column:
    return F.try_validate_utf8(data.cast("string"))


def base64(text: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", "")


def base64url(text: Column, key: Column | None = None) -> Column:
    """The alphabet of addresses, padded for every other key."""
    padded = F.translate(base64(text), "+/", "-_")
    return F.when(pick(key, 2, 1) == 0, padded).otherwise(F.rtrim(padded, F.lit("=")))


def base64_text(token: Column) -> Column:
    """Strict base64 of either alphabet, padded or not, to UTF-8 text; else null."""
    body = F.rtrim(token, F.lit("="))
    mixed = body.rlike("[-_]") & body.rlike("[+/]")
    whole = body.rlike("^[A-Za-z0-9+/_-]{16,}$") & (F.length(body) % 4 != 1) & ~mixed
    padded = F.rpad(F.translate(body, "-_", "+/"), (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    return F.when(whole, utf8(F.try_to_binary(padded, F.lit("base64"))))


def hexes(text: Column, key: Column | None = None) -> Column:
    """Two digits a byte: in small letters, in capitals, apart, or apart with 0x."""
    digits = F.hex(F.encode(text, "UTF-8"))
    apart = lambda mark: F.rtrim(F.regexp_replace(F.lower(digits), "(..)", f"{mark}$1 "))
    return F.when(pick(key, 4) == 0, F.lower(digits)).when(pick(key, 4) == 1, digits).when(pick(key, 4) == 2, apart("")).otherwise(apart("0x"))


def hex_text(token: Column) -> Column:
    digits = F.regexp_replace(token, "0x|[ ,]", "")
    return F.when(digits.rlike("^[0-9a-fA-F]+$") & (F.length(digits) % 2 == 0), utf8(F.unhex(digits)))


_NIBBLES = [(f"{n:X}", chr(ord("g") + n), f"{n:04b}") for n in range(16)]


def bits(text: Column, key: Column | None = None) -> Column:
    """Eight bits a byte, bytes apart or, for every fourth key, joined. Digits go over letters, so that replaced ones are not met again."""
    out = F.translate(F.hex(F.encode(text, "UTF-8")), "".join(a for a, _, _ in _NIBBLES), "".join(b for _, b, _ in _NIBBLES))
    for _, letter, four in _NIBBLES:
        out = F.replace(out, F.lit(letter), F.lit(four))
    return F.when(pick(key, 4, 1) == 0, out).otherwise(F.rtrim(F.regexp_replace(out, "(.{8})", "$1 ")))


def binary(token: Column) -> Column:
    digits = F.replace(token, F.lit(" "), F.lit(""))
    out = F.regexp_replace(digits, "(.{4})", "$1,")
    for digit, letter, four in _NIBBLES:
        out = F.replace(out, F.lit(f"{four},"), F.lit(letter))
    out = F.translate(out, "".join(b for _, b, _ in _NIBBLES), "".join(a for a, _, _ in _NIBBLES))
    return F.when(digits.rlike("^[01]+$") & (F.length(digits) % 8 == 0), utf8(F.unhex(out)))


def decimals(text: Column, key: Column | None = None) -> Column:
    """A number a byte, parted by a space, a comma, or both."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    numbers = F.transform(pairs, lambda p: F.conv(p, 16, 10))
    between = lambda sign: F.array_join(numbers, sign)
    return F.when(pick(key, 3) == 0, between(" ")).when(pick(key, 3) == 1, between(", ")).otherwise(between(","))


def decimal_codes(token: Column) -> Column:
    numbers = F.regexp_extract_all(token, F.lit("[0-9]+"), F.lit(0))
    pairs = F.array_join(F.transform(numbers, lambda n: F.lpad(F.conv(n, 10, 16), 2, "0")), "")
    fits = ~F.exists(numbers, lambda n: n.cast("int") > 255) & (F.regexp_replace(token, r"[0-9]{1,3}(?: |, ?|$)", "") == "")
    return F.when(fits, utf8(F.unhex(pairs)))


# Letters moved


def shift(text: Column, by: int) -> Column:
    """Each letter `by` places on in the alphabet; a negative number moves back."""
    moved = LOWER[by % 26 :] + LOWER[: by % 26]
    return F.translate(text, LOWER + UPPER, moved + moved.upper())


def caesar(text: Column, key: Column) -> Column:
    """A shift of 1 to 25 other than 13, chosen by the key."""
    out = text
    for k, by in enumerate([*range(1, 13), *range(14, 26)]):
        out = F.when(pick(key, 24) == k, shift(text, by)).otherwise(out)
    return out


def uncaesar(text: Column, key: Column) -> Column:
    out = text
    for k, by in enumerate([*range(1, 13), *range(14, 26)]):
        out = F.when(pick(key, 24) == k, shift(text, -by)).otherwise(out)
    return out


#: trick -> (encoder, decoder) of (text, key), the round trips that hold for every clean text
CODECS = {
    "zero-width": (lambda t, k: hide_zero_width(t), lambda t, k: zero_width(t)),
    "tag-characters": (lambda t, k: hide_tags(t, "free prize inside"), lambda t, k: tag_characters(t)),
    "styled-alphabet": (styled, lambda t, k: styled_alphabet(t)),
    "fullwidth": (lambda t, k: widen(t), lambda t, k: fullwidth(t)),
    "html-entity": (lambda t, k: entities(t), lambda t, k: html_entity(t)),
    "url-percent": (lambda t, k: percent(t), lambda t, k: url_percent(t)),
    "backslash-escape": (lambda t, k: backslashes(t), lambda t, k: backslash_escape(t)),
    "base64": (lambda t, k: base64(t), lambda t, k: base64_text(t)),
    "base64url": (lambda t, k: base64url(t), lambda t, k: base64_text(t)),
    "hex": (lambda t, k: hexes(t), lambda t, k: hex_text(t)),
    "binary": (lambda t, k: bits(t), lambda t, k: binary(t)),
    "decimal-codes": (lambda t, k: decimals(t), lambda t, k: decimal_codes(t)),
    "rot13": (lambda t, k: shift(t, 13), lambda t, k: shift(t, 13)),
    "caesar": (caesar, uncaesar),
    "reverse": (lambda t, k: F.reverse(t), lambda t, k: F.reverse(t)),
    "combining-marks": (lambda t, k: mark_letters(t), lambda t, k: combining_marks(t)),
    "homoglyph": (lambda t, k: look_alike(t), lambda t, k: homoglyph(t)),
    "accent-substitution": (lambda t, k: accent(t), lambda t, k: accent_substitution(t)),
    "separator": (lambda t, k: separate(t), lambda t, k: joined(t)),
}
#: trick -> encoder of (text, key) in all of its forms, which the same decoder undoes
VARIED = {
    "html-entity": entities,
    "backslash-escape": backslashes,
    "base64url": base64url,
    "hex": hexes,
    "binary": bits,
    "decimal-codes": decimals,
    "combining-marks": mark_letters,
}
#: tricks that lose information; undone by evidence only
LOSSY = {"leetspeak": leet, "repeated-chars": stretch, "shorthand": shorten, "misspelling": misspell, "emoji-word": emojify}
#: Layered recipes, outermost first. Fixed values.
STACKS = (
    ("base64", "base64"),
    ("rot13", "base64"),
    ("hex", "base64"),
    ("base64", "hex"),
    ("reverse", "base64"),
    ("base64", "reverse"),
    ("url-percent", "html-entity"),
    ("base64", "leetspeak"),
    ("base64", "homoglyph"),
    ("rot13", "leetspeak"),
    ("zero-width", "base64"),
    ("zero-width", "homoglyph"),
    ("zero-width", "leetspeak"),
    ("styled-alphabet", "leetspeak"),
    ("homoglyph", "leetspeak"),
    ("homoglyph", "accent-substitution"),
)
#: Encoder and decoder of each trick in a recipe; digits come back to letters where the text had none of them.
LAYERS = CODECS | {"leetspeak": (lambda t, k: leet(t), lambda t, k: unleet(t))}


def stack(text: Column, key: Column, tricks: tuple[str, ...]) -> Column:
    for t in reversed(tricks):
        text = LAYERS[t][0](text, key)
    return text


def unstack(text: Column, key: Column, tricks: tuple[str, ...]) -> Column:
    for t in tricks:
        text = LAYERS[t][1](text, key)
    return text


def partial(text: Column, trick: str, key: Column, words: int = 3) -> Column:
    """A run of words disguised inside the text, placed by the key."""
    parts = F.split(text, " ")
    start = F.pmod(F.xxhash64(key), F.greatest(F.size(parts) - words + 1, F.lit(1))).cast("int")
    encode = CODECS[trick][0] if trick in CODECS else (lambda t, k: LOSSY[trick](t))
    middle = encode(F.array_join(F.slice(parts, start + 1, F.least(F.size(parts), F.lit(words))), " "), key)
    rest = F.slice(parts, start + words + 1, F.greatest(F.size(parts) - start - words, F.lit(0)))
    return F.concat_ws(" ", F.nullif(F.array_join(F.slice(parts, 1, start), " "), F.lit("")), middle, F.nullif(F.array_join(rest, " "), F.lit("")))
