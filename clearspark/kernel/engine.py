"""The fixed point: rules propose edits, edits are judged by what they finally become, and the best are applied.

A round runs the phases in order: certain rules, judged rules, and last, on the whole text only, rules
for informal writing. The first phase with an accepted edit ends the round. A judged phase applies its
best edit; a certain phase applies all of the winning rule's edits, and of its group's, that do not overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import accumulate, pairwise

from clearspark.kernel import decode, spelling
from clearspark.kernel.lexicon import SIGNS, Resources

LEVELS = ("conservative", "balanced", "aggressive")
#: Longest text, layers, rounds; and for judged edits the least score, gain and letters.
MOST_CHARS, MOST_LAYERS, MOST_ROUNDS = 100_000, 4, 200
#: Strings that no rule proposes an edit of are remembered from text to text, words and sentences: their longest, and how
#: many before they are forgotten.
MOST_INERT_CHARS, MOST_INERT = 300, 100_000
POLICIES = {"conservative": (0.50, 0.30, 8), "balanced": (0.50, 0.30, 8), "aggressive": (0.45, 0.25, 6)}

CERTAIN, JUDGED, LATE = range(3)
Finder = Callable[[str, Resources], list[decode.Edit]]


@dataclass(frozen=True)
class Rule:
    """One entry of the registry; users may run a list of their own."""

    name: str
    find: Finder
    level: str = "conservative"
    phase: int = CERTAIN
    group: str = ""
    everywhere: bool = False  # also inside protected spans
    min_letters: int = 0


RULES: tuple[Rule, ...] = (
    Rule("zero-width", decode.zero_width),
    Rule("tag-characters", decode.tag_characters, everywhere=True),
    Rule("styled-alphabet", decode.styled_alphabet),
    Rule("fullwidth", decode.fullwidth),
    Rule("html-entity", decode.html_entity),
    Rule("url-percent", decode.url_percent),
    Rule("backslash-escape", decode.backslash_escape),
    Rule("combining-marks", spelling.combining_marks, "balanced"),
    Rule("leetspeak", spelling.leetspeak, "balanced"),
    Rule("separator", spelling.separator, "balanced"),
    Rule("repeated-chars", spelling.repeated_chars, "aggressive"),
    Rule("shorthand", spelling.shorthand, "aggressive", LATE),
    Rule("misspelling", spelling.misspelling, "aggressive", LATE),
    Rule("emoji-word", spelling.emoji_word, "aggressive", LATE),
    Rule("homoglyph", spelling.look_alike("homoglyph"), "balanced", group="look-alike"),
    Rule("accent-substitution", spelling.look_alike("accent-substitution"), "balanced", group="look-alike"),
    Rule("homoglyph", spelling.look_alike("homoglyph", True), "aggressive", group="look-alike"),
    Rule("accent-substitution", spelling.look_alike("accent-substitution", True), "aggressive", group="look-alike"),
    Rule("base64", decode.base64_text, phase=JUDGED),
    Rule("hex", decode.hex_text, phase=JUDGED, everywhere=True),
    Rule("binary", decode.binary, phase=JUDGED),
    Rule("decimal-codes", decode.decimal_codes, phase=JUDGED),
    Rule("rot13", decode.caesar((13,), tokens=True), phase=JUDGED, min_letters=10),
    Rule("caesar", decode.caesar((*range(1, 13), *range(14, 26))), phase=JUDGED, min_letters=10),
    Rule("reverse", decode.reverse, phase=JUDGED, min_letters=10),
)

#: Spans that stay as they are, by kind. The patterns of the native functions are the same.
PROTECTED = {
    "url": r"(?i)\b(?:https?|ftp)://[^\s<>\"']+",
    "www": r"(?i)\bwww\.[^\s<>\"']+",
    "email": r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b",
    "windows_path": r"(?<![\w])(?:[A-Za-z]:\\|\\\\)[^\s\"<>|]+",
    "posix_path": r"(?<![\w])(?:~|\.{1,2})?/(?:[\w.+-]+/)+[\w.+-]*",
    "uuid": r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
    "hash": r"(?i)(?<![0-9A-Za-z])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})(?![0-9A-Za-z])",
    "colour": r"(?i)(?<![\w&])#(?:[0-9a-f]{3}|[0-9a-f]{6}|[0-9a-f]{8})\b",
}
_PROTECTED = [(k, re.compile(p)) for k, p in PROTECTED.items()]
#: What a text must hold for a kind to be looked for.
_ABLE = {
    "url": lambda text: "://" in text,
    "www": re.compile("(?i)www[.]").search,
    "email": lambda text: "@" in text,
    "windows_path": lambda text: "\\" in text,
    "posix_path": lambda text: "/" in text and re.search(r"/[\w.+-]+/", text),
    "uuid": lambda text: "-" in text and re.search("(?i)-[0-9a-f]{4}-[0-9a-f]{4}-", text),
    "hash": lambda text: len(text) >= 32 and decode.signs(text).hash,
    "colour": lambda text: "#" in text,
}


def protected(text: str) -> list[tuple[int, int]]:
    able = [p for k, p in _PROTECTED if _ABLE[k](text)]
    return sorted([m.span() for p in able for m in p.finditer(text)]) if able else []


class Spans:
    """Sorted spans, asked whether one of them overlaps another span."""

    def __init__(self, spans: list[tuple[int, int]] = ()):
        self.starts = [start for start, _ in spans]
        self.reach = list(accumulate((end for _, end in spans), max))  # the furthest end so far

    def touch(self, a: int, b: int) -> bool:
        before = bisect_left(self.starts, b)
        return before > 0 and self.reach[before - 1] > a

    def add(self, a: int, b: int) -> None:
        """A span that touches none: ends then lie in the order of starts."""
        at = bisect_left(self.starts, b)
        self.starts.insert(at, a)
        self.reach.insert(at, b)


@dataclass
class Verdict:
    final: str
    inner: list[tuple]
    confidence: float
    weight: float


@dataclass
class Unmasker:
    """Runs the rules of a level over texts. What was decided on two strings is remembered within one text, and so is
    which strings are calm: the rules of the first two phases leave them, and would again, as all is decided."""

    resources: Resources
    level: str = "conservative"
    rules: tuple[Rule, ...] = RULES
    decided: dict = field(default_factory=dict)
    calm: set = field(default_factory=set)
    found: dict = field(default_factory=dict)
    kept: dict = field(default_factory=dict)
    inert: set = field(default_factory=set)  # no rule of these phases proposes an edit: holds for all texts

    def __post_init__(self):
        if self.level not in LEVELS:
            raise ValueError(f"unknown level {self.level!r}; one of {', '.join(LEVELS)}")
        rank = LEVELS.index(self.level)
        self.active = [r for r in self.rules if LEVELS.index(r.level) <= rank]
        self.policy = POLICIES[self.level]
        self.phases = {phase: [r for r in self.active if r.phase == phase] for phase in (CERTAIN, JUDGED, LATE)}
        self.longest_usual = 16 if self.rules is RULES else 0
        self.plain_below = 0 if self.level == "aggressive" else 10  # no judged edit of fewer characters is accepted

    def __call__(self, text: str, raise_errors: bool = False) -> tuple[str, list[tuple]]:
        """The text undone, and the steps: (transform, start, end, before, after, confidence, hidden)."""
        self.decided.clear()
        self.calm.clear()
        self.found.clear()
        self.kept.clear()
        try:
            return self.settle(text, 0)
        except Exception:
            if raise_errors:
                raise
            return text, []

    def settle(self, text: str, layer: int) -> tuple[str, list[tuple]]:
        steps: list[tuple] = []
        if layer and len(text) < self.longest_usual and self.usual(text):
            return text, steps
        for _ in range(MOST_ROUNDS if len(text) <= MOST_CHARS else 0):
            chosen = self.round(text, layer)
            if not chosen:
                break
            done, at, out = 0, 0, []  # done: characters read; at: characters written
            for rule, v, (start, end, new, hidden) in chosen:
                out.append(text[done:start])
                at += start - done
                steps.append((rule.name, at, at + end - start, text[start:end], new, round(v.confidence, 3), hidden))
                steps += [(n, a + at, b + at, *rest) for n, a, b, *rest in v.inner]
                out.append(v.final)
                at += len(v.final)
                done = end
            text = "".join([*out, text[done:]])
        return text, steps

    def usual(self, text: str) -> bool:
        """Letters, with a sign beside them or not, that no rule but late ones has an accepted edit of."""
        if len(text) < self.plain_below and (bare := text.strip(SIGNS)).isalpha():
            return bare.isascii() or (self.level == LEVELS[0] and max(bare) < "\u0250")
        return self.resources.usual(text)

    def round(self, text: str, layer: int) -> list[tuple[Rule, Verdict, decode.Edit]]:
        calm = text in self.calm or text in self.inert
        late = not layer and bool(self.phases[LATE])
        if calm and not late:
            return []
        proposed = False
        for phase in (() if calm else (CERTAIN, JUDGED)) + ((LATE,) if late else ()):
            edits = self.edits(text, phase)
            proposed = proposed or bool(edits)
            accepted = [(rule, v, edit) for rule, edit in edits if (v := self.verdict(rule, text[edit[0] : edit[1]], edit[2], layer)) is not None]
            if not accepted:
                if phase == JUDGED:
                    self.calm.add(text)
                    if not proposed and len(text) <= MOST_INERT_CHARS:
                        if len(self.inert) >= MOST_INERT:
                            self.inert.clear()
                        self.inert.add(text)
                continue
            winner, best, edit = max(accepted, key=lambda x: x[1].weight)  # the first of equals
            if phase == JUDGED:
                return [(winner, best, edit)]
            own = [x for x in accepted if x[0] is winner or (winner.group and x[0].group == winner.group)]
            own.sort(key=lambda x: x[2][0])
            if all(a[2][1] <= b[2][0] for a, b in pairwise(own)):
                return own
            chosen: list[tuple[Rule, Verdict, decode.Edit]] = []
            taken = Spans()
            for x in sorted(own, key=lambda x: (-x[1].weight, x[2][0])):
                if not taken.touch(*x[2][:2]):
                    taken.add(*x[2][:2])
                    chosen.append(x)
            return sorted(chosen, key=lambda x: x[2][0])
        return []

    def edits(self, text: str, phase: int) -> list[tuple[Rule, decode.Edit]]:
        """What the rules of a phase propose outside of protected spans: the same in every layer of a text."""
        found = self.found.get((text, phase))
        if found is None:
            kept = self.kept.get(text)
            if kept is None:
                kept = self.kept[text] = Spans(protected(text))
            found = self.found[text, phase] = [
                (rule, edit)
                for rule in self.phases[phase]
                for edit in rule.find(text, self.resources)
                if edit[2] != text[edit[0] : edit[1]] and (rule.everywhere or not kept.starts or not kept.touch(*edit[:2]))
            ]
        return found

    def verdict(self, rule: Rule, before: str, new: str, layer: int) -> Verdict | None:
        key = (rule.name, before, new)  # whatever the layer
        found = self.decided.get(key, self)
        if found is self:
            found = self.judge(rule, before, new, layer)
            if found is not None and self.decided.get(key, found) is None:
                self.calm.clear()  # an inner layer had refused the same edit meanwhile
            self.decided[key] = found
        return found

    def judge(self, rule: Rule, before: str, new: str, layer: int) -> Verdict | None:
        least, gain_needed, count_needed = self.policy
        if rule.phase == JUDGED and self.rules is RULES and len(new) < max(count_needed, rule.min_letters):
            return None  # no rule inside makes a text longer
        final, inner = self.settle(new, layer + 1) if layer < MOST_LAYERS else (new, [])
        if rule.phase != JUDGED:
            return Verdict(final, inner, 1.0, float(len(before)))
        score = self.resources.score(final, least)
        if score < least or (n := self.resources.letters(final)) < max(count_needed, rule.min_letters):
            return None
        gain = score - self.resources.score(before)
        return Verdict(final, inner, score, gain * n) if gain >= gain_needed else None
