"""Work that the kernel leaves out gives the same results: nothing is asked twice, and what is looked for first is only a sign."""

import random
import re
from collections import Counter

import pytest

from clearspark.kernel import decode
from clearspark.kernel.engine import RULES, Rule, Unmasker
from clearspark.kernel.lexicon import WORD, Resources, sequences, spelt
from clearspark.operators import scoring
from clearspark.session import table

WORDS = frozenset("the parcel was left behind an old house no one could see from road then a fade bead decade".split())
TEXT = "The parcel was left behind an old house; no one could see the house from the road."


@pytest.fixture(scope="module")
def known():
    return Resources(WORDS, dict(Counter(map(spelt, sequences(TEXT).tolist()))))


def odd_texts():
    pick = random.Random(5)
    parts = ["a", "Fa", "0x41", "de", "41", "=", "==", "+", "_", " ", ", ", "\n", "é", "%41", "%25", "Kelvin", "house", "01101000", "abcdef012345", "QUJDREVGR0hJSktMTU5P", "it's"]
    return ["".join(pick.choices(parts, k=pick.randrange(1, 40))) for _ in range(3000)]


def counted(asked):
    def one(rule):
        def find(text, resources):
            asked[rule.name, rule.level, text] += 1
            return rule.find(text, resources)

        return Rule(rule.name, find, rule.level, rule.phase, rule.group, rule.everywhere, rule.min_letters)

    return tuple(map(one, RULES))


def test_no_text_is_searched_twice_by_a_rule(known):
    asked, text = Counter(), TEXT.encode().hex()
    assert Unmasker(known, rules=counted(asked))(text, raise_errors=True) == Unmasker(known)(text)
    assert max(asked.values()) == 1


def test_a_clean_sentence_is_searched_once_for_all_its_samples(known):
    asked = Counter()
    undo = Unmasker(known, "balanced", counted(asked))
    for text in (TEXT, TEXT.encode().hex(), TEXT):
        assert undo(text, raise_errors=True)[0] == TEXT
    found = [n for (name, _, text), n in asked.items() if text == TEXT]
    assert found and max(found) == 1


def test_signs_hide_no_match():
    for text in odd_texts():
        for pattern in (decode._BASE64, decode._ROTATED):
            assert [m.span() for m in decode.tokens_of(text, pattern)] == [m.span() for m in pattern.finditer(text)]
        assert [m.span() for m in decode.tokens_of(text, decode._REVERSED, True)] == [m.span() for m in decode._REVERSED.finditer(text)]
        sign = decode.signs(text)
        for pattern, there in ((r"(?:0x)?[0-9a-fA-F]{2}(?:[ ,]+(?:0x)?[0-9a-fA-F]{2}){3,}", sign.apart), (r"(?:[0-9a-fA-F]{2}){6,}", sign.joined), (r"[01]{8}(?: ?[01]{8}){3,}", sign.bits), (r"[0-9]{1,3}(?:(?: |, ?)[0-9]{1,3}){3,}", sign.decimal)):
            assert there or not re.search(rf"(?<![0-9A-Za-z]){pattern}(?![0-9A-Za-z])", text)


def test_escapes_are_undone_as_the_library_does():
    for text in odd_texts():
        for chunk in text.split():
            try:
                expected = decode.unquote(chunk, errors="strict")
            except UnicodeDecodeError:
                with pytest.raises(UnicodeDecodeError):
                    decode._unquoted(chunk)
                continue
            assert decode._unquoted(chunk) == expected


def test_totals_are_those_of_the_words(known):
    for text in [*odd_texts(), "fadebead9" * 900, "the1house2 " * 500, "qxz9" * 3000]:
        words = [w for w in WORD.findall(text) if len(w) > 1]
        n = lambda w: len(w) - w.count("'") - w.count("’")
        good, all_ = sum(n(w) for w in words if known._known(w)), sum(map(n, words))
        assert known.coverage(text) == (good, all_)
        assert known.letters(text) == sum(map(len, words))
        assert all(known.covers(text, share) == (all_ > 0 and good / all_ >= share) for share in (0.5, 0.6, 1.0))


def test_fit_is_the_mean_over_sequences(known):
    for text in (TEXT * 3, "x" * 200, "9" * 200, TEXT.upper() + "é" * 90):
        body = f" {' '.join(re.sub('[^a-z]+', ' ', text.lower()).split())} "
        logs = [known.logs.get(body[i : i + 4], known.unseen) for i in range(len(body) - 3)] if len(body) > 3 else []
        assert known.fit(text) == (pytest.approx(sum(logs) / len(logs)) if logs else None)


def test_one_pass_learns_what_the_tables_hold(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    one, two = scoring.learn(docs, 2), scoring.resources(scoring.build_lexicon(docs, 2), scoring.build_grams(docs))
    assert (one.words, one.grams, one.total) == (two.words, two.grams, two.total)
