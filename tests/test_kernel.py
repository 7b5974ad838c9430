"""Rules and the fixed point on sentences of our own, with a small list of words."""

import base64
import codecs as stdlib
import random
import unicodedata

import pytest

from clearspark.kernel import decode, engine, lexicon, spelling
from clearspark.kernel.engine import Rule, Unmasker, protected
from clearspark.kernel.lexicon import Resources, letters

SENTENCES = (
    "Please send the parcel to the old house before the end of this week",
    "The garden behind the school was full of yellow flowers in summer",
    "Nobody could remember where the captain had left his silver watch",
)
EXTRA = "free money click here your account has been closed hello world password later great you see are for not don't april Peter Mary friend really the and was is on it this go to be at now meet me station phone love birthday happy key fits"
WORDS = frozenset({w for s in (*SENTENCES, EXTRA) for w in (*s.split(), *s.lower().split())})


@pytest.fixture(scope="module")
def known():
    grams = {}
    for s in (*SENTENCES, EXTRA):
        body = f" {' '.join(s.lower().replace(chr(39), ' ').split())} "
        for i in range(len(body) - 3):
            grams[body[i : i + 4]] = grams.get(body[i : i + 4], 0) + 1
    return Resources(WORDS, grams)


def undo(known, text, level="conservative"):
    return Unmasker(known, level)(text, raise_errors=True)


ENCODERS = {
    "base64": lambda s: base64.b64encode(s.encode()).decode(),
    "hex": lambda s: s.encode().hex(),
    "binary": lambda s: " ".join(f"{b:08b}" for b in s.encode()),
    "decimal-codes": lambda s: " ".join(str(b) for b in s.encode()),
    "rot13": lambda s: stdlib.encode(s, "rot13"),
    "reverse": lambda s: s[::-1],
    "url-percent": lambda s: "".join(f"%{b:02X}" for b in s.encode()),
    "html-entity": lambda s: "".join(f"&#{ord(c)};" for c in s),
    "backslash-escape": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    "fullwidth": lambda s: "".join(chr(ord(c) + 0xFEE0) if c != " " else c for c in s),
    "styled-alphabet": lambda s: "".join(unicodedata.lookup(f"MATHEMATICAL BOLD {'CAPITAL' if c.isupper() else 'SMALL'} {c.upper()}") if c.isalpha() else c for c in s),
    "zero-width": lambda s: s.replace("e", "e\u200b"),
    "caesar": lambda s: s.translate(lexicon.back(7)),
}


@pytest.mark.parametrize("trick", ENCODERS)
@pytest.mark.parametrize("sentence", SENTENCES)
def test_one_layer_is_undone(known, trick, sentence):
    text, steps = undo(known, ENCODERS[trick](sentence))
    assert text == sentence
    assert steps[0][0] == trick


@pytest.mark.parametrize("outer,inner", [("base64", "base64"), ("rot13", "base64"), ("hex", "base64"), ("reverse", "base64"), ("url-percent", "html-entity"), ("zero-width", "reverse")])
def test_two_layers_and_again(known, outer, inner):
    text, steps = undo(known, ENCODERS[outer](ENCODERS[inner](SENTENCES[0])))
    assert text == SENTENCES[0]
    assert undo(known, text) == (text, [])


@pytest.mark.parametrize("sentence", SENTENCES)
@pytest.mark.parametrize("level", ["conservative", "balanced", "aggressive"])
def test_clean_text_stays(known, sentence, level):
    assert undo(known, sentence, level) == (sentence, [])


@pytest.mark.parametrize("text", ["see https://a.example/x%20y%20z", "d41d8cd98f00b204e9800998ecf8427e", "C:\\x41\\x42\\x43", "call 555 0100 at 7", "<p>&amp;&lt;</p>", "中文 ＡＢＣ 中文", "100 200", ""])
def test_formats_and_other_writing_stay(known, text):
    assert undo(known, text, "aggressive") == (text, [])


def test_part_of_a_text_and_offsets(known):
    hidden = ENCODERS["base64"]("click here now")
    text, steps = undo(known, f"Please {hidden} before the week")
    assert text == "Please click here now before the week"
    name, start, end, before, after, confidence, _ = steps[0]
    assert (name, start, before, after) == ("base64", 7, hidden, "click here now") and end == 7 + len(hidden) and 0 < confidence <= 1


def test_tag_characters_report_what_they_hid(known):
    text, steps = undo(known, SENTENCES[0] + "".join(chr(0xE0000 + ord(c)) for c in "hidden"))
    assert text == SENTENCES[0] and steps[0][6] == "hidden"
    flag = "\U0001f3f4\U000e0067\U000e0062\U000e007f"
    assert undo(known, flag) == (flag, [])


@pytest.mark.parametrize("text,plain,level", [
    ("fr33 m0ney h3re", "free money here", "balanced"),
    ("f.r.e.e m-o-n-e-y", "free money", "balanced"),
    ("c_l_i_c_k here", "click here", "balanced"),
    ("f r e e m o n e y", "free money", "balanced"),
    ("сlick hеrе now", "click here now", "balanced"),
    ("yǒǔr accǒǔnt has been closed", "your account has been closed", "balanced"),
    ("f̶r̶e̶e̶ money", "free money", "balanced"),
    ("heeello wooorld", "hello world", "aggressive"),
    ("c u l8r", "see you later", "aggressive"),
    ("the freind was realy here", "the friend was really here", "aggressive"),
    ("happy 🎂", "happy birthday", "aggressive"),
    ("the 🔑 fits", "the key fits", "aggressive"),
])
def test_word_rules(known, text, plain, level):
    assert undo(known, text, level)[0] == plain


@pytest.mark.parametrize("text,level", [("sooo", "aggressive"), ("café", "balanced"), ("test5 h1", "balanced"), ("U.S.A", "balanced"), ("J. R. R.", "balanced"), ("$50 3rd 10km", "balanced"), ("pizza 🍕", "aggressive"), ("U Thant", "aggressive"), ("привет друг", "balanced")])
def test_word_rules_leave_alone(known, text, level):
    assert undo(known, text, level)[0] == text


def test_levels_and_errors(known):
    with pytest.raises(ValueError):
        Unmasker(known, "none")
    broken = Rule("broken", lambda text, _: 1 / 0)
    assert Unmasker(known, rules=(broken,))("text") == ("text", [])
    with pytest.raises(ZeroDivisionError):
        Unmasker(known, rules=(broken,))("text", raise_errors=True)
    upper = Rule("upper", lambda text, _: [(0, 4, "TEXT", None)] if text.startswith("text") else [])
    assert Unmasker(known, rules=(upper,))("text")[0] == "TEXT"
    long = "a" * 100_001
    assert Unmasker(known)(long) == (long, [])


def test_scores(known):
    assert known.coverage("free money xqzv") == (9, 13)
    assert known.score(SENTENCES[0]) > 0.9 > 0.6 > known.score("xqzv wkjj pplq")
    assert known.fit("") is None and known.score("") == 0.0
    assert letters("a don't I b") == 5
    assert known.known("Free") and known.known("house's") and not known.known("b")


def test_protected_spans():
    text = "a https://x.example?y b me@site.example c ~/dir/file d #ff00aa e 123e4567-e89b-12d3-a456-426614174000"
    assert [text[a:b] for a, b in protected(text)] == ["https://x.example?y", "me@site.example", "~/dir/file", "#ff00aa", "123e4567-e89b-12d3-a456-426614174000"]


def test_fewest_words(known):
    assert spelling.fewest_words("freemoney", known) == ["free", "money"]
    assert spelling.fewest_words("zzzz", known) is None


# work that is not done twice


def test_a_text_left_as_it_is_is_searched_once(known):
    plain = SENTENCES[0]
    searched = []
    watch = Rule("watch", lambda text, _: searched.append(text) or [])
    run = Unmasker(known, "conservative", (watch, *(r for r in engine.RULES if r.name == "base64")))
    assert run(base64.b64encode(plain.encode()).decode())[0] == plain
    assert searched.count(plain) == 1
    assert run("once") == run("once") == ("once", [])
    assert searched.count("once") == 1


def test_spans_overlap_as_pairs_do():
    rng = random.Random(7)
    for _ in range(300):
        spans = sorted((a, a + rng.randint(0, 6)) for a in rng.choices(range(40), k=rng.randint(0, 6)))
        kept, apart, alone = engine.Spans(spans), engine.Spans(), []
        for a, b in ((a, a + rng.randint(0, 6)) for a in rng.choices(range(40), k=9)):
            assert kept.touch(a, b) == any(a < end and start < b for start, end in spans)
            met = any(a < end and start < b for start, end in alone)
            assert apart.touch(a, b) == met
            if not met and a < b:
                alone.append((a, b))
                apart.add(a, b)
