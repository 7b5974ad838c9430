"""Native functions and relational operators on small tables."""

import pytest
from pyspark.sql import functions as F

from clearspark import sources
from clearspark.functions import codecs, text
from clearspark.operators import corpus, evaluate, evidence, scoring, spans
from clearspark.operators.unmask import unmask
from clearspark.kernel.lexicon import Resources

TEXTS = ["Hello World", "", None, "naïve café 😀 end", "x" * 40, "line one\nline two & <three> + 100%", "tab\tand \\ slash"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").cache()


@pytest.mark.parametrize("trick", codecs.CODECS)
def test_codecs_round_trip(docs, trick):
    encode, decode = codecs.CODECS[trick]
    rows = docs.select("text", decode(encode(F.col("text"), F.col("doc_id")), F.col("doc_id")).alias("back")).collect()
    for r in rows:
        if trick.startswith("base64") and r.text is not None and len(r.text.encode()) < 12:
            continue  # shorter tokens are not taken for base64
        if r.text or trick not in ("hex", "binary", "decimal-codes"):
            assert r.back == r.text


@pytest.mark.parametrize("token,plain", [("SGVsbG8gV29ybGQh", "Hello World!"), ("SGVsbG8!V29ybGQh", None), ("AAAA-_+/AAAABBBB", None), ("////////////////", None)])
def test_strict_base64(spark, token, plain):
    assert spark.range(1).select(codecs.base64_text(F.lit(token)).alias("x")).first().x == plain


def test_strict_percent_and_hex(spark):
    r = spark.range(1).select(codecs.url_percent(F.lit("a%FF")).alias("a"), codecs.url_percent(F.lit("1+1%3D2 %")).alias("b"), codecs.hex_text(F.lit("4142 4")).alias("c"), codecs.decimal_codes(F.lit("72 300")).alias("d")).first()
    assert tuple(r) == (None, "1+1=2 %", None, None)


def test_zero_width_stays_where_needed(spark):
    family = "👩\u200d👧"
    r = spark.range(1).select(codecs.zero_width(F.lit(family)).alias("a"), codecs.zero_width(F.lit("a\u200b\u200bb")).alias("b")).first()
    assert tuple(r) == (family, "ab")


def test_partial_keeps_the_rest(spark):
    d = spark.createDataFrame([(1, "one two three four five six")], "doc_id bigint, text string")
    got = d.select(codecs.partial(F.col("text"), "hex", F.col("doc_id")).alias("x")).first().x
    assert len(got.split(" ")) == 4


def test_text_functions(docs):
    rows = docs.select(text.letter_count(F.col("text")).alias("n"), text.readable(F.col("text")).alias("ok"), text.length_class(F.col("text")).alias("c")).collect()
    assert (rows[0].n, rows[0].ok, rows[0].c) == (10, True, "under 20")
    assert rows[2].n is None


def test_scoring(spark):
    d = spark.createDataFrame([(1, "the Cat's hat"), (2, "zzz a"), (3, "")], "doc_id bigint, text string")
    lex = spark.createDataFrame([("the",), ("cat",), ("Hat",)], "word string")
    got = {r.doc_id: (r.covered, r.total) for r in scoring.coverage(d, lex).collect()}
    assert got == {1: (10, 10), 2: (0, 3)}
    grams = scoring.build_grams(d, 1)
    scores = {r.doc_id: r.score for r in scoring.english_score(d, lex, grams, gibberish=-3, english=-1).collect()}
    assert scores[1] > scores[2] >= 0 and scores[3] == 0


def test_spans(spark):
    d = spark.createDataFrame([(1, "😀 a1 bb22 c")], "doc_id bigint, text string")
    found = spans.find_spans(d, "[0-9]+").orderBy("start").collect()
    assert [(r.start, r.end, r.value) for r in found] == [(3, 4, "1"), (7, 9, "22")]
    a = spark.createDataFrame([(1, 0, 5), (1, 10, 12), (2, 0, 5)], "doc_id bigint, start int, end int")
    b = spark.createDataFrame([(1, 4, 6)], "doc_id bigint, start int, end int")
    assert sorted((r.doc_id, r.start) for r in spans.without_overlap(a, b).collect()) == [(1, 10), (2, 0)]
    w = spark.range(1).select(spans.greedy(F.expr("array(named_struct('weight', 5.0, 'start', 0, 'end', 4), named_struct('weight', 9.0, 'start', 3, 'end', 8), named_struct('weight', 1.0, 'start', 8, 'end', 9))")).alias("x")).first().x
    assert [(x.start, x.end) for x in w] == [(3, 8), (8, 9)]


def test_evidence(spark):
    lex = spark.createDataFrame([(w,) for w in "free money here cash click hello friend".split()], "word string")
    d = spark.createDataFrame([(1, "fr3e m0ney here5"), (2, "here5 only"), (3, "c_l_i_c_k X_Y_Z"), (4, "heeello"), (5, "sooo")], "doc_id bigint, text string")
    leet = {(r.doc_id, r.token): r.accepted for r in evidence.leet(d, lex).collect()}
    assert leet[(1, "fr3e")] and leet[(1, "m0ney")] and (2, "here5") not in leet
    assert [r.plain for r in evidence.separators(d, lex).where("accepted").collect()] == ["click"]
    assert {(r.doc_id, r.plain) for r in evidence.stretched(d, lex).where("accepted").collect()} == {(4, "hello")}
    words = spark.createDataFrame([("freind",), ("friend",), ("abcdef",)], "word string")
    assert [(r.word, r.plain) for r in evidence.slips(words, lex).collect()] == [("freind", "friend")]


def test_unmask_null_and_distinct(spark):
    d = spark.createDataFrame([(1, "ｆｒｅｅ ｍｏｎｅｙ"), (2, None), (3, "ｆｒｅｅ ｍｏｎｅｙ")], "doc_id bigint, text string")
    res = Resources(frozenset({"free", "money"}))
    for distinct in (False, True):
        got = {r.doc_id: r.result and r.result.text for r in unmask(d, res, distinct=distinct).collect()}
        assert got == {1: "free money", 2: None, 3: "free money"}
    shown = unmask(d, res).where("doc_id = 1").select(sources.as_json().alias("j")).first().j
    assert '"transform":"fullwidth"' in shown


def test_evaluation(spark):
    rows = spark.createDataFrame(
        [("aGk=", "hi", ["base64"], "hi", ["base64"], "hi", "whole", "base64", "books", None, None), ("Hi", "Hi", [], "hi!", ["leetspeak"], "hi!", "clean", "prose", "books", None, None), ("ih", "hi", ["reverse"], "ih", [], "ih", "whole", "reverse", "sms", None, None)],
        "text string, expected string, tricks array<string>, output string, transforms array<string>, second_pass string, mode string, category string, origin string, caseless boolean, expected_rewritten string",
    )
    facts = evaluate.facts(rows)
    assert {r.category: (r.false_change, r.recovered, r.error_after) for r in facts.collect()} == {"base64": (None, True, 0.0), "prose": (True, None, None), "reverse": (None, False, 1.0)}
    total = [r for r in evaluate.tallies(facts, "recovered", (), ("mode",)).collect() if r.mode is None]
    assert (total[0].total, total[0].hits) == (2, 1)
    pr = {r.name: (r.precision, r.recall) for r in evaluate.precision_recall(facts.select(F.col("tricks").alias("gold"), F.col("transforms").alias("found"))).collect()}
    assert pr == {"base64": (1.0, 1.0), "leetspeak": (0.0, None), "reverse": (None, 0.0)}


def test_sources(spark, tmp_path):
    (tmp_path / "g.txt").write_text("total 10\nabcd\t4\nbcde\t2\n")
    assert sorted(tuple(r) for r in sources.gram_table(spark, str(tmp_path / "g.txt")).collect()) == [("abcd", 4, 10), ("bcde", 2, 10)]
    (tmp_path / "s.txt").write_text("0041 005A Latin\n0370 03FF Greek\n")
    assert [tuple(r) for r in sources.script_ranges(spark, str(tmp_path / "s.txt")).orderBy("lo").collect()] == [(65, 90, "Latin"), (880, 1023, "Greek")]
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "x", "expected": null, "tricks": ["hex"]}\n')
    assert sources.samples(spark, str(tmp_path / "a.jsonl")).first().tricks == ["hex"]
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(["1: clean one", "> d1rty one", "2: same", "> same", "", "3: three", "> 1: other"])], "file string, ix int, value string")
    assert sorted((r.n, r.text) for r in sources.answer_pairs(lines).collect()) == [(1, "d1rty one"), (1, "other")]
    books = spark.createDataFrame([("head\n*** START OF BOOK ***\n\nFirst\nline.\n\nSecond.\n*** END OF BOOK ***",)], "text string")
    assert [r.paragraph for r in sources.book_paragraphs(books).collect()] == ["First line.", "Second."]
    js = spark.createDataFrame([('{"query": {"pages": {"1": {"title": "T", "extract": "E"}, "2": {"title": "T", "extract": "E"}}}}',)], "json string")
    assert [tuple(r) for r in sources.wiki_pages(js).collect()] == [("T", "E")]
    posts = spark.createDataFrame([('{"items": [{"link": "l", "body": "b", "content_license": "CC BY-SA 4.0"}, {"link": "m", "body": "c", "content_license": "other"}]}',)], "json string")
    assert [r.link for r in sources.licensed_posts(posts).collect()] == ["l"]
    (tmp_path / "sms.txt").write_text("ham\thello \"there\nspam\twin\n")
    assert [r.text for r in sources.messages(spark, str(tmp_path / "sms.txt")).collect()] == ['hello "there']


SENTENCES = {
    'Dr. Smith left. "Why?" He said so. 7 came': ["Dr. Smith left.", '"Why?"', "He said so.", "7 came"],
    "": [],
    " \n ": [],
    "One line.\nMr.\nTwo": ["One line.", "Mr.", "Two"],
    "See fig. 3 and vol. 2. J. R. Smith  wrote it.  (It is so.) Yes!": ["See fig. 3 and vol. 2. J. R. Smith  wrote it.", "(It is so.)", "Yes!"],
    "It was 5 p.m. They left... Then? ‘No.’ Ok": ["It was 5 p.m. They left...", "Then?", "‘No.’", "Ok"],
    "the end. lower case. Next": ["the end. lower case.", "Next"],
    "Wow!. Is it (e.g. A)? Plan B. Then C": ["Wow!.", "Is it (e.g. A)?", "Plan B. Then C"],
    "Inc. Next. MRS. Jones and Co.\u2003Went": ["Inc. Next.", "MRS. Jones and Co.\u2003Went"],
    "no mark at all": ["no mark at all"],
}


def test_sentences(spark):
    rows = spark.createDataFrame(list(enumerate([*SENTENCES, None])), "k int, text string").select("k", corpus.sentences(F.col("text")).alias("s")).collect()
    got = {r.k: r.s for r in rows}
    assert [got[k] for k in range(len(got))] == [*SENTENCES.values(), None]


PAGES = {
    "<p>one <b>two</b></p><script>x</script><div>3 &amp; 4<br>5</div>": ["one two", "3 & 4", "5"],
    "": [],
    "plain &lt;b&gt; &eacute;&#33;&#x3f;&hellip; text\n\xa0 \tends": ["plain <b> é!?… text ends"],
    "a<pre>hidden <b>too</b></pre>b<PRE\nclass='x'>c<p>d</PRE>e": ["ab", "e"],
    "<pre>1<pre>2</pre>3</pre>4<pre>open <li> end": ["4"],
    "<script>if (a < b) { '<p>' }</script>x<style>p > a {}</style ><!-- <p> -->y": ["xy"],
    "<a href='x>y' title=\"<p>\">link</a><br/>next<BR>last</LI>": ["link", "next", "last"],
    "<title>T</title><table><tr><td>1</td><td>2</td></table><h1>H</h1><h5>five</h5>": ["T12", "H", "five"],
    "<blockquote>q</blockquote><pretty>p</pretty><link>l": ["q", "pl"],
    "1 < 2 and 3 > 2<!doctype html>": ["1 < 2 and 3 > 2"],
    "</pre>x<p></p><p> </p><p>y": ["x", "y"],
}


def test_html_paragraphs(spark):
    rows = spark.createDataFrame(list(enumerate([*PAGES, None])), "k int, html string").select("k", sources.html_paragraphs(F.col("html")).alias("p")).collect()
    got = {r.k: r.p for r in rows}
    assert [got[k] for k in range(len(got))] == [*PAGES.values(), None]


def test_encoders_have_their_forms(spark):
    rows = spark.createDataFrame([(k, 'Plain "text" & 100% <more>') for k in range(60)], "k bigint, text string")
    got = rows.select(*[encode(F.col("text"), F.col("k")).alias(t.replace("-", "_")) for t, encode in codecs.VARIED.items()]).collect()
    forms = {c: {r[c] for r in got} for c in got[0].asDict()}
    assert {len(forms[c]) for c in ("html_entity", "decimal_codes")} == {3} and len(forms["hex"]) == 4
    assert all(len(forms[c]) == 2 for c in ("backslash_escape", "binary", "combining_marks"))
    assert any(f.startswith("0x50 0x6c") for f in forms["hex"]) and any("&quot;" in f for f in forms["html_entity"])
    assert codecs.STACKS == tuple(dict.fromkeys(codecs.STACKS)) and len(codecs.STACKS) == 16
    slips = spark.createDataFrame([(k, "nothing changes small words here today") for k in range(200)], "k bigint, text string").select(codecs.slip(F.col("text"), F.col("k"), 2).alias("t")).collect()
    words = {w for r in slips for w in r.t.split(" ")}
    assert {"here"} == {w for r in slips for w in r.t.split(" ")[4:5]} and {"smlal", "smalll", "smll", "today"} & words and all(w[0] in "ncswht" for w in words)


def test_archive_words_and_tables_kept(spark, tmp_path):
    import io
    import tarfile

    lists = {"x/final/english-words.10": "the\nThe cat's\ncat\n\n", "x/final/british-words.70": "café\nrare\n", "x/final/english-words.99": "naïve\n", "x/README.10": "no\n", "x/final/english-upper.35": "Paris\r\n"}
    with tarfile.open(tmp_path / "lists.tar.gz", "w:gz") as archive:
        for name, text in lists.items():
            info = tarfile.TarInfo(name)
            info.size = len(data := text.encode("latin-1"))
            archive.addfile(info, io.BytesIO(data))
    words = sources.archive_words(spark, str(tmp_path / "lists.tar.gz"))
    assert sorted(r.word for r in words.collect()) == ["Paris", "café", "cat", "the"]
    built = []
    build = lambda: built.append(1) or words
    for _ in range(2):
        assert sources.kept_once(build, spark, str(tmp_path / "words")).count() == 4
    assert built == [1]
    rows = spark.range(50).withColumnRenamed("id", "k")
    order = [r.k for r in corpus.shuffled(rows, "k", "s").collect()]
    assert sorted(order) == list(range(50)) != order and order == [r.k for r in corpus.shuffled(rows.repartition(7), "k", "s").collect()]


def test_command_line(tmp_path, capsys, monkeypatch, spark):
    from clearspark import cli

    monkeypatch.setattr(cli, "local_session", lambda: spark)
    (tmp_path / "w.txt").write_text("\n".join("please send the parcel to old house before end of this week hello world".split()))
    text = "Please send the parcel to the old house before the end of this week"
    import base64
    import io
    import json
    import sys

    assert cli.main([base64.b64encode(text.encode()).decode(), "--words", str(tmp_path / "w.txt"), "--json"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["text"] == text and [s["transform"] for s in got["steps"]] == ["base64"]
    monkeypatch.setattr(sys, "stdin", io.StringIO("hello world\n"))
    assert cli.main(["--words", str(tmp_path / "w.txt"), "--level", "aggressive"]) == 0 and capsys.readouterr().out == "hello world\n"
