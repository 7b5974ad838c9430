"""Word rules as relations: a row for each candidate, windows over the document as evidence. One round at layer 0.

The kernel is what decides layered and overlapping disguises; these plans are for analytics at scale and stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearspark.functions import text as T
from clearspark.kernel import tables
from clearspark.operators.scoring import fit, known_tokens, small, stored


def _map(table: dict[str, str]):
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _gate(candidates: DataFrame, key: str) -> DataFrame:
    """n_sure beside every candidate: how many of its document are sure."""
    return candidates.withColumn("n_sure", F.sum(F.when(F.col("strength") == "sure", 1).otherwise(0)).over(Window.partitionBy(key)))


_START = "\ufdd0"  # marks where a sentence starts; a code point that Unicode gives to no character


def _is_known(rows: DataFrame, lexicon: DataFrame, column: str, out: str) -> DataFrame:
    """rows with `out`: whether the word of a column is known; false for null and empty."""
    return known_tokens(rows, lexicon, column).withColumn("known", F.coalesce("known", F.lit(False))).withColumnRenamed("known", out)


def _capital(plain: Column) -> Column:
    return F.concat(F.upper(F.substring(plain, 1, 1)), F.lower(F.substring(plain, 2, 1 << 20)))


def leet(docs: DataFrame, lexicon: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ix, token, plain, strength, accepted for tokens that digits and signs are read into as letters, 1 as i or as l.

    Prices, ordinals, units and short models have no row. Sure readings are accepted; weak ones beside a sure one; unknown
    words beside two. Of a token with more than one 1, readings with all of them alike are tried.
    """
    marked = F.regexp_replace(F.col(text), r"""((?:^|[.!?]\s+|\n\s*)["'“‘(]?)(?=[A-Za-z0-9@$!])""", f"$1{_START}")
    pattern = rf"(?U)(?<![\w@$.,]){_START}?[A-Za-z0-9@$!]+(?:['’][A-Za-z]+)?(?![\w@$])"
    cut = docs.select(key, F.posexplode(F.regexp_extract_all(marked, F.lit(pattern), F.lit(0))).alias("ix", "found"))
    token = F.col("token")
    cut = cut.select(key, "ix", F.col("found").startswith(_START).alias("first"), F.regexp_replace(F.replace("found", F.lit(_START), F.lit("")), "!+$", "").alias("token"))
    mixed = token.rlike("[0-9@$!]") & ~token.rlike("[2689]") & ~token.rlike(r"^[0-9]*$") & ~token.rlike(r"^\$\d[\d.,]*(?:[kKmMbB]|bn|mm)?$")
    group = lambda p, k: F.regexp_extract("token", p, k)
    cut = cut.where(mixed)
    # what a token is by itself is asked once for all places where it stands
    graded = stored(cut.select("token").distinct()).withColumns({
        "unit": group(r"^\d+([A-Za-z]+)$", 1), "name": group(r"^([A-Za-z]+)\d+$", 1), "doubled": token.rlike("^[a-z]{2}(?:33|00)$"),
        "way": F.array(*[F.translate("token", "013457@$!", f"o{one}eastasi") for one in "il"]),
    })
    drop = F.lower("unit").isin(*sorted(tables.UNITS)) | (F.length("name").between(1, 2) & ~F.col("doubled"))
    graded = graded.where(~drop).withColumns({"one": F.col("way")[0], "other": F.col("way")[1]})
    asked = ("unit", "name", "one", "other")  # each a word to look up: one join for all
    each = graded.select("token", F.posexplode(F.array(*asked)).alias("k", "probe")).where("probe <> ''")
    flags = _is_known(each, lexicon, "probe", "yes").groupBy("token").agg(*(F.max((F.col("k") == k) & F.col("yes")).alias(f"{c}_known") for k, c in enumerate(asked)))
    tried = graded.join(flags, "token").where(~(token.rlike("^4[A-Za-z]+$") & F.col("unit_known")))
    number = F.col("name_known") | ((F.col("unit") != "") & ((F.length("unit") < 3) | F.col("unit_known")))
    slight = (F.length("token") < 4) | ~token.rlike("[A-Za-z]") | F.regexp_replace("token", "^[@$!]+|[@$!]+$", "").rlike("^[A-Za-z]+$")
    shape = (
        F.when((F.length("token") == 3) & token.rlike("^[A-Za-z].[A-Za-z]$"), "sure").when(slight, "weak").when(F.col("doubled"), "sure").when(number, "weak").otherwise("sure")
    )
    known = F.col("one_known") | F.col("other_known")
    strength = F.when(known, shape).when(shape == "sure", "unknown")
    word = F.when(~F.col("one_known") & F.col("other_known"), F.col("other")).otherwise(F.col("one"))
    letters = F.regexp_replace("token", "[^A-Za-z]", "")
    word = F.when((F.length(letters) > 1) & (letters == F.upper(letters)), F.upper(word)).otherwise(word)
    graded = small(stored(tried.select("token", word.alias("word"), strength.alias("strength")).where("strength is not null")))
    opening = F.concat(F.upper(F.substring("word", 1, 1)), F.substring("word", 2, 1 << 20))
    found = cut.join(graded, "token").withColumn("plain", F.when(F.col("first") & ~token.rlike("^[A-Za-z]"), opening).otherwise(F.col("word")))
    gated = _gate(found, key)
    ok = (F.col("strength") == "sure") | ((F.col("strength") == "weak") & (F.col("n_sure") >= 1)) | ((F.col("strength") == "unknown") & (F.col("n_sure") >= 2))
    return gated.select(key, "ix", "token", "plain", "strength", ok.alias("accepted"))


def separators(docs: DataFrame, lexicon: DataFrame, sign: str = "_", needed: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ix, token, plain, strength, accepted for letters joined by the sign."""
    run = rf"(?U)(?<![\w{sign}])[A-Za-z](?:[{sign}][A-Za-z]){{2,}}(?!\w)"
    cut = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(run), F.lit(0))).alias("ix", "token"))
    found = known_tokens(cut.withColumn("plain", F.replace("token", F.lit(sign), F.lit(""))), lexicon, "plain")
    shout = F.col("plain") == F.upper("plain")
    strength = F.when(F.col("known"), F.when(shout, "weak").otherwise("sure")).when((F.length("plain") > 3) & ~shout, "name")
    gated = _gate(found.withColumn("strength", strength).where("strength is not null"), key)
    ok = (F.col("strength") == "sure") | ((F.col("strength") == "weak") & (F.col("n_sure") >= 1)) | ((F.col("strength") == "name") & (F.col("n_sure") >= needed))
    return gated.select(key, "ix", "token", "plain", "strength", ok.alias("accepted"))


#: The first stretched letter of a word: what is before it, its first and its second character.
_FIRST_STRETCH = r"^((?:(?!([A-Za-z])(?i:\2){2}).)*)([A-Za-z])((?i:\3))(?i:\3)+"


def stretched(docs: DataFrame, lexicon: DataFrame, text: str = "text", key: str = "doc_id", grams: DataFrame | None = None) -> DataFrame:
    """key, ix, token, plain, strength, accepted for unknown words with up to four stretched letters, each cut to two or one.

    Of several known words that of the most usual letters is taken, with `grams`, or the longest. One find alone needs
    five letters; words that stay unknown (`name`) lose their stretches beside two finds.
    """
    pattern = r"(?U)(?<![\w'’])[A-Za-z]+(?:['’][A-Za-z]+)?(?![\w'’])"
    cut = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("ix", "token"))
    cut = cut.where(F.col("token").rlike(r"(?i)([a-z])\1{2}") & (F.length("token") > 3))
    # what a token becomes is asked once for all places where it stands
    each = _is_known(cut.select("token").distinct(), lexicon, "token", "usual").where("not usual")
    ways = F.array("token")
    for _ in range(4):
        ways = F.flatten(F.transform(ways, lambda w: F.array(F.regexp_replace(w, _FIRST_STRETCH, "$1$3$4"), F.regexp_replace(w, _FIRST_STRETCH, "$1$3"))))
    bare = F.filter(F.array_distinct(ways), lambda w: ~w.rlike(r"(?i)([a-z])\1{2}") & (F.length(w) > 2))
    tried = _is_known(each.select("token", F.posexplode_outer(bare).alias("way", "plain")), lexicon, "plain", "known")
    if grams is not None:
        several = tried.where("known").groupBy("token").agg(F.collect_set("plain").alias("all")).where("size(all) > 1")  # at most 16 a token
        words = several.select(F.explode("all").alias("plain")).distinct()
        tried = tried.join(fit(words, grams, "plain", "plain"), "plain", "left")
    order = F.struct(F.coalesce("fit", F.lit(float("-inf"))) if grams is not None else F.lit(0), -F.col("way"))
    best = tried.groupBy("token").agg(F.max_by(F.when(F.col("known"), F.col("plain")), F.when(F.col("known"), order)).alias("plain"))
    shout = F.col("token") == F.upper("token")
    single = F.regexp_replace("token", r"([A-Za-z])(?i:\1){2,}", "$1")
    named = best.withColumns({"strength": F.when(F.col("plain").isNotNull(), "sure").when(~shout, "name"), "plain": F.coalesce("plain", single)})
    gated = _gate(cut.join(named.where("strength is not null"), "token"), key)
    ok = F.when(F.col("strength") == "sure", (F.col("n_sure") > 1) | (F.length("plain") > 4)).otherwise(F.col("n_sure") > 1)
    return gated.select(key, "ix", "token", "plain", "strength", ok.alias("accepted"))


def shorthand(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ix, token, plain, strength, accepted: listed forms, forms beside certain words, and numbers before them.

    Sure forms are accepted; unsure ones (capitals, numbers) beside a sure one, or capitals and numbers beside each other;
    loose ones (a number before any other word) beside two sure ones. A number with decimals is one token, and no form.
    """
    pattern = r"(?U)(?<![\w'’@#/.\-])(?:[0-9]+(?:\.[0-9]+)+|(?![0-9]+\.[0-9])[A-Za-z0-9]+)(?![\w'’@/\-])"
    shouting = F.col(text).rlike(r"\p{Lu}") & ~F.col(text).rlike(r"\p{Ll}")
    forms = sorted({*tables.SHORTHAND, *tables.SHORTHAND_CAPITALS, *tables.SHORTHAND_BESIDE, *tables.SHORTHAND_NUMBERS})
    cut = docs.select(key, shouting.alias("shouting"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("all"))
    # only listed forms leave their text, each with its neighbours
    mine = F.filter(F.transform("all", lambda x, i: F.struct(i.alias("ix"), x.alias("token"))), lambda x: F.lower(x["token"]).isin(*forms))
    at = lambda i: F.coalesce(F.get("all", i), F.lit(""))
    near = cut.withColumn("x", F.explode(mine)).select(
        key, "shouting", "x.*", F.lower("x.token").alias("low"), at(F.col("x.ix") - 1).alias("before"), at(F.col("x.ix") + 1).alias("after")
    )
    beside, follow = F.array(F.lower("before"), F.lower("after")), F.lower("after")
    capitals = F.col("token").rlike("[A-Z]") & ~F.col("token").rlike("[a-z]")
    listed = F.try_element_at(_map(tables.SHORTHAND), F.col("low"))
    listed = F.coalesce(listed, F.when(capitals, F.try_element_at(_map(tables.SHORTHAND_CAPITALS), F.col("low"))))
    plain, strength = F.when(listed.isNotNull(), listed), F.when(listed.isNotNull(), F.when(capitals, "unsure").otherwise("sure"))
    for form, (full, words) in tables.SHORTHAND_BESIDE.items():
        met = (F.col("low") == form) & F.arrays_overlap(beside, F.array(*map(F.lit, sorted(words))))
        plain, strength = plain.when(met, full), strength.when(met, "sure")
    cased = F.when(F.col("shouting") & (F.length("token") > 1) & capitals, F.upper(plain)).when(F.col("token").rlike("^[A-Z]"), _capital(plain)).otherwise(plain)
    other = ~F.col("low").isin(*tables.SHORTHAND_BESIDE) & listed.isNull() & ~F.col("before").rlike("^[0-9.]+$")
    other = other & ((F.col("after").rlike("[a-z]") & ~F.col("after").rlike("[A-Z]")) | F.col("shouting"))
    counted, number, grade = F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string")
    for form, (full, words) in tables.SHORTHAND_NUMBERS.items():
        here = other & (F.col("low") == form)
        met = here & follow.isin(*sorted(words))
        loose = here & ~met & F.col("after").rlike("^[A-Za-z]+$") & ~follow.endswith("s") & ~follow.isin(*sorted(tables.COUNTED))
        counted, number = counted | met, F.when(met | loose, full).otherwise(number)
        grade = F.when(met, "unsure").when(loose, "loose").otherwise(grade)
    found = near.withColumns({
        "strength": F.coalesce(strength, grade), "plain": F.coalesce(cased, number), "number": F.coalesce(counted, F.lit(False)),
        "capital": listed.isNotNull() & capitals & (F.length("token") > 1),
    })
    each = Window.partitionBy(key)
    gated = _gate(found.where("strength is not null"), key).withColumn("backed", (F.max("capital").over(each)) & (F.max("number").over(each)))
    ok = (F.col("strength") == "sure") | ((F.col("strength") == "unsure") & ((F.col("n_sure") >= 1) | F.col("backed"))) | (F.col("n_sure") > 1)
    return gated.select(key, "ix", "token", "plain", "strength", ok.alias("accepted"))


def misspelt(docs: DataFrame, lexicon: DataFrame, text: str = "text", key: str = "doc_id", share: float = 0.7) -> DataFrame:
    """key, ix, token, plain, accepted: listed misspellings that are no words, where enough other words are known."""
    pattern = r"(?U)(?<![\w'’@#/.\-])[A-Za-z]+(?![\w'’@/\-])"
    cut = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("ix", "token"))
    found = known_tokens(cut, lexicon).withColumn("plain", F.try_element_at(_map(tables.MISSPELT), F.lower("token"))).withColumn("hit", F.col("plain").isNotNull() & ~F.col("known"))
    other = F.when(~F.col("hit") & (F.length("token") > 1), F.col("known").cast("int"))
    w = Window.partitionBy(key)
    known, total = F.coalesce(F.sum(other).over(w), F.lit(0)), F.count(other).over(w)
    judged = found.withColumn("accepted", known >= share * total).where("hit")
    return judged.select(key, "ix", "token", "plain", "accepted")


def slips(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """word, plain: unknown words of six letters and more from which exactly one listed word is a slip away."""
    n = F.length(word)
    swap = lambda i: F.concat(F.substring(F.col(word), F.lit(1), i - 1), F.substring(F.col(word), i + 1, F.lit(1)), F.substring(F.col(word), i, F.lit(1)), F.substring(F.col(word), i + 2, n))
    same = lambda i: F.substring(F.col(word), i, F.lit(1)) == F.substring(F.col(word), i + 1, F.lit(1))
    less = lambda i: F.concat(F.substring(F.col(word), F.lit(1), i), F.substring(F.col(word), i + 2, n))
    ways = F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.when(same(i), less(i)).otherwise(swap(i))))
    unknown = words.where((n >= 6) & (F.col(word) == F.lower(word))).join(lexicon.select(F.col("word").alias("_w")), F.col(word) == F.col("_w"), "left_anti")
    tried = unknown.select(word, F.explode(ways).alias("plain"))
    met = tried.join(lexicon.select(F.col("word").alias("plain")), "plain", "left_semi")
    return met.groupBy(word).agg(F.min("plain").alias("plain"), F.count("*").alias("n")).where("n = 1").drop("n")


def emoji(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ix, token, plain: emoji behind a word and a space, before a word or behind a lead, not beside its own word."""
    group = "|".join(tables.EMOJI)
    parts = F.regexp_extract_all(F.col(text), F.lit(rf"([A-Za-z]+) ({group})[\x{{fe0f}}]?(?: ([A-Za-z]+))?(?! *[\x{{1f000}}-\x{{1ffff}}])"), F.lit(0))
    cut = docs.select(key, F.posexplode(parts).alias("ix", "found"))
    get = lambda k: F.regexp_extract("found", rf"^([A-Za-z]+) ({group})[\x{{fe0f}}]?(?: ([A-Za-z]+))?$", k)
    cut = cut.withColumns({"before": F.lower(get(1)), "token": get(2), "after": F.lower(get(3))}).withColumn("plain", F.element_at(_map(tables.EMOJI), F.col("token")))
    own = lambda c: F.col(c).isin("") | (F.col(c) == F.col("plain")) | (F.col(c) == F.concat("plain", F.lit("s"))) | (F.col(c) == F.regexp_replace("plain", "s+$", ""))
    lead = F.col("before").isin(*sorted(tables.EMOJI_LEADS))
    ok = ~own("before") & (F.col("after").eqNullSafe("") | ~own("after")) & ((F.col("after") != "") | lead)
    return cut.where(ok).select(key, "ix", "token", "plain")
