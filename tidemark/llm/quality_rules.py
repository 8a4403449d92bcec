"""Quality rules: counts a page must meet, and its distance from what its language looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

#: Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that it for was with as by on this from are be or at an he which not have".split(),
    "fr": "le la les de des et un une du en que qui dans pour sur est par au avec ne pas ce il elle ou".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als für es an werden aus er".split(),
    "es": "de la que el en y los se del las un por con una su para es al lo no como más o pero sus".split(),
}
#: Documents that name a language before there is a reference for it, and the most languages that are held in a task.
LEAST_DOCS, MOST_LANGUAGES = 20, 10_000
SPACE = r"\x20\x09-\x0D"
#: Characters of each class but the first, `lower` (a-z), and the last, `other`.
CHAR_CLASSES = {"upper": "A-Z", "digit": "0-9", "space": SPACE, "punct": ".,;:!?'\"()-", "symbol": "#*$%&|<>"}
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})
#: As they stand in a text: also capitalised, or before a comma or full stop.
SPELLINGS = sorted({v + end for w in VOCABULARY for v in (w, w.capitalize(), w.upper()) for end in ("", ",", ".")})


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text and its
    histograms: `char_counts` (an array by class) and `word_counts` (word number in VOCABULARY from 1, count)."""
    t, words, rest = F.col("_t"), F.col("_words"), F.col("_rest")
    one = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    bare = F.btrim(t, F.lit(" \t\n\x0b\f\r"))
    one = one.withColumns({
        "_words": F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+")),
        "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]")),
        # a-z are most of a text: the other classes are counted in what is left without them
        "_rest": F.regexp_replace(t, "[a-z]+", ""),
    })
    n = F.size(words)
    common = F.filter(words, lambda w: w.isin(SPELLINGS))
    one = one.withColumns({
        "n_words": n.cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_grams": F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))),
        "_common": F.sort_array(F.transform(common, lambda w: F.array_position(F.array(*map(F.lit, VOCABULARY)), F.lower(F.rtrim(w, F.lit(",.")))))),
        **{f"_{name}": F.length(F.regexp_replace(rest, f"[^{chars}]+", "")).cast("long") for name, chars in CHAR_CLASSES.items()},
    })
    # few texts repeat a 3-word window; only those are sorted
    grams, common, sorted_, again, runs = (F.col(f"_{x}") for x in ("grams", "common", "sorted", "again", "runs"))
    one = one.withColumns({
        "_sorted": F.when(F.size(F.array_distinct(grams)) < F.size(grams), F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
        "_runs": F.filter(F.transform(common, lambda w, k: F.struct(w.alias("w"), k.alias("k"))), lambda x: F.coalesce(F.get(common, x["k"] - 1) != x["w"], F.lit(True))),
    })
    same = lambda x, k: F.coalesce(F.get(sorted_, k)["h"] == x["h"], F.lit(False))
    one = one.withColumn("_again", F.sort_array(F.transform(F.filter(sorted_, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    reach = F.transform(again, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(again, k + 1) - p, F.lit(3))).cast("long"))
    known = sum((F.col(f"_{name}") for name in CHAR_CLASSES), F.lit(0).cast("long"))
    return one.withColumns({
        "word_chars": F.length(t) - F.col("_space"),
        "n_symbols": F.col("_symbol"),
        "n_repeat_words": F.coalesce(_total(reach), F.lit(0)).cast("long"),
        "char_counts": F.array((F.length(t) - F.length(rest)).cast("long"), *[F.col(f"_{name}") for name in CHAR_CLASSES], F.length(rest) - known),
        "word_counts": F.transform(runs, lambda x, j: F.struct(x["w"].alias("w"), (F.coalesce(F.get(runs, j + 1)["k"], F.size(common)) - x["k"]).cast("long").alias("n"))),
    }).drop("_t", "_words", "_lines", "_rest", "_grams", "_common", "_sorted", "_again", "_runs", *[f"_{name}" for name in CHAR_CLASSES])


def references(measured: DataFrame, lang: str = "lang") -> DataFrame:
    """lang, char_ref, word_ref: the share of each character class, over all documents of each language that LEAST_DOCS of
    them name, and of each word of VOCABULARY among the common words, null for a language without a list in COMMON_WORDS."""
    rows = measured.where(F.col(lang).isNotNull()).withColumnRenamed(lang, "lang")
    listed = F.col("lang").isin(list(COMMON_WORDS))
    width = len(CHAR_CLASSES) + 2
    share = lambda parts: F.array(*[p / F.greatest(sum(parts, F.lit(0)), F.lit(1)) for p in parts])
    chars = rows.groupBy("lang").agg(F.count("*").alias("n"), *[F.sum(F.get("char_counts", F.lit(i))).alias(f"c{i}") for i in range(width)]).where(F.col("n") >= LEAST_DOCS)
    words = rows.where(listed).select("lang", F.explode("word_counts").alias("x")).groupBy("lang").agg(*[F.sum(F.when(F.col("x.w") == i, F.col("x.n")).otherwise(0)).alias(f"w{i}") for i in range(1, len(VOCABULARY) + 1)])
    none = F.array_repeat(F.lit(0.0), len(VOCABULARY))
    return chars.select("lang", share([F.col(f"c{i}") for i in range(width)]).alias("char_ref")).join(words.select("lang", share([F.col(f"w{i}") for i in range(1, len(VOCABULARY) + 1)]).alias("word_ref")), "lang", "left").withColumn("word_ref", F.when(listed, F.coalesce("word_ref", none)))


def _term(p: Column, q: Column) -> Column:
    return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)


def _distance(twice_squared: Column) -> Column:
    return F.sqrt(F.least(F.greatest(twice_squared / 2, F.lit(0.0)), F.lit(1.0)))


def char_distance(counts: Column, n: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of counts by class, n in all, from shares by class; null without any."""
    both = F.zip_with(counts, F.array(*map(F.lit, reference)), lambda c, q: _term(c / n, q) + _term(q, c / n))
    return F.when(n > 0, _distance(F.aggregate(both, F.lit(0.0), lambda a, x: a + x)))


def word_distance(counts: Column, n: Column, reference: list[float]) -> Column:
    """The same for sparse counts; a word that the text lacks adds its whole share. Null without common words."""
    shares = F.array(*map(F.lit, reference))
    added = lambda p, q: _term(p, q) + _term(q, p) - q
    return F.when(n > 0, _distance(F.aggregate(counts, F.lit(float(sum(reference))), lambda a, x: a + added(x["n"] / n, F.get(shares, x["w"] - 1)))))


def quality_rules(docs: DataFrame, max_char: float = 0.3, max_word: float = 0.6, least_words: int = 50, least_common: int = 20, refs: DataFrame | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang): the counts, base_failed, char_distance, word_distance, kept.

    A document fails the base rule with fewer than 50 words or with over half of its words in repeated 3-word windows.
    Else its histograms of character classes and of common words are compared with each language's, which are built
    from all documents of that language (or given as `refs`); it is dropped if the nearest language's character classes
    are further than `max_char`, or its common words further than `max_word`. Below `least_words` words neither
    distance is taken, below `least_common` common words not the second: so few say nothing, and the distance is null.

    Every value of `lang` that enough documents name has character references, and those with a word list have word
    references. A document whose own `lang` has no reference of a kind, or is null, is of a kind of text that nothing is
    known of: that distance is null and the base rule decides. Otherwise it is held against all languages, so naming
    another known language does not hurt it. A very long text is measured whole, in one task.

    Null and empty texts have zero counts and fail the base rule; without any known language the distances are null and
    the base rule decides. Repeated rows are judged alike; other columns are ignored."""
    n_common = F.aggregate("word_counts", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    measured = measures(docs.select("doc_id", "text", "lang")).withColumns({"n_char": _total(F.col("char_counts")), "n_word": n_common})
    measured = materialise(measured, "measures")
    # a few numbers for each language; their number is checked before they go to every task
    known = (references(measured) if refs is None else refs).select("lang", "char_ref", "word_ref").limit(MOST_LANGUAGES + 1).collect()
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    enough = {"char": F.col("n_words") >= least_words, "word": (F.col("n_words") >= least_words) & (F.col("n_word") >= least_common)}
    nearest = {}
    for k, distance in (("char", char_distance), ("word", word_distance)):
        held = [row for row in known if row[f"{k}_ref"] is not None]
        far = [distance(F.col(f"{k}_counts"), F.col(f"n_{k}"), list(row[f"{k}_ref"])) for row in held]
        own = F.col("lang").isin([row["lang"] for row in held])
        nearest[k] = F.when(enough[k] & own, F.least(*far) if len(far) > 1 else far[0]) if far else F.lit(None).cast("double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), nearest["char"].alias("char_distance"), nearest["word"].alias("word_distance"))
    odd = F.coalesce(F.col("char_distance") > max_char, F.lit(False)) | F.coalesce(F.col("word_distance") > max_word, F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~odd)
