"""Benchmark decontamination by winnowing: fingerprints find the documents, whole windows confirm the hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.secrets import text_key
from tidemark.llm.urls import lower_ascii
from tidemark.session import materialise

#: Words of a window, and words of a fingerprinted k-gram.
SPAN, GRAM = 10, 5
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows up to which a table of benchmark windows is sent to all executors: 200,000 x 100 bytes or so.
BROADCAST_ROWS = 200_000


def text_keys(docs: DataFrame, by_text: bool) -> DataFrame:
    """doc_id, text_key, text: rows without an id are told apart by their texts, and all rows with `by_text`."""
    key = text_key(F.col("text"))
    return docs.select("doc_id", (key if by_text else F.when(F.col("doc_id").isNull(), key).otherwise("")).alias("text_key"), "text")


def with_words(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """keys, _w: the runs of characters that are digits, letters or beyond ASCII. Splitting leaves an empty string
    before a leading and after a trailing break; those are cut off."""
    parts = F.col("_p")
    front = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
    back = F.when(F.get(parts, F.size(parts) - 1) == "", 1).otherwise(0)
    split = rows.select(*keys, F.split(text, _BREAK).alias("_p"))
    return split.select(*keys, F.slice(parts, front + 1, F.greatest(F.size(parts) - front - back, F.lit(0))).alias("_w"))


def grams(words: Column, k: int) -> Column:
    """Hashes of all runs of k words; empty below k words."""
    n = F.size(words)
    run = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), run)).otherwise(F.array().cast("array<bigint>"))


def least_of(hashes: Column, width: Column) -> Column:
    """The smallest hash of every `width` neighbours; empty below that."""
    n = F.size(hashes)
    least = lambda i: F.array_min(F.slice(hashes, i + 1, width))
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), least)).otherwise(F.array().cast("array<bigint>"))


def fingerprints(rows: DataFrame, keys: list[str], span: int, gram: int) -> DataFrame:
    """keys, n_words, prints: the distinct winnowed hashes of each text, enough to meet any text that shares `span`
    consecutive words. Letters are compared without case here, which only finds more; the sigma whose lower case
    depends on its neighbours is replaced first."""
    folded = F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit("Σ"), F.lit("σ")))
    worded = with_words(rows, keys, folded)
    hashed = worded.select(*keys, F.size("_w").cast("long").alias("n_words"), grams(F.col("_w"), gram).alias("_g"))
    return hashed.select(*keys, "n_words", F.array_distinct(least_of(F.col("_g"), F.lit(span - gram + 1))).alias("prints"))


def windows(rows: DataFrame, keys: list[str], lengths: Column, gram: int) -> DataFrame:
    """keys, length, start, print, window: every run of each of `lengths` (an array) words of each text, exactly as
    compared. A text is split and hashed once for all lengths; a text too short for a length gives one row of nulls."""
    worded = with_words(rows.withColumn("_lengths", lengths), [*keys, "_lengths"], lower_ascii(F.coalesce("text", F.lit(""))))
    hashed = worded.select(*keys, "_w", grams(F.col("_w"), gram).alias("_g"), F.explode("_lengths").alias("length"))
    least = hashed.select(*keys, "_w", "length", least_of(F.col("_g"), F.col("length") - (gram - 1)).alias("_m"))
    each = F.transform("_m", lambda m, s: F.struct(s.alias("start"), m.alias("print"), F.array_join(F.slice("_w", s + 1, F.col("length")), " ").alias("window")))
    return least.select(*keys, "length", F.explode_outer(each).alias("x")).select(*keys, "length", "x.*")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def find_contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, by_text: bool = False, unnamed_items: bool = False) -> DataFrame:
    """One row per doc_id of `docs` (doc_id, text) against all items of `benchmark` (item_id, text): n_words, n_hit,
    n_items, items (the ids as sorted strings), contaminated, and `text_key`, which tells rows without an id apart.

    A window is `span` consecutive words of an item, or the whole item if it has fewer; every document word inside an
    occurrence of a window is hit. The winnowing window is set by the shortest item, so shorter items are met too.
    Documents whose fingerprints meet the benchmark's are read again, once for all lengths of windows, and a window counts
    only if all its words are equal. Tables of the benchmark are sent to all executors up to BROADCAST_ROWS rows, beyond
    that both sides are shuffled by hash and window.

    Null and empty texts have no words: such a document is clean, such an item never occurs. Rows of one doc_id are
    taken as one document (n_words of the longest, hits of all), or with `by_text` only if their texts are equal; rows
    without an id are one document only if their texts are equal. Repeated items count once per item_id; items without an
    id are left out, or with `unnamed_items` are met like others and count as one item without a place in `items`. Without
    items every document is clean; an empty table gives no rows; other columns are ignored."""
    docs, keys = text_keys(docs, by_text), ["doc_id", "text_key"]
    met_by = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    named = (benchmark if unnamed_items else benchmark.where("item_id is not null")).select(F.struct(F.col("item_id").cast("string").alias("item_id"), "text").alias("item"), "text")
    items = with_words(named, ["item"], lower_ascii(F.coalesce("text", F.lit("")))).select("item.*", F.size("_w").alias("n")).where("n > 0")
    items = materialise(items, "items")
    lengths = sorted(r.n for r in items.select(F.least("n", F.lit(span)).alias("n")).distinct().collect())  # at most `span` numbers
    if not lengths:
        counted = fingerprints(docs, keys, span, gram).groupBy(*keys).agg(F.max("n_words").alias("n_words"))
        return _result(counted, None)
    gram = min(gram, lengths[0])
    # explode_outer: for a plain explode the planner repeats the whole expression in a filter on its size; null meets nothing
    prints = materialise(fingerprints(items, ["item_id"], lengths[0], gram).select(F.explode_outer("prints").alias("print")).distinct(), "prints")
    own = fingerprints(docs, keys, lengths[0], gram).select(*keys, "n_words", F.explode_outer("prints").alias("print"))
    met = own.join(_small(prints.withColumn("met", F.lit(1))), "print", "left")
    counted = materialise(met.groupBy(*keys).agg(F.max("n_words").alias("n_words"), F.max("met").alias("met")), "counted")
    suspects = counted.where("met = 1").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    # by merging at every size: the ids grow with the documents, so a plan that sends them to all would not last
    again = docs.join(suspects.hint("merge"), met_by, "left_semi")
    held = windows(items, ["item_id"], F.array(F.least("n", F.lit(span))), gram).where("print is not null")
    asked = materialise(held.groupBy("length", "print", "window").agg(F.collect_set("item_id").alias("ids"), F.bool_or(F.col("item_id").isNull()).alias("unnamed")), "windows")
    found = windows(again, keys, F.lit(lengths), gram).join(_small(asked), ["length", "print", "window"]).select(*keys, "start", "length", "ids", "unnamed")
    # as many starts as a document has words, as many ids as the benchmark has items
    reach = lambda acc, x: F.struct(F.greatest(acc["at"], x["start"] + x["length"]).alias("at"), (acc["n"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(acc["at"], x["start"]))).alias("n"))
    hits = found.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"), F.bool_or("unnamed").alias("unnamed"))
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")), reach, lambda acc: acc["n"]).cast("long").alias("n_hit"), "items", "unnamed", "spans")
    return _result(counted.drop("met"), hits)


def _result(counted: DataFrame, hits: DataFrame | None) -> DataFrame:
    none, no_spans = F.array().cast("array<string>"), F.array().cast("array<struct<start:int,length:int>>")
    if hits is None:
        rows = counted.withColumns({"n_hit": F.lit(0).cast("long"), "items": none, "unnamed": F.lit(False), "spans": no_spans})
    else:
        rows = counted.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", none)
    n_items = F.size(items) + F.coalesce("unnamed", F.lit(False)).cast("int")
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"), F.coalesce("spans", no_spans).alias("spans"), "text_key")
