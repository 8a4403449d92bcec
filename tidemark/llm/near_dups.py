"""Near-duplicate documents by bottom-k sketches of one hash function, inverted lists and exact Jaccard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.words import mix, runs_hash, slices, words_of
from tidemark.session import materialise

#: Values kept of each set, and the fewest that two similar texts share: at a similarity of 0.8 a sketch of 64 shares 51
#: on average with a standard deviation of 3.2, so fewer than 32 is a chance below one in a million.
SKETCH, LEAST_SHARED = 64, 32
#: An estimate from the union sketch may be this much too low: five standard deviations.
SLACK = 0.25

#: Columns of the parity of a set.
PARITY = ["s0", "s1", "s2", "s3"]

SKETCHES = "doc_id long, n long, digest string, sketch array<long>"
SETS = "doc_id long, items array<long>"


def shingle_sets(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each text, as hashes; a shorter text is one shingle, an empty one none."""
    words = words_of(batch.column("text"))
    hashes = words.hashes(lower=True)
    grams = runs_hash(hashes, n)
    sets = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= n:
            sets.append(np.unique(grams[a : b - n + 1]))
        else:
            sets.append(mix(runs_hash(hashes[a:b], b - a) + np.uint64(b - a)) if b > a else grams[:0])
    return sets


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat.view(np.int64)))


def _sketcher(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch, n)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets], pa.string()),
                _lists([s[:SKETCH] for s in sets])], names=["doc_id", "n", "digest", "sketch"])

    return run


def _setter(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), _lists(shingle_sets(batch, n))], names=["doc_id", "items"])

    return run


def _prefix(n: Column, percent: int) -> Column:
    """How many of a sketch's values, rarest first, must be looked up so that no similar pair is missed. Small sets are
    wholly in their sketch: overlap of at least percent of the set. Else at least LEAST_SHARED values are shared."""
    whole = n - F.ceil(F.lit(percent) * n / 100) + 1
    return F.when(100 * n <= percent * SKETCH, whole).otherwise(F.least(n, F.lit(SKETCH)) - LEAST_SHARED + 1).cast("int")


def inverted_lists(classes: DataFrame, percent: int) -> DataFrame:
    """value, doc, n, alone: each document under the rarest of its retained values, and how many of them it shares with
    nobody. Frequent passages are thus looked up only in documents that hold hardly anything else."""
    held = classes.select("doc", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    counts = materialise(held.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    shared = held.join(counts, "value")
    # values that no other document holds are the rarest of all and find nobody
    per = shared.groupBy("doc", "n", "k").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("rare"))
    alone = F.col("k") - F.size("rare")
    left = F.greatest(_prefix(F.col("n"), percent) - alone, F.lit(0))
    return per.select("doc", "n", alone.alias("alone"), F.explode(F.slice("rare", 1, left)).alias("x")).select("doc", "n", "alone", "x.value")


def _close_sizes(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(F.col(a), F.col(b)) >= percent * F.greatest(F.col(a), F.col(b))


def star_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """a, b: each member of a list with its most central one, that with the fewest values of its own; as many pairs as
    rows."""
    central = F.min(F.struct("alone", F.xxhash64("doc").alias("h"), F.col("doc"), F.col("n")))
    drawn = lists.groupBy("value").agg(central.alias("hub"), F.count("*").alias("size")).where("size > 1")
    drawn = materialise(drawn.select("value", F.col("hub.doc").alias("hub"), F.col("hub.n").alias("hub_n")), "hubs")
    rows = lists.join(drawn, "value").where(F.col("doc") != F.col("hub")).where(_close_sizes("n", "hub_n", percent))
    return rows.select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).distinct()


def open_lists(lists: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """item, doc, n, alone: the members of lists that hold several groups, under the rarest items of their full sets, and
    how many items each shares with no other member. Of a similarity of percent / 100 an overlap of percent of the
    larger set follows, so two similar sets meet in one of the first n - overlap + 1 items of either."""
    rows = materialise(_grouped(lists.select("value", "doc"), groups), "grouped")
    mixed = materialise(rows.groupBy("value").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("value"), "mixed")
    open_docs = rows.join(mixed, "value").select("doc").distinct()
    items = sets.join(open_docs, F.col("doc_id") == F.col("doc")).select("doc", F.size("items").alias("n"), F.explode("items").alias("item"))
    items = materialise(items, "items")
    counts = materialise(items.groupBy("item").agg(F.count("*").alias("df")).where("df > 1"), "item_counts")
    # as many items as one document has
    per = items.join(counts, "item").groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("rare"))
    alone = F.col("n") - F.size("rare")
    left = F.greatest((F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1 - alone).cast("int"), F.lit(0))
    return per.select("doc", "n", alone.alias("alone"), F.explode(F.slice("rare", 1, left)).alias("x")).select("doc", "n", "alone", "x.item")


def _grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("g", F.coalesce("component", "doc")).drop("component")


def with_hubs(keyed: DataFrame, sets: DataFrame) -> DataFrame:
    """item, doc, n, alone, hub, hub_n, common: each member with the most central one of its list and the exact size of
    their overlap. A member has the same hub in most of its lists, and each pair is compared once."""
    central = F.min(F.struct("alone", F.xxhash64("doc").alias("h"), F.col("doc"), F.col("n")))
    drawn = materialise(keyed.groupBy("item").agg(central.alias("hub"), F.count("*").alias("size")).where("size > 1").select("item", F.col("hub.doc").alias("hub"), F.col("hub.n").alias("hub_n")), "hubs")
    rows = materialise(keyed.join(drawn, "item"), "keyed")
    one, two = (sets.select(F.col("doc_id").alias(k), F.col("items").alias(f"{k}_items")) for k in ("doc", "hub"))
    met = rows.select("doc", "hub").distinct().join(one, "doc").join(two, "hub").groupBy("doc", "hub").agg(F.max(F.size(F.array_intersect("doc_items", "hub_items"))).alias("common"))
    return rows.join(materialise(met, "met"), ["doc", "hub"])


def difference_lists(hubbed: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """hub, item, doc, n, g, dn, small, s0 to s3: the members of hubs that hold several groups, under the rarest items of D,
    in which they differ from their hub; dn counts D, `small` tells the items looked up as the smaller of a pair, and s0
    to s3 are the parity of D's items in 256 places.

    Two sets of n and m items are similar when they differ in at most c * (n + m) items, c = (100 - percent) / (100 +
    percent), and what they differ in is D(x) and D(y) less twice what both D share. So a similar pair shares at least
    (dx + dy - c * (n + m)) / 2 items of D, and as two members that are similar to the hub are one group already, dx or dy
    is above c * (own + hub items): at least one item is shared. The rarest items of D, as many as may be unshared and one
    more, meet one of the other's. What a copy lacks of the hub is frequent and comes last; what it adds is rare."""
    rows = materialise(_grouped(hubbed.select("hub", "hub_n", "doc", "n", "common").distinct(), groups), "grouped")
    mixed = materialise(rows.groupBy("hub").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("hub"), "mixed")
    one, two = (sets.select(F.col("doc_id").alias(k), F.col("items").alias(f"{k}_items")) for k in ("doc", "hub"))
    open_ = rows.join(mixed, "hub").where("doc <> hub").join(one, "doc").join(two, "hub")
    lacks, adds = F.array_except("hub_items", "doc_items"), F.array_except("doc_items", "hub_items")
    dn = F.col("n") + F.col("hub_n") - 2 * F.col("common")
    near = 100 * F.col("common") >= percent * (F.col("n") + F.col("hub_n") - F.col("common"))
    items = materialise(open_.select("hub", "hub_n", "doc", "n", "g", dn.alias("dn"), near.alias("near"), F.explode(F.concat(lacks, adds)).alias("item")), "differences")
    counts = materialise(items.groupBy("hub", "item").agg(F.count("*").alias("df")).where("df > 1"), "difference_counts")
    place = lambda k: F.expr(f"bit_xor(case when (shiftright(item, 6) & 3) = {k} then shiftleft(1L, cast(item & 63 as int)) else 0L end)").alias(f"s{k}")
    rare = F.sort_array(F.collect_list(F.when(F.col("df").isNotNull(), F.struct("df", "item")))).alias("rare")
    per = items.join(counts, ["hub", "item"], "left").groupBy("hub", "hub_n", "doc", "n", "g", "dn", "near").agg(rare, *[place(k) for k in range(4)])
    # whole numbers, so that no rounding loses a pair: all bounds are times two and times 100 + percent
    c, whole = 100 - percent, 100 + percent
    n, h, d = F.col("n").cast("long"), F.col("hub_n"), F.col("dn")
    most = c * (n + F.floor(100 * n / percent))  # of the differences, whatever the size of the partner
    half = lambda x: F.ceil(x / (2 * whole))
    by_hub = F.when(F.col("near"), F.floor((whole * d + c * (h - n)) / (2 * whole)) + 1).otherwise(1)
    as_large = F.greatest(F.lit(1), by_hub, half(2 * whole * d - 2 * most))
    as_small = F.greatest(F.lit(1), by_hub, half(2 * whole * d - most))
    alone = d - F.size("rare")
    left = lambda shared: F.greatest(d - shared + 1 - alone, F.lit(0)).cast("int")
    first = per.withColumns({"_large": left(as_large), "_small": left(as_small)}).select("hub", "doc", "n", "g", "dn", *PARITY, "_small", F.posexplode(F.expr("slice(rare, 1, _large)")).alias("at", "x"))
    return first.select("hub", "x.item", "doc", "n", "g", "dn", *PARITY, (F.col("at") < F.col("_small")).alias("small"))


def cross_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """a, b of different groups that share one of the rare items in which they differ from a common hub, and whose parities
    differ in no more places than two similar sets may differ in items: an item that one lacks changes one place."""
    x, y = (lists.select("hub", "item", *[F.col(c).alias(f"{p}_{c}") for c in ("doc", "n", "g", "dn", "small", *PARITY)]) for p in "xy")
    apart = sum((F.bit_count(F.col(f"x_{s}").bitwiseXOR(F.col(f"y_{s}"))) for s in PARITY), F.lit(0))
    may = (100 + percent) * apart <= (100 - percent) * (F.col("x_n") + F.col("y_n"))
    ordered = F.struct("x_dn", "x_doc") < F.struct("y_dn", "y_doc")
    met = x.where("x_small").join(y, ["hub", "item"]).where(ordered & (F.col("x_g") != F.col("y_g"))).where(_close_sizes("x_n", "y_n", percent)).where(may)
    return met.select(F.least("x_doc", "y_doc").alias("a"), F.greatest("x_doc", "y_doc").alias("b")).distinct()


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose union sketch (the SKETCH smallest values of both) estimates a similarity within SLACK."""
    one = classes.select(F.col("doc").alias("a"), F.col("sketch").alias("sa"))
    two = classes.select(F.col("doc").alias("b"), F.col("sketch").alias("sb"))
    # hashes are unsigned in numpy and signed here: the order of the sketch is the unsigned one
    rank = lambda v: F.struct((v < 0).alias("s"), v.alias("v"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b").withColumn("u", F.slice(F.array_sort(F.transform(F.array_union("sa", "sb"), rank)), 1, SKETCH)).withColumn("u", F.transform("u", lambda x: x["v"]))
    both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u")))
    return joined.select("a", "b", (both / F.size("u")).alias("estimate")).where(F.col("estimate") >= percent / 100 - SLACK)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have a Jaccard similarity of at least percent / 100."""
    one, two = (sets.select(F.col("doc_id").alias(k), F.col("items").alias(f"{k}_items")) for k in "ab")
    joined = pairs.join(one, "a").join(two, "b").withColumn("i", F.size(F.array_intersect("a_items", "b_items")))
    return joined.where(100 * F.col("i") >= percent * (F.size("a_items") + F.size("b_items") - F.col("i"))).select("a", "b")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs` (doc_id, text): n_shingles, component_id, kept.

    Documents whose sets of n-word shingles (words between blanks, A-Z lower-cased) have a Jaccard similarity of at
    least percent / 100 are linked; the component is the smallest doc_id reachable, and its document is kept. Shingles
    are 64-bit hashes of their words.

    Equal sets are one class from the start. Classes meet in the inverted lists of their rarest retained values. First
    each member of a list is held against its most central member only, and the pair of each class that the union sketch
    rates highest is confirmed on full sets. Members of lists that still hold several components are then looked up by
    the rarest items of their full sets and again held against the most central one; what still differs meets by the rare
    items in which it differs from that one (see `difference_lists`), is filtered by the union sketch and confirmed.
    Components therefore come out as if all pairs had been compared, without writing out or trying the pairs of a large
    group of copies.

    A null, empty or blank text has an empty set: its own component, kept. A null doc_id is returned with a null
    component and not kept. Rows of one doc_id are all returned, with the component of that id (all its texts count as
    linked); an empty table gives no rows; other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = materialise(rows.mapInArrow(_sketcher(n), SKETCHES), "sketches")
    classes = materialise(sketched.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    lists = materialise(inverted_lists(classes, percent), "lists")
    stars = materialise(likely(star_pairs(lists, percent), classes, percent), "stars")
    # lists of two are stars already, so every class that may be asked for is an end of a list
    asked = lists.select("doc").distinct()
    sets = materialise(rows.join(asked, F.col("doc_id") == F.col("doc"), "left_semi").mapInArrow(_setter(n), SETS), "sets")
    ends = stars.select(F.col("a").alias("doc"), "a", "b", "estimate").unionByName(stars.select(F.col("b").alias("doc"), "a", "b", "estimate"))
    best = ends.groupBy("doc").agg(F.max_by(F.struct("a", "b"), F.struct("estimate", F.xxhash64("a", "b"))).alias("p")).select("p.*").distinct()
    first = materialise(confirmed(best, sets, percent), "links")
    groups = materialise(components(first), "groups")
    hubbed = materialise(with_hubs(open_lists(lists, groups, sets, percent), sets), "hubbed")
    near = 100 * F.col("common") >= percent * (F.col("n") + F.col("hub_n") - F.col("common"))
    second = hubbed.where(near & (F.col("doc") != F.col("hub"))).select(F.col("doc").alias("a"), F.col("hub").alias("b")).distinct()
    first = materialise(first.unionByName(second), "links")
    groups = materialise(components(first), "groups")
    split = materialise(cross_pairs(materialise(difference_lists(hubbed, groups, sets, percent), "difference_lists"), percent), "cross")
    third = materialise(confirmed(likely(split, classes, percent), sets, percent), "links")
    # ids of one class, and texts of one id, are links as well
    same = sketched.where("doc_id is not null").join(classes.select("digest", "doc"), "digest").where("doc_id <> doc").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    links = first.unionByName(third)
    whole = materialise(components(links.unionByName(same)), "groups")
    # a doc_id may repeat, so rows with many copies are joined by id, which copies do not share
    placed = sketched.join(whole.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))
