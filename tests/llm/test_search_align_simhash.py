"""Ranked search, tokenizer alignment and SimHash: against plain versions and odd tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import brute
from tidemark.llm import queries, ranked_search, simhash, token_align

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


# ranked search (11)

def ranked(docs, items, k):
    """(item, rank, doc, score) of every item, from full scores."""
    def terms(t):
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    held = [(d, collections.Counter(terms(t)), len(terms(t))) for d, t in docs]
    n, total = sum(x[2] > 0 for x in held), sum(x[2] for x in held)
    df = collections.Counter(t for x in held for t in x[1])
    out = []
    for item in {i for i, _ in items}:
        asked = {t for i, text in items if i == item for t in terms(text)}
        scores = []
        for d, tf, size in held:
            m = 100 - 90 + 90 * size * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in asked if tf[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def test_search_equals_full_scores(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "ñ", "x1"]
    text = lambda n: " ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(700)] + [(None, text(20)), (3, text(9)), (3, text(9))]
    docs += [(1000 + i, "w50 tied text") for i in range(40)]  # equal scores go by id
    items = [(i, text(6)) for i in range(25)] + [(90, "w50 tied"), (91, "absent"), (92, None), (None, "w7 w9"), (5, "w40 W41"), (93, "")]
    monkeypatch.setattr(ranked_search, "FIRST_DEPTH", 4)
    got = ranked_search.search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, "item_id long, text string"), 10)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == ranked(docs, items, 10)


def test_search_of_many_items_in_blocks(spark, monkeypatch):
    docs = [(i, f"a{i % 7} b{i % 11} c") for i in range(80)]
    items = [(i, f"a{i % 9} b{i % 5}") for i in range(30)]
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 8)
    got = ranked_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), 3)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == ranked(docs, items, 3)


def block_of(rows, weights, sizes):
    doc, term, tf = (np.array(x) for x in zip(*rows))
    import pyarrow as pa
    return ranked_search.Block(pa.array(range(len(sizes))), np.array(sizes), doc, term, tf, np.array(weights), len(sizes), int(sum(sizes)))


def test_reading_stops_early_at_best_positions():
    rng = np.random.default_rng(1)
    rows = [(d, t, int(rng.integers(1, 9))) for d in range(5000) for t in range(3) if (d < 12) or rng.random() < 0.6]
    rows = [(d, t, 40 if d < 12 else tf) for d, t, tf in rows]
    block = block_of(rows, [900, 700, 500], [50] * 5000)
    best = ranked_search.Best(10)
    looked = block.search(np.array([0, 1, 2]), best)
    assert looked < 1000 and best.doc.tolist() == list(range(10))
    assert not block.met.any()


def test_vocabulary_finds_each_term():
    hashes = np.random.default_rng(2).integers(0, 1 << 63, 300_000).astype(np.uint64)
    known = ranked_search.Vocabulary(hashes[:150_000])
    numbers = known.numbers(hashes)
    assert (known.hashes[numbers[:150_000]] == hashes[:150_000]).all() and (numbers[150_000:] == -1).all()


def test_search_of_odd_tables(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "..."), (4, "w1 w2"), (4, "w1 w2"), (None, "w1")], DOCS).withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1)).withColumn("item", F.lit("x"))
    items = spark.createDataFrame([(1, "w1, W2"), (2, None), (3, long)], "item_id long, text string").withColumn("item", F.lit("clash"))
    got = [tuple(r) for r in ranked_search.search(docs, items).orderBy("item_id", "rank").collect()]
    assert got == sorted(ranked([(1, long), (2, None), (3, ""), (4, "..."), (4, "w1 w2"), (4, "w1 w2"), (None, "w1")], [(1, "w1, W2"), (2, None), (3, long)], 10), key=lambda r: r[:2])
    assert ranked_search.search(docs.limit(0), items).isEmpty() and ranked_search.search(docs, items.limit(0)).isEmpty()


# tokenizer alignment (12)

def aligned(rows):
    """The contract in plain words: one tuple per row."""
    one, two = (token_align.load(f"{token_align.FOLDER}/{f}") for f in (token_align.BYTE_LEVEL, token_align.PIECES))
    each, counts = [], collections.Counter()
    for i, text in rows:
        a, b = (one.encode([text])[0], two.encode([text])[0]) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(one.bytes[x] for x in a) != whole or b"".join(two.bytes[x] for x in b) != whole:
            a, b = [], []
        ends_a, ends_b = ([sum(len(t.bytes[y]) for y in ids[: k + 1]) for k in range(len(ids))] for t, ids in ((one, a), (two, b)))
        links = [(x, y) for x, e in zip(a, ends_a) for y, g in zip(b, ends_b) if e == g]
        groups, low = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append(",".join(str(x) for x, e in zip(a, ends_a) if low < e <= cut) + "|" + ",".join(str(y) for y, e in zip(b, ends_b) if low < e <= cut))
            low = cut
        counts.update(links)
        each.append((i, a, b, groups, links))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(i, len(a), len(b), len(g), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, links in each]


TEXTS = ["Plain words, and more words.", "été ñandú 😀 Σ", "<|endoftext|> and <s> in text", "", None, "▁piece mark", "  two  blanks\n\nlines\t", "a", "中文字符 mixed 123456", "\x00 control \x7f", "aaaaaaaaaaaaaaaa", "words words words", "ﬁ ligature Å"]


def test_alignment_equals_plain_version(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (1, "again the id"), (1, "again the id")]
    got = token_align.align_tokenizers(spark.createDataFrame(rows, DOCS).repartition(3))
    assert sorted(map(tuple, got.drop("groups").collect()), key=repr) == sorted(aligned(rows), key=repr)
    texts = {r.doc_id: r for r in got.collect()}
    assert hashlib.sha256(texts[0].groups.encode()).hexdigest() == texts[0].groups_sha256


def test_alignment_query_equals_plain_version(spark):
    rows = [tuple(r) for r in queries.table(spark, SMALL, "documents").select("doc_id", "text").where("length(text) < 900").limit(60).collect()]
    got = token_align.align_tokenizers(spark.createDataFrame(rows, DOCS), keep_groups=False).drop("groups")
    assert sorted(map(tuple, got.collect())) == sorted(aligned(rows))
    whole = queries.QUERIES["op12_token_alignment"](spark, SMALL)
    assert whole.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert whole.where("n_links > 0 and n_best > n_links or n_groups > least(n_a, n_b)").isEmpty() and whole.count() == 200


def test_alignment_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "word " * 100_000), (2, None)], DOCS).withColumn("pairs", F.lit("clash")).withColumn("n_a", F.lit("clash"))
    got = {r.doc_id: r for r in token_align.align_tokenizers(docs).collect()}
    assert got[1].n_a >= 100_000 and got[1].n_groups == got[1].n_links and got[2].n_a == 0 and got[2].groups_sha256 == ""
    assert token_align.align_tokenizers(docs.limit(0)).isEmpty()


# SimHash (13)

def fingerprint(text, n=3):
    w = brute.words(text, lower=True)
    grams = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhashes(rows, distance=3):
    """(id, fingerprint, smallest id reachable) from all pairs."""
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, f"{prints[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


def edited(rng, base, n):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
        out.append(" ".join(w))
    return out


def test_simhash_equals_all_pairs(spark):
    rng = random.Random(8)
    texts = [t for _ in range(4) for t in edited(rng, [f"v{rng.randrange(900)}" for _ in range(rng.randrange(60, 300))], 90)]
    texts += ["", None, "one", "two words", "Two\tWORDS", " \n", "été", "a b c", "same copy of it"] * 2
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, texts[0]), (2, "twice"), (2, "two texts")]
    got = simhash.simhash_duplicates(spark.createDataFrame(rows, DOCS).repartition(6).withColumn("component", F.lit("clash")).withColumn("least", F.lit("clash")))
    assert sorted(map(tuple, got.collect()), key=repr) == simhashes(rows)


@pytest.mark.parametrize("distance", [1, 3])
def test_lists_find_every_near_pair(spark, monkeypatch, distance):
    """Flipping bits in long lists gives what comparing pairs gives, and both what all pairs give."""
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 1 << 62))
    prints = sorted({centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False)) for _ in range(400)})
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fingerprint long")
    near = {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= distance}

    def reach(links):
        root = {p: p for p in prints}
        for _ in range(len(prints)):
            new = dict(root)
            for a, b in links:
                new[a] = new[b] = min(new[a], new[b])
            if new == root:
                return root
            root = new

    for pairwise in (2048, 1):
        monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
        lists = simhash.byte_lists(frame, 8 - distance).repartition("positions", "value").sortWithinPartitions("positions", "value", "fingerprint")
        # links are made in this process, so that the changed bound holds
        batches = lists.select("positions", "fingerprint").orderBy("positions", "value", "fingerprint").toArrow().to_batches(max_chunksize=97)
        found = {(a & (1 << 64) - 1, b & (1 << 64) - 1) for out in simhash._linker(8 - distance, distance)(iter(batches)) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist())}
        assert reach(found) == reach(near)


def test_links_grow_with_the_members_of_a_group(spark):
    rng = random.Random(3)
    sizes = []
    for m in (400, 800):
        docs = spark.createDataFrame(list(enumerate(edited(rng, [f"v{i}" for i in range(400)], m))), DOCS)
        prints = docs.mapInArrow(simhash._printer(3), simhash.PRINTS).select("fingerprint").distinct()
        lists = simhash.byte_lists(prints, 5).repartition("positions", "value").sortWithinPartitions("positions", "value", "fingerprint")
        sizes.append((prints.count(), lists.select("positions", "fingerprint").mapInArrow(simhash._linker(5, 3), simhash.LINKS).count()))
    assert all(links <= 56 * n for n, links in sizes)


def test_simhash_of_odd_tables(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(300_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (None, None)], DOCS).withColumn("fingerprint", F.lit("clash"))
    got = {r.doc_id: r for r in simhash.simhash_duplicates(docs).collect()}
    assert got[2].component_id == 1 and got[None].fingerprint == "0" * 16 and got[None].component_id is None
    assert simhash.simhash_duplicates(docs.limit(0)).isEmpty()
    with pytest.raises(ValueError):
        simhash.simhash_duplicates(docs, distance=8)


def test_simhash_query_equals_all_pairs(spark):
    rows = [tuple(r) for r in queries.table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op13_simhash_duplicates"](spark, SMALL).collect()), key=repr) == simhashes(rows)
