"""Ranked lexical search by the Best Position Algorithm over impact lists of blocks of documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import slices, words_of
from tidemark.session import materialise

#: Scores in whole numbers: the terms' weights, the scale of a term's share, and how a document's length counts.
WEIGHT_SCALE, SHARE_SCALE, COUNT_SCALE, LENGTH_SCALE = 1000, 1_000_000_000, 1000, 8
FLAT, SLOPE = 10, 90
#: Documents are searched in blocks of about so many postings; positions read from each list in a round, at first.
BLOCK_POSTINGS, FIRST_DEPTH = 2_000_000, 64
#: Look-ups made at once.
LOOKUPS = 2_000_000
#: Items are searched in blocks of so many, which are sent to the tasks; further blocks read the documents again.
BLOCK_ITEMS = 5_000

_APART = np.ones(256, bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

COUNTS = "term int, n long"
HITS = "item int, doc_id long, score long"


class Vocabulary:
    """Numbers of the terms that any item holds, looked up by hash."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes)
        # a table of the leading bits finds the first candidate, so most words are settled by one look
        self.shift = np.uint64(64 - 16)
        self.firsts = np.searchsorted(self.hashes, np.arange((1 << 16) + 1, dtype=np.uint64) << self.shift)
        self.firsts[-1] = len(self.hashes)

    def __len__(self) -> int:
        return len(self.hashes)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where no item holds it."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        lead = (hashes >> self.shift).astype(np.int64)
        at, end = self.firsts[lead], self.firsts[lead + 1]
        out = np.full(len(hashes), -1)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            here = at[open_]
            hit = self.hashes[here] == hashes[open_]
            out[open_[hit]] = here[hit]
            at[open_] += 1
            open_ = open_[~hit & (here + 1 < end[open_])]
        return out


def postings(batch: pa.RecordBatch, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each document, document, term, tf): a posting for each term of an item that a document holds."""
    words = words_of(batch.column("text"), _APART)
    sizes = np.diff(words.first)
    numbers = vocabulary.numbers(words.hashes(lower=True))
    held = np.flatnonzero(numbers >= 0)
    doc = np.repeat(np.arange(batch.num_rows), sizes)[held]
    keys, tf = np.unique(doc * max(len(vocabulary), 1) + numbers[held], return_counts=True)
    return sizes, keys // max(len(vocabulary), 1), keys % max(len(vocabulary), 1), tf


def _counter(vocabulary: Vocabulary):
    """Documents that hold each term; under -1 the documents that hold any, under -2 all terms with repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in slices(batches, "text"):
            sizes, _, term, _ = postings(batch, vocabulary)
            df += np.bincount(term, minlength=len(vocabulary))
            n += int(np.count_nonzero(sizes))
            total += int(sizes.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([held, [-1, -2]]), pa.int32()), pa.array(np.concatenate([df[held], [n, total]]))], names=["term", "n"])

    return run


class Best:
    """The k best (score, doc_id) so far, equal scores by ascending id, ids that are null last."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.doc, self.unnamed = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, unnamed: np.ndarray) -> None:
        score, doc, unnamed = np.concatenate([self.score, score]), np.concatenate([self.doc, doc]), np.concatenate([self.unnamed, unnamed])
        best = np.lexsort((doc, unnamed, -score))[: self.k]
        self.score, self.doc, self.unnamed = score[best], doc[best], unnamed[best]

    def kth(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0


class Block:
    """Impact lists of one block of documents: the postings of each term by falling impact, and a direct way from a
    document and a term to its impact and its position in the term's list."""

    def __init__(self, ids: pa.Array, sizes: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, n: int, total: int) -> None:
        self.unnamed = np.asarray(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy()
        self.terms, self.keys = len(weights), doc * len(weights) + term
        length = FLAT + SLOPE * sizes[doc] * n // total if total else np.zeros(0, np.int64)
        self.impact = weights[term] * (SHARE_SCALE * tf // (COUNT_SCALE * tf + LENGTH_SCALE * length))
        self.order = np.lexsort((doc, -self.impact, term))
        self.starts = np.searchsorted(term[self.order], np.arange(len(weights) + 1))
        self.position = np.empty(len(term), np.int64)
        self.position[self.order] = np.arange(len(term)) - self.starts[term[self.order]]
        self.docs, self.sorted_impact = doc[self.order], self.impact[self.order]
        self.met = np.zeros(len(self.ids), bool)

    def direct(self, docs: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(held, posting) of each document and term."""
        wanted = docs[:, None] * self.terms + terms[None, :]
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return self.keys[at] == wanted, at

    def search(self, terms: np.ndarray, best: Best) -> int:
        """Add this block's documents that can be among the best. Returns how many were looked at.

        All lists are read in parallel. Each document met is looked up in every list, which gives its score and the
        positions it has in them. The best position of a list is the last one up to which all are seen, whether by
        reading or by a look-up; a document not met yet scores at most the sum of the impacts there. Reading stops when
        that sum is strictly below the k-th score, as an equal score may win by its id."""
        lists = terms[self.starts[terms + 1] > self.starts[terms]]
        if not len(lists):
            return 0
        starts, lengths = self.starts[lists], self.starts[lists + 1] - self.starts[lists]
        base = np.cumsum(lengths + 1) - (lengths + 1)
        seen = np.zeros(int(base[-1] + lengths[-1] + 1), bool)
        reached, depth, step, touched = np.zeros(len(lists), np.int64), 0, FIRST_DEPTH, []
        while True:
            new = np.unique(np.concatenate([self.docs[a + depth : a + min(n, depth + step)] for a, n in zip(starts, lengths)]))
            new = new[~self.met[new]]
            if len(new):
                self.met[new] = True
                touched.append(new)
                rows = max(1, LOOKUPS // len(lists))
                for part in (new[i : i + rows] for i in range(0, len(new), rows)):
                    held, at = self.direct(part, lists)
                    seen[(base[None, :] + self.position[at])[held]] = True
                    score = np.where(held, self.impact[at], 0).sum(axis=1)
                    good = (score > 0) & (score >= best.kth())
                    best.add(score[good], self.ids[part[good]], self.unnamed[part[good]])
            depth, step = depth + step, step * 2
            for i, (b, n) in enumerate(zip(base, lengths)):
                # the place after a list's end is never seen
                reached[i] += np.argmin(seen[b + reached[i] : b + n + 1])
            bound = self.sorted_impact[starts + np.maximum(reached - 1, 0)][reached < lengths].sum()
            if bound < best.kth() or (reached == lengths).all():
                break
        for docs in touched:
            self.met[docs] = False
        return sum(map(len, touched))


def _searcher(vocabulary: Vocabulary, items: list[np.ndarray], weights: np.ndarray, n: int, total: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best(k) for _ in items]
        parts: list[tuple] = []

        def close() -> None:
            rows = np.cumsum([0, *(len(p[1]) for p in parts)])
            ids = pa.concat_arrays([p[0] for p in parts])
            doc = np.concatenate([p[2] + r for p, r in zip(parts, rows)])
            block = Block(ids, *(np.concatenate([p[1] for p in parts]), doc, *(np.concatenate([p[c] for p in parts]) for c in (3, 4))), weights, n, total)
            for terms, best in zip(items, found):
                block.search(terms, best)
            parts.clear()

        for batch in slices(batches, "text"):
            parts.append((batch.column("doc_id").cast(pa.int64()), *postings(batch, vocabulary)))
            if sum(len(p[2]) for p in parts) >= BLOCK_POSTINGS:
                close()
        if parts:
            close()
        for i, best in enumerate(found):
            if len(best.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best.score), i, np.int32)), pa.array(best.doc, mask=best.unnamed), pa.array(best.score)], names=["item", "doc_id", "score"])

    return run


def _search_block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The hits of one block of items: the statistics of their terms over all documents, then each task's best."""
    spark = docs.sparkSession
    asked = items.orderBy(F.col("item_id").asc_nulls_first()).toArrow()
    names, texts = asked.column("item_id"), asked.column("texts").to_pylist()
    split = [words_of(pa.array(t or [""], pa.large_string()), _APART).hashes(lower=True) for t in texts]
    vocabulary = Vocabulary(np.concatenate([*split, np.zeros(0, np.uint64)]))
    counted = {r.term: r.n for r in docs.mapInArrow(_counter(vocabulary), COUNTS).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, total = counted.get(-1, 0), counted.get(-2, 0)
    weights = np.array([math.floor(WEIGHT_SCALE * math.log((2 * n + 2) / (2 * counted.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    numbers = [np.unique(vocabulary.numbers(s)) for s in split]
    hits = docs.mapInArrow(_searcher(vocabulary, numbers, weights, n, total, k), HITS)
    known = spark.createDataFrame(pa.table({"item": pa.array(range(len(names)), pa.int32()), "item_id": names}))
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.join(known, "item").select("item_id", "rank", "doc_id", "score")


def item_block(item_id: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(item_id), F.lit(blocks))


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of `docs` (doc_id, text) with the highest score above 0 for each item
    of `items` (item_id, text); all, if there are fewer. Equal scores go by ascending doc_id.

    Terms are runs of ASCII letters, digits and characters from U+0080 on, A-Z in lower case. With N documents that hold
    a term, L terms in all and n terms in a document, a term of document frequency df weighs floor(1000 * ln((2N + 2) /
    (2df + 1))), and a document scores the sum of weight * (10**9 * tf div (1000 * tf + 8 * (10 + 90 * n * N div L)))
    over an item's distinct terms.

    A task keeps the impact lists of its own documents, a block at a time, and its k best of each item, which carry over
    to its next blocks; the Best Position Algorithm decides how far a block's lists are read. Only these k a task and the
    statistics of the items' terms are shuffled, never postings. Items go to the tasks in blocks of at most about
    BLOCK_ITEMS, so any number of them is searched, with one more reading of the documents for each block.

    Null, empty and term-less texts match nothing and do not count in N. Very long texts are read whole. Rows that repeat
    a doc_id are documents of their own; a row of a null doc_id counts and is ranked, after equal scores with an id.
    Rows that share an item_id (null is one as well) are one item of all their terms, an item without terms has no rows;
    empty tables give no rows; other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = items.groupBy("item_id").agg(F.collect_set("text").alias("texts"))
    blocks = max(1, -(-items.select("item_id").distinct().count() // BLOCK_ITEMS))
    if blocks == 1:
        return _search_block(rows, asked, k)
    asked = materialise(asked, "items")
    out = None
    for b in range(blocks):
        # each block's hits are written, so that the plan does not grow with the items
        found = materialise(_search_block(rows, asked.where(item_block(F.col("item_id"), blocks) == b), k), "hits")
        out = found if out is None else out.unionByName(found)
    return out
