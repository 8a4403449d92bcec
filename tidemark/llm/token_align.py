"""Alignment of two tokenizers over the same texts: their tokens are cut into groups at the byte offsets where both end."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import slices
from tidemark.session import materialise

#: Folder of the vocabulary files, and the two that the query compares.
FOLDER, BYTE_LEVEL, PIECES = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pairs array<long>, times array<long>"
SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, groups_sha256 string"
PAIRS = "pair long, n long"


class ByteLevel:
    """A byte-level BPE vocabulary; special tokens inside a text are plain text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte_of = _byte_level()
        self.bytes = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A piece vocabulary with byte fallback, which puts a space before the text itself."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.tokenizer = SentencePieceProcessor(model_file=path)
        every = range(self.tokenizer.get_piece_size())
        name = self.tokenizer.id_to_piece
        self.bytes = [bytes([int(name(i)[3:5], 16)]) if self.tokenizer.is_byte(i) else name(i).replace("▁", " ").encode() for i in every]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.tokenizer.encode(texts, num_threads=1)


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable bytes are themselves, the others follow
    from U+0100 on in their order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(moved)}


@lru_cache(maxsize=8)
def load(path: str):
    """The tokenizer of a file, once for each Python worker."""
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


def common_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the tokens of both lists that end at a byte offset where both have an end: the ends of one, in order, are
    looked up in the end-to-index dictionary of the other, so the shared keys come sorted. Every token has a byte, so no
    two of a list end together."""
    at_b = dict(zip(ends_b.tolist(), range(len(ends_b))))
    found = np.fromiter(map(at_b.get, ends_a.tolist(), repeat(-1)), np.int64, len(ends_a))
    cut_a = np.flatnonzero(found >= 0)
    return cut_a, found[cut_a]


def align(a: list[int], b: list[int], size_a: np.ndarray, size_b: np.ndarray) -> tuple[list[tuple[list[int], list[int]]], list[tuple[int, int]]]:
    """(groups, links) of two id lists over the same bytes: the common cuts slice both into groups, and in each the tokens
    that end together are linked."""
    cut_a, cut_b = common_cuts(np.cumsum(size_a[a]), np.cumsum(size_b[b]))
    groups, from_a, from_b = [], 0, 0
    for to_a, to_b in zip((cut_a + 1).tolist(), (cut_b + 1).tolist()):
        groups.append((a[from_a:to_a], b[from_b:to_b]))
        from_a, from_b = to_a, to_b
    return groups, [(x[-1], y[-1]) for x, y in groups]


class GroupWriter:
    """Writes groups as `a1,a2|b1;a3|b2,b3`: every token is a string with the mark that follows it."""

    def __init__(self, n_a: int, n_b: int) -> None:
        self.a, self.b = (np.array([[f"{i}{m}" for i in range(n)] for m in marks], object) for n, marks in ((n_a, ",|"), (n_b, ",;")))

    def write(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
        out = np.empty(len(a) + len(b), object)
        for ids, own, other, table, first in ((a, cut_a, cut_b, self.a, 0), (b, cut_b, cut_a, self.b, 1)):
            group = np.searchsorted(own, np.arange(len(ids)))
            last = np.zeros(len(ids), np.int64)
            last[own] = 1
            # what the other list has put before: its groups up to this one, this one included for the second list
            before = np.concatenate([[0], other + 1])[group + first]
            out[np.arange(len(ids)) + before] = table[last, ids]
        return "".join(out.tolist())[:-1]


def _aligner(path_a: str, path_b: str, keep_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = load(path_a), load(path_b)
        size_a, size_b = (np.array([len(x) for x in t.bytes]) for t in (one, two))
        writer = GroupWriter(len(one.bytes), len(two.bytes))
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = []
            for text, a, b in zip(texts, one.encode(texts), two.encode(texts)):
                whole = (" " + text).encode()
                if not text or any(b"".join(map(t.bytes.__getitem__, ids)) != whole for t, ids in ((one, a), (two, b))):
                    rows.append((0, 0, 0, 0, "", "", [], []))
                    continue
                a, b = np.array(a), np.array(b)
                cut_a, cut_b = common_cuts(np.cumsum(size_a[a]), np.cumsum(size_b[b]))
                pairs, times = np.unique(a[cut_a] * len(two.bytes) + b[cut_b], return_counts=True)
                written = writer.write(a, b, cut_a, cut_b)
                rows.append((len(a), len(b), len(cut_a), len(cut_a), written if keep_groups else None, hashlib.sha256(written.encode()).hexdigest(), pairs, times))
            n_a, n_b, n_groups, n_links, groups, digests, pairs, times = zip(*rows)
            longs = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *longs, pa.array(groups, pa.string()), pa.array(digests, pa.string()), pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "pairs", "times"])

    return run


def _summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    each, at = np.unique(pairs, return_inverse=True)
    out = np.zeros(len(each), np.int64)
    np.add.at(out, at, times)
    return each, out


def _pair_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        flat = [batch.column(c).flatten().to_numpy() for c in ("pairs", "times")]
        pairs, times = _summed(np.concatenate([pairs, flat[0]]), np.concatenate([times, flat[1]]))
    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], names=["pair", "n"])


def _scorer(pairs: np.ndarray, counts: np.ndarray, best: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("pairs")
            flat, times = column.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
            at = np.searchsorted(pairs, flat)
            sums = []
            for value in (best[at].astype(np.int64), counts[at]):
                out = np.zeros(batch.num_rows, np.int64)
                np.add.at(out, row, value * times)
                sums.append(pa.array(out))
            kept = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*kept, *sums, batch.column("groups"), batch.column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256"])

    return run


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n: how many links of all documents hold each pair of ids."""
    return aligned.select("pairs", "times").mapInArrow(_pair_counter, PAIRS).groupBy("pair").agg(F.sum("n").alias("n"))


def align_tokenizers(docs: DataFrame, path_a: str = "", path_b: str = "", keep_groups: bool = True) -> DataFrame:
    """One row per row of `docs` (doc_id, text): n_a, n_b (tokens), n_groups, n_links, n_best, count_sum, groups
    (`a1,a2|b1;a3|b2,b3`, null without `keep_groups`), groups_sha256.

    `path_a` is a byte-level vocabulary that reads a space and the text, `path_b` a piece vocabulary that adds the space
    itself; files ending in .model are pieces. Byte offsets where tokens of both end cut the token lists into groups, and
    the tokens that end together are linked. count_sum adds up, over a document's links, how many links of the corpus
    hold the same pair of ids; n_best counts the links whose pair is the most frequent one of its second id, ties
    included.

    A text is encoded once; its pairs are written with it, counted per task, summed, and looked up again. Of two linked
    tokens one ends the other's bytes, so there are at most as many pairs as bytes in both vocabularies (below a million
    for the default ones, whatever the corpus): the table of pairs fits a task.

    Texts that are null, empty, or that either tokenizer does not give back byte for byte (a text with U+2581, say) have
    no tokens: zeros, and empty groups and digest. A very long text is encoded whole, in one task. Rows that repeat an id
    or have none are rows of their own; an empty table gives no rows; other columns are ignored."""
    path_a, path_b = path_a or str(Path(FOLDER, BYTE_LEVEL)), path_b or str(Path(FOLDER, PIECES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    aligned = materialise(rows.mapInArrow(_aligner(path_a, path_b, keep_groups), ALIGNED), "aligned")
    table = pair_counts(aligned).toArrow()
    pairs, counts = (table.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pairs)
    pairs, counts = pairs[order], counts[order]
    second = pairs % len(load(path_b).bytes)
    most = np.zeros(len(load(path_b).bytes), np.int64)
    np.maximum.at(most, second, counts)
    return aligned.mapInArrow(_scorer(pairs, counts, counts == most[second]), SCORED)
