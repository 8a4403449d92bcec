"""Repeated passages: windows of words are counted in the bucket of their minimiser, several windows to one row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import Words, mix, runs_hash, slices, words_of
from tidemark.session import materialise

#: Words of the run whose smallest hash names the bucket of a window.
GRAM = 5
#: Windows of one packed row at most.
LONGEST = 256
#: Minimisers fall into 2**CELL_BITS cells by their leading bits; those of a cell with more packed rows than HOT (about
#: 8 MB, a small task) are counted window by window. Both are fixed, and so are a bucket's size and the table of
#: cells, however large the corpus is.
HOT, CELL_BITS = 50_000, 26

CELLS = "cell int, n long"
PACKED = "minimiser long, doc_id long, text_key int, start int, packed binary"
SINGLE = "high long, low long, doc_id long, text_key int, start int"
RANGES = "doc_id long, text_key int, start int, n int"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:]) if len(values) > step else values[:0]
        have += step
    return values


def _super_kmers(words: Words, hashes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """minimiser, first window and number of windows of each run of windows of one text that share their minimiser."""
    least = _least(runs_hash(hashes, GRAM), span - GRAM + 1)
    last = np.repeat(words.first[1:], np.diff(words.first))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + span <= last)
    if not len(at):
        return least[:0], at, at
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (value[1:] != value[:-1])
    begins = np.flatnonzero(new)
    inside = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
    begins = np.flatnonzero(inside % LONGEST == 0)
    return value[begins], at[begins], np.diff(np.append(begins, len(at)))


def _cells(minimisers: np.ndarray) -> np.ndarray:
    return (minimisers >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _counter(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"))
            cells, n = np.unique(_cells(_super_kmers(words, words.hashes(), span)[0]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(n.astype(np.int64))], names=["cell", "n"])

    return run


def _is_hot(minimisers: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Whether a minimiser's cell is marked in the bits of `hot`."""
    if not len(hot):
        return np.zeros(len(minimisers), bool)
    cells = _cells(minimisers)
    return (hot[cells >> 6] >> (cells & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _places(batch: pa.RecordBatch, words: Words, at: np.ndarray) -> list[pa.Array]:
    """The doc_id and text_key of each word number, and its place within the text."""
    row = np.searchsorted(words.first, at, "right") - 1
    rows = pa.array(row)
    return [batch.column("doc_id").take(rows), batch.column("text_key").take(rows), pa.array((at - words.first[row]).astype(np.int32))]


def _run_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` neighbours, by doubling; the two halves of the last step may overlap."""
    have = 1
    while have < width:
        step = min(have, width - have)
        hashes = mix(hashes[:-step] * np.uint64(0x9E3779B97F4A7C15) + hashes[step:]) if len(hashes) > step else hashes[:0]
        have += step
    return hashes


def _packer(span: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"))
            hashes = words.hashes()
            minimisers, at, n = _super_kmers(words, hashes, span)
            cold = ~_is_hot(minimisers, hot)
            minimisers, at, n = minimisers[cold], at[cold], n[cold]
            upto = np.append(0, np.cumsum(n))
            windows = _run_hash(hashes, span)[np.repeat(at - upto[:-1], n) + np.arange(upto[-1])] if len(at) else hashes[:0]
            packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((upto * 8).astype(np.int32)), pa.py_buffer(windows.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(minimisers.view(np.int64)), *_places(batch, words, at), packed], names=["minimiser", "doc_id", "text_key", "start", "packed"])

    return run


def _window_hash(hashes: np.ndarray, span: int, base: int) -> np.ndarray:
    """A hash of every `span` neighbours from differences of running sums."""
    n = len(hashes)
    up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
    down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)]))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    return mix((sums[span:] - sums[:-span]) * down[: n - span + 1]) if n >= span else hashes[:0]


def _single(span: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"))
            hashes = words.hashes()
            minimisers, at, n = _super_kmers(words, hashes, span)
            chosen = _is_hot(minimisers, hot)
            at, n = at[chosen], n[chosen]
            at = np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())
            high, low = (_window_hash(h, span, base)[at] if len(at) else hashes[:0] for h, base in ((hashes, 0x9E3779B97F4A7C15), (mix(hashes + np.uint64(1)), 0xD1B54A32D192ED03)))
            yield pa.RecordBatch.from_arrays([pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), *_places(batch, words, at)], names=["high", "low", "doc_id", "text_key", "start"])

    return run


def _repeated(group: np.ndarray, packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and offset of each window that stands more than once in the packed rows of its group. Sorting brings equal
    hashes together."""
    packed = packed.cast(pa.large_binary())
    ends = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
    window = np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint64)
    n = np.diff(ends) // 8
    row = np.repeat(np.arange(len(packed)), n)
    order = np.lexsort((window, group[row]))
    same = np.flatnonzero((window[order[1:]] == window[order[:-1]]) & (group[row[order[1:]]] == group[row[order[:-1]]]))
    again = np.zeros(len(window), bool)
    again[order[same]] = again[order[same + 1]] = True
    hit = np.flatnonzero(again)
    return row[hit], hit - (np.cumsum(n) - n)[row[hit]]


def _bucket():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by minimiser. The last group of a batch may go on in the next, so it waits; a group has no
        more rows than the bound on minimisers that are not hot."""
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            keys = table.column("minimiser").to_numpy()
            other = np.flatnonzero(keys != keys[-1:])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from _ranges(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield from _ranges(rest)

    return run


def _ranges(table: pa.Table) -> Iterator[pa.RecordBatch]:
    one = table.combine_chunks().to_batches()[0]
    keys = one.column("minimiser").to_numpy()
    row, offset = _repeated(np.cumsum(np.append(False, keys[1:] != keys[:-1])), one.column("packed"))
    if not len(row):
        return
    new = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(offset) != 1)))
    first = row[new]
    start = one.column("start").to_numpy()[first] + offset[new]
    of = [one.column(c).take(pa.array(first)) for c in ("doc_id", "text_key")]
    yield pa.RecordBatch.from_arrays([*of, pa.array(start.astype(np.int32)), pa.array(np.diff(np.append(new, len(row))).astype(np.int32))], names=["doc_id", "text_key", "start", "n"])


def _cutter(span: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"))
            texts = batch.column("text").to_pylist()
            out = []
            for k, ranges in enumerate(batch.column("ranges").to_pylist()):
                n = int(words.first[k + 1] - words.first[k])
                parts = (texts[k] or "").encode().split()
                if ranges:
                    cover = np.zeros(n + 1, np.int64)
                    starts = np.fromiter((r["start"] for r in ranges), np.int64)
                    ends = starts + np.fromiter((r["n"] for r in ranges), np.int64) + span - 1
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, ends, -1)
                    kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
                    parts = [parts[i] for i in kept.tolist()]
                text = b" ".join(parts)
                out.append((n, n - len(parts), hashlib.sha256(text).hexdigest(), text.decode() if keep_text else None))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text, given_id: what tells a row from every other text. A row without an id goes by two hashes of
    its text, one with an id by the id and a hash of its text."""
    text = F.coalesce("text", F.lit(""))
    given = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(given, F.xxhash64(text)).alias("doc_id"), F.hash(text).alias("text_key"), "text", given.alias("given_id"))


def hot_cells(rows: DataFrame, span: int) -> np.ndarray:
    """The cells of more than HOT packed rows as bits of 64-bit words; empty if there are none. At most
    2**(CELL_BITS - 6) words reach the driver."""
    counts = rows.mapInArrow(_counter(span), CELLS).groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > HOT)
    bits = counts.groupBy(F.shiftright("cell", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cell & 63))").alias("bits")).collect()
    if not bits:
        return np.zeros(0, np.uint64)
    out = np.zeros(1 << (CELL_BITS - 6), np.int64)
    out[[r["at"] for r in bits]] = [r["bits"] for r in bits]
    return out.view(np.uint64)


def repeated_ranges(rows: DataFrame, span: int) -> DataFrame:
    """doc_id, text_key, start, n: runs of n windows, each of which also starts elsewhere. `rows` as `named` gives them."""
    rows = rows.select("doc_id", "text_key", "text")
    hot = hot_cells(rows, span)
    packed = rows.mapInArrow(_packer(span, hot), PACKED)
    cold = packed.repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(_bucket(), RANGES)
    if not len(hot):
        return cold
    single = rows.mapInArrow(_single(span, hot), SINGLE)
    twice = materialise(single.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1").select("high", "low"), "twice")
    return cold.unionByName(single.join(twice, ["high", "low"]).select("doc_id", "text_key", "start", F.lit(1).alias("n")))


def remove_repeats(docs: DataFrame, span: int = 35, keep_text: bool = True) -> DataFrame:
    """One row per row of `docs` (doc_id, text): n_words, n_removed, kept_sha256 and, with `keep_text`, kept_text.

    A word goes if a window of `span` consecutive words covers it whose word sequence also starts anywhere else, in the
    same document or another; all windows are judged on the input. Words are runs of characters between blanks.

    Consecutive windows whose smallest GRAM-word hash is the same travel to that hash's bucket as one packed row of their
    64-bit hashes, about a third of the words they cover; there all windows are sorted and counted, and two are equal if
    both hashes, the bucket's and their own, are. The rows of a minimiser that very many texts share would all meet in one task: such minimisers are counted first, and their windows (by 128-bit hashes, summed before
    the shuffle) go to as many tasks as there are.

    Null, empty and short texts have no window and keep all words; a very long text is cut in one task. Every row is an
    occurrence of its own, so equal rows remove each other; rows that share an id, or have none, are told apart by their
    texts. An empty table gives no rows; other columns are ignored."""
    rows = named(docs)
    ranges = materialise(repeated_ranges(rows, span), "ranges")
    # as many ranges as the windows of one text; copies of one row find the same ones
    per = ranges.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "n")).alias("ranges"))
    marked = rows.join(per.hint("merge"), ["doc_id", "text_key"], "left")
    return marked.select(F.col("given_id").alias("doc_id"), "text", "ranges").mapInArrow(_cutter(span, keep_text), RESULT)
