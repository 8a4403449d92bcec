"""SimHash near duplicates: fingerprints meet in an inverted index of their bytes, byte matches are tallied, bits verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.words import lowered, slices, words_of
from tidemark.session import materialise

BITS, BYTES = 64, 8
SEED = 42
#: Lists up to this length are compared pair by pair, longer ones by flipping bits, which costs about as much a member.
PAIRWISE = 2048
#: Links of a batch that are held before they are thinned to a forest.
MOST_LINKS = 1_000_000

PRINTS = "doc_id long, fingerprint long"
LINKS = "a long, b long"


def fingerprints(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """The fingerprint of each text: a bit is 1 if set in over half of the hashes of its n-word shingles, repeats
    included; a shorter text is one shingle, a text without words has fingerprint zero."""
    words = words_of(batch.column("text"))
    data = lowered(words.data).tobytes()
    starts, ends = words.starts, words.ends
    # neighbours with one space between them are their shingle already; others are put together word by word
    plain = np.ones(len(starts), bool)
    plain[1:] = (starts[1:] - ends[:-1] == 1) & (words.data[ends[:-1]] == 0x20)
    digest, a, b = xxhash.xxh64_intdigest, starts.tolist(), ends.tolist()

    def shingle(i: int, j: int) -> bytes:
        return data[a[i] : b[j]] if plain[i + 1 : j + 1].all() else b" ".join(data[x:y] for x, y in zip(a[i : j + 1], b[i : j + 1]))

    out = np.zeros(batch.num_rows, np.uint64)
    for row, (first, end) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
        if first == end:
            continue
        size = min(n, end - first)
        if plain[first + 1 : end].all():
            hashes = [digest(data[x:y], SEED) for x, y in zip(a[first : end - size + 1], b[first + size - 1 : end])]
        else:
            hashes = [digest(shingle(i, i + size - 1), SEED) for i in range(first, end - size + 1)]
        out[row] = _majority(np.array(hashes, np.uint64))
    return out


def _majority(hashes: np.ndarray) -> np.uint64:
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]


def _printer(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fingerprints(batch, n).view(np.int64))], names=["doc_id", "fingerprint"])

    return run


def byte_lists(prints: DataFrame, matches: int) -> DataFrame:
    """positions, value, fingerprint: each fingerprint in the list of every choice of `matches` byte positions and of the
    bytes it has there. Lists of one position would hold a share of all fingerprints each, so a list stands for as many
    positions as a similar pair is sure to share, and holds only pairs whose tally reaches them."""
    chosen = F.array(*[
        F.struct(F.lit(i).cast("short").alias("positions"), F.col("fingerprint").bitwiseAND(F.lit(_mask(places))).alias("value"))
        for i, places in enumerate(combinations(range(BYTES), matches))])
    return prints.select("fingerprint", F.explode(chosen).alias("x")).select("x.positions", "x.value", "fingerprint")


def _mask(places: tuple[int, ...]) -> int:
    mask = sum(0xFF << 8 * p for p in places)
    return mask - (1 << 64) if mask >> 63 else mask


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many byte positions each pair shares."""
    other = a ^ b
    return sum(((other >> np.uint64(8 * p)) & np.uint64(0xFF) == 0).astype(np.int8) for p in range(BYTES))


class _Reached:
    """Links between n members, kept as a forest once they are many: who is linked is all that counts."""

    def __init__(self, n: int) -> None:
        self.n, self.size, self.a, self.b = n, 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.size += len(a)
        if self.size > max(MOST_LINKS, 2 * self.n):
            root = self.least()
            moved = np.flatnonzero(root != np.arange(self.n))
            self.a, self.b, self.size = [moved], [root[moved]], len(moved)

    def least(self) -> np.ndarray:
        """The first of the members that each one reaches."""
        a, b, root = np.concatenate(self.a), np.concatenate(self.b), np.arange(self.n)
        while True:
            low, new = np.minimum(root[a], root[b]), root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                return root
            root = new


def _pairwise(rows: np.ndarray, groups: np.ndarray, prints: np.ndarray, matches: int, distance: int, found: _Reached) -> None:
    """The pairs of `rows` inside equal neighbours of `groups` that share enough bytes and differ in few enough bits."""
    groups, prints = groups[rows], prints[rows]
    left, step = np.arange(len(rows)), 1
    while True:
        left = left[left + step < len(rows)]
        left = left[groups[left] == groups[left + step]]
        if not len(left):
            return
        near = left[tally(prints[left], prints[left + step]) >= matches]
        near = near[np.bitwise_count(prints[near] ^ prints[near + step]) <= distance]
        found.add(rows[near], rows[near + step])
        step += 1


def _by_flips(first: int, prints: np.ndarray, free: list[int], distance: int, found: _Reached) -> None:
    """The same for one long list of sorted fingerprints, the first of which is row `first`: each is looked up with up to
    `distance` of the `free` bits flipped, a fixed number of look-ups a member however long the list is."""
    for k in range(1, distance + 1):
        for places in combinations(free, k):
            other = prints ^ np.uint64(sum(1 << p for p in places))
            at = np.searchsorted(prints, other)
            at[at == len(prints)] = 0
            hit = np.flatnonzero((prints[at] == other) & (prints < other))
            found.add(hit + first, at[hit] + first)


def _linker(matches: int, distance: int):
    """Sorted lists in, links out: each member of a list with the first one it reaches in it."""
    masks = np.array([_mask(p) & 0xFFFFFFFFFFFFFFFF for p in combinations(range(BYTES), matches)], np.uint64)

    def links(positions: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        values = prints & masks[positions]
        groups = np.cumsum(np.concatenate([[0], (positions[1:] != positions[:-1]) | (values[1:] != values[:-1])]))
        sizes = np.bincount(groups)
        short = np.flatnonzero((sizes[groups] > 1) & (sizes[groups] <= PAIRWISE))
        found = _Reached(len(prints))
        _pairwise(short, groups, prints, matches, distance, found)
        starts = np.cumsum(sizes) - sizes
        for g in np.flatnonzero(sizes > PAIRWISE):
            mask = int(masks[positions[starts[g]]])
            _by_flips(starts[g], prints[starts[g] : starts[g] + sizes[g]], [p for p in range(BITS) if not mask >> p & 1], distance, found)
        root = found.least()
        moved = np.flatnonzero(root != np.arange(len(prints)))
        return pa.RecordBatch.from_arrays([pa.array(prints[moved].view(np.int64)), pa.array(prints[root[moved]].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by list, then fingerprint; the last list of a batch may go on in the next one
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            p, f = batch.column("positions").to_numpy().astype(np.int64), batch.column("fingerprint").to_numpy().view(np.uint64)
            same = (p == p[-1]) & (f & masks[p] == f[-1] & masks[p[-1]])
            goes_on = not held or (held[-1][0][-1] == p[-1] and held[-1][1][-1] & masks[p[-1]] == f[-1] & masks[p[-1]])
            held.append((p, f))
            if same.all() and goes_on:
                continue
            rest = len(p) - np.count_nonzero(same)
            p, f = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            cut = len(p) - np.count_nonzero(same)
            held = [(held[-1][0][rest:], held[-1][1][rest:])]
            yield links(p[:cut], _sorted_lists(p[:cut], f[:cut], masks))
        if held:
            p, f = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            yield links(p, _sorted_lists(p, f, masks))

    return run


def _sorted_lists(positions: np.ndarray, prints: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Fingerprints in unsigned order inside their lists, which Spark has sorted as signed numbers."""
    return prints[np.lexsort((prints, prints & masks[positions], positions))]


def simhash_duplicates(docs: DataFrame, n: int = 3, distance: int = 3) -> DataFrame:
    """One row per row of `docs` (doc_id, text): fingerprint (16 hex digits) and component_id.

    Texts whose 64-bit fingerprints differ in at most `distance` bits are linked; component_id is the smallest doc_id
    reachable. At most `distance` of the eight bytes can differ, so a similar pair shares at least 8 - distance of them:
    each distinct fingerprint is listed under every choice of so many byte positions, and pairs of one list are tallied
    by equal bytes and verified by bits. A list has at most 2**(8 * distance) members whatever the corpus, as the bytes
    outside its positions are all that differs; long ones are searched by flipping bits, so no list costs the square of
    its length. Each list returns its members with the first one they reach, never its pairs, and components of these
    links are those of all pairs. Equal fingerprints are one node from the start.

    A null, empty or blank text has fingerprint zero, linked like any other. A very long text is hashed whole, in one
    task. Rows of a null doc_id have a fingerprint, link others, and get the smallest doc_id they reach (null if there
    is none); rows that repeat are all returned; an empty table gives no rows; other columns are ignored."""
    if not 1 <= distance < BYTES:
        raise ValueError("distance must leave at least one byte to share")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = materialise(rows.mapInArrow(_printer(n), PRINTS), "fingerprints")
    classes = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "classes")
    lists = byte_lists(classes.select("fingerprint"), BYTES - distance)
    dealt = lists.repartition("positions", "value").sortWithinPartitions("positions", "value", "fingerprint")
    links = materialise(dealt.select("positions", "fingerprint").mapInArrow(_linker(BYTES - distance, distance), LINKS).distinct(), "links")
    groups = materialise(components(links), "groups")
    placed = classes.join(groups.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    placed = materialise(placed, "placed")
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = placed.join(named, "component").select("fingerprint", "component_id")
    return prints.join(ids, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
