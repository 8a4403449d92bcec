"""Language ID in two steps: the family first, then one-versus-one linear support vector machines inside it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.words import slices

#: Languages by family; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk".split(),
}
#: A model holds no more languages; what training sends to all executors is a row for each.
MOST_LANGUAGES = 2000
#: Buckets of hashed byte trigrams.
BUCKETS = 4096
UNKNOWN = "und"

_FOLD = np.full(256, ord(" "), np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _c in range(26):
    _FOLD[ord("A") + _c] = _FOLD[ord("a") + _c] = ord("a") + _c


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the byte trigram at each byte, and begin and end of each text's trigrams. Letters lose their case
    (also those of the Latin-1 range), all else in ASCII is a space."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = _FOLD[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw is not None else np.zeros(0, np.uint8)
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
    data[capital] += 0x20
    bounds = offsets - offsets[0]
    wide = data.astype(np.uint32)
    codes = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) if len(data) > 2 else wide[:0]
    buckets = (codes * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    begins = np.minimum(bounds[:-1], len(buckets))
    return buckets, begins, np.maximum(np.minimum(bounds[1:] - 2, len(buckets)), begins)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        buckets, begins, ends = _trigrams(batch.column("text"))
        rows = [np.unique(buckets[a:b], return_counts=True) for a, b in zip(begins, ends)]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([k.astype(np.int32).tobytes() for k, _ in rows], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in rows], pa.binary())], names=["lang", "keys", "counts"])


def _svm(x: np.ndarray, y: np.ndarray, steps: int = 150, penalty: float = 1e-4) -> tuple[np.ndarray, float, float]:
    """Weights, bias and slope of a linear support vector machine: squared hinge loss, classes weighted alike, by
    accelerated gradient descent; the slope turns a margin into log-odds."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = last = np.zeros(x.shape[1] + 1, np.float32)
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    rate = 1.0 / (2 * float((weight * (x**2).sum(1)).sum()) + penalty)
    for t in range(steps):
        ahead = w + (t / (t + 3)) * (w - last)
        slack = np.maximum(0, 1 - y * (x @ ahead))
        last, w = w, ahead - rate * (penalty * ahead - 2 * (x.T @ (weight * y * slack)))
    margin = y * (x @ w)
    slopes = np.geomspace(0.5, 32, 25)
    loss = [float((weight * np.logaddexp(0, -s * margin)).sum()) for s in slopes]
    return w[:-1], float(w[-1]), float(slopes[int(np.argmin(loss))])


@dataclass
class LanguageModel:
    """Classes of each level and the machines that separate pairs of them: (level, positive, negative) by column of
    `weights`. Level "" tells families apart, the others languages of the family they name."""

    groups: dict[str, list[str]]
    pairs: list[tuple[str, str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    biases: np.ndarray = field(default_factory=lambda: np.zeros(0))
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def _winner(self, level: str, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of a level with the most won pairs (then the larger sum of chances, then the first), and the mean
        of its chances."""
        names = self.groups[level]
        won = np.zeros((len(chance), len(names)))
        for k, (at, a, b) in enumerate(self.pairs):
            if at == level:
                won[:, names.index(a)] += (chance[:, k] >= 0.5) + 1e-3 * chance[:, k]
                won[:, names.index(b)] += (chance[:, k] < 0.5) + 1e-3 * (1 - chance[:, k])
        best = won.argmax(1)
        mean = np.ones(len(chance))
        if len(names) > 1:
            mean = (won[np.arange(len(best)), best] % 1) * 1e3 / (len(names) - 1)
        return best, np.clip(mean, 0, 1)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        buckets, begins, ends = _trigrams(texts)
        sums = np.zeros((len(buckets) + 1, len(self.pairs)))
        np.cumsum(self.weights[buckets], axis=0, dtype=np.float64, out=sums[1:])
        mean = (sums[ends] - sums[begins]) / np.maximum(ends - begins, 1)[:, None]
        chance = 1 / (1 + np.exp(-np.clip(self.slopes * (mean + self.biases), -50, 50)))
        family, score = self._winner("", chance)
        labels = np.empty(len(family), object)
        for k, name in enumerate(self.groups[""]):
            rows = np.flatnonzero(family == k)
            inner, sure = self._winner(name, chance[rows])
            labels[rows] = [self.groups[name][i] for i in inner]
            score[rows] *= sure
        return labels.tolist(), score


def train(docs: DataFrame, sample: int = 800) -> LanguageModel | None:
    """Learn from at most `sample` documents of each language of `docs` (text, lang), those with the smallest hashes of
    their rows. Rows are thinned to a few times the sample by the same hash before any are brought together, so the
    sampling tasks do not grow with the corpus. Only trigram counts of the sample reach the driver. None without any
    labelled text."""
    known = docs.where("lang is not null and text is not null")
    known = known.select("lang", "text", F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns]).alias("_h"))
    counts = known.groupBy("lang").agg((F.lit(4.0 * sample) / F.count("*")).alias("_share")).limit(MOST_LANGUAGES + 1).collect()
    if not counts:
        return None
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    thin = known.join(F.broadcast(docs.sparkSession.createDataFrame(counts, "lang string, _share double")), "lang").where(F.pmod("_h", F.lit(1 << 30)) < F.col("_share") * (1 << 30))
    order = Window.partitionBy("lang").orderBy("_h")
    chosen = thin.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample).select("lang", "text")
    rows = chosen.mapInArrow(_count_batches, "lang string, keys binary, counts binary").collect()
    rows = sorted((r for r in rows if len(r["keys"])), key=lambda r: (r.lang, bytes(r["keys"]), bytes(r["counts"])))
    if not rows:
        return None
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        counts = np.frombuffer(r["counts"], np.int32)
        x[i, np.frombuffer(r["keys"], np.int32)] = counts / counts.sum()
    langs = np.array([r.lang for r in rows])
    scale = 1 / np.sqrt((x**2).mean(0) + (x**2).mean())
    x *= scale
    families = np.array([family_of(v) for v in langs])
    model = LanguageModel({"": sorted(set(families.tolist()))} | {f: sorted(set(langs[families == f].tolist())) for f in set(families.tolist())})
    columns, biases, slopes = [], [], []
    for level, names in model.groups.items():
        of = families if level == "" else langs
        for a, b in combinations(names, 2):
            own = (of == a) | (of == b)
            w, bias, slope = _svm(x[own], np.where(of[own] == a, 1, -1).astype(np.float32))
            model.pairs.append((level, a, b))
            columns.append(w * scale)
            biases.append(bias)
            slopes.append(slope)
    if columns:
        model.weights, model.biases, model.slopes = np.stack(columns, 1).astype(np.float32), np.array(biases), np.array(slopes)
    return model


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The rows of `docs` with lang_pred and lang_score (0 to 1: the chance of the family times that of the language in
    it). Every byte of a text counts; lang, source and doc_id are not looked at.

    A null text, one without a letter, or any text when there is no model: `und`, 0. Repeated rows are judged alike, an
    empty table gives no rows, other columns are passed on (columns of the two new names are replaced)."""
    rows = docs.drop("lang_pred", "lang_score").withColumn("_letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = T.StructType([*rows.drop("_letters").schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            letters = batch.column("_letters").to_pylist()
            labels, scores = model.predict(batch.column("text")) if model else ([UNKNOWN] * len(letters), np.zeros(len(letters)))
            columns = [batch.column(n) for n in batch.schema.names if n != "_letters"]
            columns += [pa.array([v if ok else UNKNOWN for v, ok in zip(labels, letters)], pa.string()), pa.array(np.where(letters, scores, 0.0))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 0 divided by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
