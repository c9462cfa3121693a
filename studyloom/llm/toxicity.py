"""Toxicity by compression distance to two zstandard dictionaries.

A text's windows are compressed with a dictionary of toxic and with one of ordinary text; a window that the toxic
dictionary shortens more speaks for toxicity. The toxic dictionary is trained on narrow windows of toxic texts, those around
words with a fragment that recurs in toxic texts far above its rate in ordinary ones, as most of a toxic text is ordinary
prose; the ordinary one on as narrow windows of ordinary texts. Behind both stands the same dictionary trained on wider
ordinary windows, so that common prose compresses alike. Savings are turned into a score by a logistic fit on labelled texts
that no dictionary has seen, its threshold moved to 0.5.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, few_texts, materialize, table

#: Words of a window that is scored, bytes of the shared and of the trained narrow dictionaries and of the fragments, level.
WINDOW, SHARED, NARROW, FRAGMENTS, LEVEL = 12, 32_768, 2_048, 2_048, 4
#: Words on either side in a narrow window, words of a window for the shared dictionary, and the trainer's segment and match sizes.
AROUND, WIDE, SEGMENT, MATCH = 1, 8, 16, 8
#: Labelled texts a class that the fit uses at most (a bound on the model's sample, not on what is scored), and the
#: share of a fragment's texts and its rate that mark it: z score and log ratio.
SAMPLE, LEAST_Z, LEAST_RATIO, GRAMS = 4_000, 4.0, 1.5, (4, 5, 6, 7, 8)
WORD = re.compile(rb"[a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "replace").translate(ASCII_LOWER))


def windows_of(words: list[bytes], n: int = WINDOW) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + n]) + b" " for i in range(0, len(words), n)]


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


@dataclass(frozen=True)
class Dictionaries:
    toxic: bytes
    ordinary: bytes

    @staticmethod
    def compressor(raw: bytes, level: int = LEVEL):
        shape = zstandard.ZstdCompressionParameters.from_level(level, source_size=256, dict_size=len(raw), write_checksum=False, write_content_size=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=shape).compress

    def features(self) -> Iterator:
        """A function of a text: the largest saving, the sum of the three largest, the mean of the positive ones, the mean,
        and the share of windows that save 2 bytes or more. All 0 for a text without words."""
        toxic, ordinary = self.compressor(self.toxic), self.compressor(self.ordinary)

        def of(text: str | None) -> tuple[float, ...]:
            found = windows_of(words_of(text))
            if not found:
                return (0.0,) * 5
            saved = np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in found), np.int64, len(found))
            top, n = np.sort(saved)[::-1], len(saved) + 1
            return float(top[0]), float(top[:3].sum()), float(top[top > 0].sum() / n), float(top.sum() / n), float((top >= 2).sum() / n)

        return of


def fragment_counts(labelled: DataFrame) -> DataFrame:
    """(text, toxic) -> fragment, and by class the texts that hold it and its count (t, tn of toxic, o, on of ordinary texts); under
    the empty fragment all texts and all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, times = (Counter(), Counter()), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                mine: Counter = Counter()
                words = Counter(words_of(text))
                mine[b""] = sum(words.values())
                for w, n in words.items():
                    spaced = b" " + w + b" "
                    for g in {spaced[i : i + k] for k in GRAMS for i in range(len(spaced) - k + 1)}:
                        mine[g] += n
                held[toxic].update(mine.keys())
                times[toxic].update(mine)
        for toxic in (0, 1):
            keys = list(held[toxic])
            for k in range(0, len(keys), 50_000):
                part = keys[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([toxic] * len(part), pa.int32()), pa.array([held[toxic][g] for g in part], pa.int64()), pa.array([times[toxic][g] for g in part], pa.int64())], names=["gram", "toxic", "held", "times"])

    parts = labelled.select("text", "toxic").mapInArrow(count, "gram binary, toxic int, held long, times long")
    of = lambda c, k: F.coalesce(F.sum(F.when(F.col("toxic") == k, F.col(c))), F.lit(0))
    return parts.groupBy("gram").agg(of("held", 1).alias("t"), of("held", 0).alias("o"), of("times", 1).alias("tn"), of("times", 0).alias("on"))


def toxic_fragments(labelled: DataFrame, room: int = FRAGMENTS) -> list[bytes]:
    """The fragments of toxic texts of the highest excess, best first, about `room` bytes of them."""
    counts = materialize(fragment_counts(labelled), "fragments")
    all_ = counts.where("gram = X''").first()
    nt, no, wt, wo = all_.t, all_.o, max(all_.tn, 1), max(all_.on, 1)
    p, q = F.col("t") / nt, (F.col("o") + 0.5) / no
    mean = (p + q) / 2
    ratio = F.log(((F.col("tn") + 0.5) / wt) / ((F.col("on") + 0.5) / wo))
    z = (p - q) / F.sqrt(mean * (1 - mean) * (1 / nt + 1 / no) + 1e-12)
    strong = counts.where("t >= 5 AND gram <> X''").select("gram", ratio.alias("r"), z.alias("z")).where((F.col("r") >= LEAST_RATIO) & (F.col("z") >= LEAST_Z))
    rows = strong.select("gram", (F.col("z") * F.col("r")).alias("s")).collect()  # of the labelled sample alone
    chosen: list[bytes] = []
    for gram in (bytes(r.gram) for r in sorted(rows, key=lambda r: (-r.s, -len(r.gram), bytes(r.gram)))):
        if sum(map(len, chosen)) < room and not any(gram in c for c in chosen):
            chosen.append(gram)
    return chosen


def training_windows(texts: DataFrame, size: int, fragments: list[bytes] | None = None) -> list[bytes]:
    """All windows of the texts, which come in order of a hash: `size` words each, one after another, or, where fragments are given,
    around each word that holds one. A null or empty text has none. texts is the labelled sample: SAMPLE bounds what reaches
    the driver, a row of joined windows a text."""
    holds = re.compile(b"|".join(map(re.escape, sorted(fragments)))).search if fragments else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                at = [i for i, w in enumerate(words) if holds(b" " + w + b" ")] if holds else []
                found = [b" " + b" ".join(words[max(0, i - AROUND) : i + AROUND + 1]) + b" " for i in at] if holds else windows_of(words, size)
                joined.append(b"\n".join(found))
            yield pa.RecordBatch.from_arrays([pa.array(joined, pa.binary())], names=["windows"])

    rows = few_texts(texts.select("text")).mapInArrow(cut, "windows binary").withColumn("h", F.xxhash64("windows"))
    texts = sorted((r.h, bytes(r.windows)) for r in rows.where(F.length("windows") > 0).collect())
    return [window for _, windows in texts for window in windows.split(b"\n")]


def trained(size: int, windows: list[bytes], **shape: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, windows, **shape).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the windows themselves
        return b"".join(windows)[-size:]


def build_dictionaries(labelled: DataFrame, room: int = FRAGMENTS, shared: int = SHARED, narrow: int = NARROW) -> Dictionaries:
    """The dictionaries of a labelled sample (text, toxic). A class without texts, or with null and empty ones only, has what its windows
    give: none, so that nothing is saved by it."""
    toxic, ordinary = labelled.where("toxic = 1"), labelled.where("toxic = 0")
    fragments = toxic_fragments(labelled, room)
    base = trained(shared, training_windows(ordinary, WIDE))
    shape = {"k": SEGMENT, "d": MATCH}
    marked = trained(narrow, training_windows(toxic, 2 * AROUND + 1, fragments), **shape) if fragments else b""
    plain = trained(narrow, training_windows(ordinary, 2 * AROUND + 1), **shape)
    return Dictionaries(marked + base, plain + base)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights, intercept last, of an L2-regularised logistic regression (Newton's method)."""
    x = np.column_stack([x, np.ones(len(x))])
    w, pull = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def featured(docs: DataFrame, model: Dictionaries, keep: str) -> DataFrame:
    """docs' columns named in `keep` (name type, ...) and f, the features of text."""
    names = [c.split()[0] for c in keep.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = model.features()
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rows, pa.list_(pa.float64()))], names=[*names, "f"])

    return few_texts(docs.select(*names, "text")).mapInArrow(of, f"{keep}, f array<double>")


@dataclass(frozen=True)
class ToxicityModel:
    dictionaries: Dictionaries
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    shift: float

    def score(self, f: Column) -> Column:
        terms = [(f[i] - self.mean[i]) / self.scale[i] * self.weights[i] for i in range(len(self.mean))]
        return 1 / (1 + F.exp(-(sum(terms[1:], terms[0]) + self.weights[-1] - self.shift)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel | None:
    """Fit on at most about `sample` labelled texts of each class, those of the smallest hash of their id, whose fold is not
    0; fold 1 calibrates. None where a class is missing, as in empty tables. A doc_id with several labels is toxic if one says
    so; a row that is repeated is fitted as often; a null text is empty. Of labels doc_id and toxic are read, of docs doc_id and
    text."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(fold(F.col("doc_id")) != 0)
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("toxic") == 1, sample / sizes[1]).otherwise(sample / sizes[0])
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)  # about 2 * sample rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    labelled = materialize(texts.join(F.broadcast(chosen), "doc_id"), "labelled").repartition(32, "doc_id")
    learn, check = labelled.where(fold(F.col("doc_id")) != 1), labelled.where(fold(F.col("doc_id")) == 1)
    if learn.select("toxic").distinct().count() < 2:
        return None
    dictionaries = build_dictionaries(learn)
    rows = featured(check, dictionaries, "toxic int").collect()  # five numbers for each of some sampled texts
    if len({r.toxic for r in rows}) < 2:
        rows = featured(labelled, dictionaries, "toxic int").collect()
    x, y = np.array([r.f for r in rows], float), np.array([r.toxic for r in rows], float)
    rate = sizes[1] / (sizes[0] + sizes[1])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    w = logistic((x - mean) / scale, y)
    margin = ((x - mean) / scale) @ w[:-1] + w[-1]
    # The threshold of the best F1, each class weighing as in the labels.
    weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
    best = max(np.unique(margin), key=lambda t: 2 * (weight * y * (margin >= t)).sum() / ((weight * (margin >= t)).sum() + (weight * y).sum()))
    below = margin[margin < best]
    shift = float((best + below.max()) / 2) if len(below) else float(best)
    return ToxicityModel(dictionaries, tuple(mean), tuple(scale), tuple(w), shift)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """(doc_id, text, ...) -> one row per input row: doc_id, held_out, score, predicted. Only the text is scored.

    A null text is empty; an empty text scores as one without savings; a very long one is compressed whole, window by window.
    Repeated rows, and texts that tie, have equal scores. Without a model all scores are 0. An empty table gives an empty
    result; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        scored = rows.select("doc_id", F.lit(0.0).alias("score"))
    else:
        scored = featured(rows, model.dictionaries, "doc_id long").select("doc_id", model.score(F.col("f")).alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_compression_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_toxicity(docs, fit_toxicity(docs, labels))
