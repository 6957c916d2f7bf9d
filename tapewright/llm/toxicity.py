"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a toxic lexicon (whole words and word stems), how close lexicon words
stand to second-person words, capitals, punctuation, and rates of obfuscated spelling. The lexicon is
learned from labelled texts: words and stems far more frequent in toxic than in clean ones.

Labelled rows are split by the crc32 of their id, so that each step is fitted on rows the steps before
did not see: remainders 1 and 2 of 5 give the lexicon, 3 the trees, 4 the calibration; remainder 0 is
never learned from. At most ``fit_rows`` labelled rows, those of smallest id hash, are used for fitting;
the labels of these rows, a bounded table, are broadcast to the scan of the texts. Scoring is a scan of
all texts without a shuffle.

Defined results: a null text counts as empty and gets a score like any other; labels without id or value
are left out, of several labels of an id the larger counts; where the labelled rows of a step lack one of
the two classes, every score is the share of toxic rows among the labels (0 without labels); repeated ids
are scored row by row; an empty table gives an empty result; only named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm import words as W
from tapewright.llm.scratch import Scratch

#: Words that address the reader, in the languages of the corpus.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "euch", "ihr", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "tú", "ti", "tus", "usted", "ustedes", "vos")
NEAR = 5
WINDOW = 50
STEMS = (4, 6)
#: A lexicon entry is this many times more frequent in toxic than in clean texts, and its log-likelihood
#: ratio against chance is at least LEAST_EVIDENCE, and at least the log of how many units were tried.
LEAST_RATIO, LEAST_EVIDENCE = 6.0, 9.0
LEXICON_SIZE = 4096
FEATURES = (
    "word_density", "word_count", "word_window", "stem_density", "stem_count", "near_second_person", "second_person",
    "capitals", "capital_words", "exclamations", "questions", "punctuation", "symbols_in_words", "digits_in_words", "drawn_out", "length",
)

_WORD = W.LETTERS
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "@#$%*_-.!|+"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_ALPHA = _WORD.copy()
_ALPHA[0x30:0x3A] = False


def fold(id_col: str | Column) -> Column:
    """Remainder by 5 of the crc32 of the id as text."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary") if isinstance(id_col, str) else id_col.cast("string").cast("binary")), F.lit(5))


def _units(data: np.ndarray, offsets: np.ndarray):
    """Words of a slice: starts, ends, words before each text, word hashes, stem hashes by stem length (0 for shorter words)."""
    starts, ends, before = W.spans(data, offsets, _WORD)
    stems = []
    for k in STEMS:
        long = ends - starts > k
        stem = np.zeros(len(starts), dtype=np.uint64)
        stem[long] = W.mix(W.hashes(data, starts[long], starts[long] + k) + np.uint64(k))
        stems.append(stem)
    return starts, ends, before, W.hashes(data, starts, ends), stems


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, toxic): units with the number of toxic and clean texts of the batch that hold them."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, data, offsets in W.slices(batch.column(0)):
            *_, before, words, stems = _units(data, offsets)
            text = W.rows_of(np.diff(before))
            kind, row = np.concatenate([words, *stems]), np.tile(text, 1 + len(stems))
            stem = np.repeat(np.arange(1 + len(stems)) > 0, len(words))
            kind, row, stem = kind[kind != 0], row[kind != 0], stem[kind != 0]
            order = np.lexsort((row, kind))
            kind, row, stem = kind[order], row[order], stem[order]
            new = np.ones(len(kind), dtype=bool)
            new[1:] = (kind[1:] != kind[:-1]) | (row[1:] != row[:-1])
            kind, row, stem = kind[new], row[new], stem[new]
            first = np.flatnonzero(np.append(True, kind[1:] != kind[:-1])) if len(kind) else np.zeros(0, np.int64)
            bad = np.add.reduceat(toxic[lo + row], first) if len(first) else first
            each = np.diff(np.append(first, len(kind)))
            yield pa.RecordBatch.from_pydict({"unit": kind[first].view(np.int64), "stem": stem[first], "toxic": bad, "clean": each - bad})


class Lexicon(NamedTuple):
    """Sorted hashes of toxic words and stems."""

    words: np.ndarray
    stems: np.ndarray


_SECOND = None


def _second_person() -> np.ndarray:
    global _SECOND
    if _SECOND is None:
        out = []
        for word in SECOND_PERSON:
            data = np.frombuffer(word.encode(), dtype=np.uint8)
            out.append(W.hashes(data, np.array([0]), np.array([len(data)]))[0])
        _SECOND = np.sort(np.array(out, dtype=np.uint64))
    return _SECOND


def _within(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(keys, x)
    at[at == len(keys)] = 0
    return keys[at] == x


def _features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    n = len(offsets) - 1
    starts, ends, before, words, stems = _units(data, offsets)
    text = W.rows_of(np.diff(before))
    bytes_ = np.maximum(np.diff(offsets), 1)
    many = np.maximum(np.diff(before), 1)
    byte_sums = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[offsets])
    word_sums = lambda flag: np.bincount(text[flag], minlength=n)
    hit = _within(lexicon.words, words)
    stem = np.zeros(len(words), dtype=bool)
    for s in stems:
        stem |= _within(lexicon.stems, s)
    any_hit = hit | stem
    you = _within(_second_person(), words)
    # Hits in a window of words that starts at each word, within its text.
    sums = np.concatenate([[0], np.cumsum(any_hit)])
    here = np.arange(len(words))
    window = sums[np.minimum(here + WINDOW, before[1:][text])] - sums[here]
    most = np.zeros(n)
    np.maximum.at(most, text, window)
    yous = np.concatenate([[0], np.cumsum(you)])
    near = any_hit & (yous[np.minimum(here + NEAR + 1, before[1:][text])] > yous[np.maximum(here - NEAR, before[:-1][text])])
    alpha, upper = _ALPHA[data], _UPPER[data]
    inside = np.zeros(len(data), dtype=bool)
    drawn = np.zeros(len(data), dtype=bool)
    digits = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        inside[1:-1] = _SYMBOL[data[1:-1]] & alpha[:-2] & alpha[2:]
        drawn[2:] = alpha[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
        digits[1:-1] = _WORD[data[1:-1]] & ~alpha[1:-1] & alpha[:-2] & alpha[2:]
    capitals = np.concatenate([[0], np.cumsum(upper)])
    all_caps = (ends - starts > 2) & (capitals[ends] - capitals[starts] == ends - starts)
    return np.stack(
        [
            word_sums(hit) / many, np.log1p(word_sums(hit)), most, word_sums(stem) / many, np.log1p(word_sums(stem)), word_sums(near) / many, word_sums(you) / many,
            byte_sums(upper) / bytes_, word_sums(all_caps) / many, byte_sums(data == 0x21) / bytes_, byte_sums(data == 0x3F) / bytes_, byte_sums(_PUNCTUATION[data]) / bytes_,
            byte_sums(inside) / many, byte_sums(digits) / many, byte_sums(drawn) / many, np.log1p(np.diff(before)),
        ],
        axis=1,
    )


class ToxicityModel(NamedTuple):
    """What ``fit`` has learned; without trees every score is ``share``."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float

    def featured(self, rows: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(self.lexicon)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = np.zeros((len(batch), len(FEATURES)))
                for lo, data, offsets in W.slices(batch.column(1)):
                    table[lo : lo + len(offsets) - 1] = _features(data, offsets, shared.value)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in range(2, batch.num_columns)), lists], ["id", *others, "features"])

        taken = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *others)
        kinds = [f"{f.name} {f.dataType.simpleString()}" for f in taken.schema if f.name != "text"]
        return taken.mapInArrow(run, ", ".join([*kinds, "features array<double>"]))

    def score(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, score) of all rows."""
        if self.trees is None:
            return docs.select(id_col, F.lit(self.share).alias("score"))
        rows = self.featured(docs, id_col, text_col).withColumn("features", array_to_vector("features"))
        rows = self.trees.transform(rows).withColumn("raw", vector_to_array("probability")[1])
        rows = self.calibration.transform(rows)
        return rows.select(F.col("id").alias(id_col), F.least(F.greatest("prediction_calibrated", F.lit(0.0)), F.lit(1.0)).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 200_000, trees: int = 20, depth: int = 3) -> ToxicityModel:
    """Learns from labelled rows whose fold is not 0, at most ``fit_rows`` of them."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    known = known.withColumn("fold", fold(F.col("label_id"))).where("fold <> 0").orderBy(F.xxhash64("label_id"), "label_id").limit(fit_rows)
    known = scratch.save(known, "labels")
    share = known.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), F.col("id") == F.col("label_id")).drop("label_id")
    labelled = scratch.save(labelled, "labelled")

    counted = labelled.where("fold in (1, 2)").select("text", "toxic")
    bad, good = counted.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    nothing = ToxicityModel(Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.uint64)), None, None, float(share))
    if not bad or not good:
        return nothing
    units = counted.mapInArrow(_counted, "unit bigint, stem boolean, toxic bigint, clean bigint").groupBy("unit", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    units = scratch.save(units, "units")
    tried = units.count()
    both = F.col("toxic") + F.col("clean")
    part = lambda seen, of: F.when(seen > 0, seen * F.log(seen * (bad + good) / (both * of))).otherwise(0.0)
    evidence = part(F.col("toxic"), bad) + part(F.col("clean"), good)
    ratio = ((F.col("toxic") + 0.5) / (bad + 1)) / ((F.col("clean") + 0.5) / (good + 1))
    found = units.withColumn("evidence", evidence).where((ratio >= LEAST_RATIO) & (F.col("evidence") >= max(LEAST_EVIDENCE, math.log(max(tried, 1)))))
    top = found.orderBy(F.desc("evidence"), "unit").limit(LEXICON_SIZE).collect()
    pick = lambda stem: np.sort(np.array([r["unit"] for r in top if r["stem"] == stem], dtype=np.int64).view(np.uint64))
    model = nothing._replace(lexicon=Lexicon(pick(False), pick(True)))

    table = scratch.save(model.featured(labelled.where("fold in (3, 4)"), "id", "text", "toxic", "fold"), "features")
    table = table.select("fold", F.col("toxic").cast("double").alias("label"), array_to_vector("features").alias("features"))
    for part in (3, 4):
        if table.where(F.col("fold") == part).agg(F.countDistinct("label")).first()[0] < 2:
            return nothing
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=64, seed=1, predictionCol="tree_class").fit(table.where("fold = 3"))
    rated = boosted.transform(table.where("fold = 4")).withColumn("raw", vector_to_array("probability")[1])
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="prediction_calibrated").fit(rated.select("raw", "label"))
    return model._replace(trees=boosted, calibration=calibration)
