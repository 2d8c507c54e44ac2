"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training follows the regularised leader (FTRL-proximal) with elastic-net penalties on a bounded,
documented sample; document frequencies come from all training documents; a temperature calibrates the probabilities: it is fitted, fold by
fold, on sampled documents that the fold's training left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: N-grams of 1 to 3 letters are hashed into so many features.
FEATURES = 1 << 15
ORDERS = (1, 2, 3)
#: The classifier is fitted on about so many documents in all, dealt evenly to the languages, but on about so many of each at least.
SAMPLE, LEAST = 2_000, 20
#: The sample is cut into so many folds for calibration.
CALIBRATE = 5
UNDECIDED = "und"
#: Below this probability, or undecided, a document is rejected. Texts of two languages score about a half and stay.
MIN_SCORE = 0.4
CHUNK = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text; None if it has no letter.

    Letters are lower-cased; whatever else stands between them counts as one blank.
    """
    if not text:
        return None
    counts, tail, any_letter = np.zeros(FEATURES, np.int64), np.array([32], np.uint32), False
    for at in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = _letters()[codes]
        any_letter = any_letter or bool(is_letter.any())
        codes = np.concatenate([tail, np.where(is_letter, codes, np.uint32(32)), np.full(int(at + CHUNK >= len(text)), 32, np.uint32)])
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        codes = codes[keep]
        h, old = np.zeros(len(codes), np.uint32), min(len(tail), len(codes))
        for n in ORDERS:
            h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] if len(codes) >= n else h[:0]
            # Those that lie in the last chunk's tail as a whole were counted with it.
            fresh = h[max(0, old - n + 1) if at else 0 :]
            counts += np.bincount(((fresh ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(17), minlength=FEATURES)
        tail = codes[-(ORDERS[-1] - 1) :]
    return counts if any_letter else None


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index = np.flatnonzero(counts)
        values = counts[index] * self.idf[index]
        return index, values / max(float(np.sqrt((values * values).sum())), 1e-12)

    def logits(self, index: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values @ self.weights[index] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; ``und`` and 0 for a text without letters, or if nothing was learned."""
        counts = ngram_counts(text)
        if counts is None or not self.languages:
            return UNDECIDED, 0.0
        p = _softmax(self.logits(*self.features(counts)) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from rows of feature numbers, values and class, by FTRL-proximal; the penalties spare the bias."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))
    random = np.random.default_rng(0)

    def solve(zi: np.ndarray, ni: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= penalty, 0.0, -(zi - np.sign(zi) * penalty) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for k in random.permutation(len(rows)):
            index, values, target = rows[k]
            index, values = np.append(index, FEATURES), np.append(values, 0.1)
            penalty = np.where(index == FEATURES, 0.0, l1)[:, None]
            zi, ni = z[index], n[index]
            w = solve(zi, ni, penalty)
            p = _softmax(values @ w)
            p[target] -= 1.0
            g = values[:, None] * p[None, :]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[index], n[index] = zi + g - sigma * w, ni + g * g
    weights = np.empty((FEATURES, classes), np.float32)
    for k in range(0, FEATURES, 1024):
        weights[k : k + 1024] = solve(z[k : k + 1024][: FEATURES - k], n[k : k + 1024][: FEATURES - k], np.float64(l1))
    return weights, 0.1 * solve(z[-1], n[-1], np.float64(0.0))


def calibrate(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> float:
    """The temperature for rows in the order of their draw, at every size: each language's rows are dealt to folds in turn, and each fold is judged by the others.

    The only row of a language is left out: where nothing was learned of a language, its score tells nothing.
    """
    seen, folds = np.zeros(classes, int), []
    for *_, target in rows:
        folds.append(seen[target] % CALIBRATE)
        seen[target] += 1
    logits, targets = [], []
    for fold in range(CALIBRATE):
        judged = [r for r, at in zip(rows, folds) if at == fold and seen[r[2]] > 1]
        if judged:
            weights, bias = fit_ftrl([r for r, at in zip(rows, folds) if at != fold], classes)
            logits += [values @ weights[index] + bias for index, values, _ in judged]
            targets += [target for *_, target in judged]
    return fit_temperature(np.array(logits), np.array(targets, int))


def fit_temperature(logits: np.ndarray, targets: np.ndarray) -> float:
    """The temperature of least cross entropy, by a search over its logarithm; 1 without rows."""
    if not len(targets):
        return 1.0
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(targets)), targets], 1e-300)).mean()
    grid = np.exp(np.linspace(np.log(0.1), np.log(10.0), 61))
    return float(min(grid, key=loss))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def _document_frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, documents = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            counts = ngram_counts(text.as_py())
            if counts is not None:
                found += counts > 0
                documents += 1
    index = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(index, FEATURES), pa.int32()), pa.array(np.append(found[index], documents))], names=["feature", "documents"])


def _sample_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(lang.as_py(), key.as_py(), counts) for text, lang, key in zip(*batch.columns) if (counts := ngram_counts(text.as_py())) is not None]
        index = [np.flatnonzero(c).astype(np.int32) for _, _, c in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([i.tobytes() for i in index], pa.binary()), pa.array([r[2][i].astype(np.int32).tobytes() for r, i in zip(rows, index)], pa.binary())], names=["lang", "key", "index", "counts"])


def train(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Learns every language from text and lang of the rows of ``docs`` (doc_id, text, lang) that aren't held out.

    The driver gets about ``sample`` rows of features, or LEAST of each language if these are more, and one row per feature. Rows without text or letter teach nothing; where none is left, every text is undecided.
    """
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    counted = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    idf = np.ones(FEATURES)
    if not counted:
        return LanguageModel([], idf, np.zeros((FEATURES, 0), np.float32), np.zeros(0))
    frequencies = labelled.select("text").mapInArrow(_document_frequencies, "feature int, documents long").groupBy("feature").agg(F.sum("documents").alias("documents")).collect()
    df = np.zeros(FEATURES + 1)
    for feature, n in frequencies:
        df[feature] = n
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    # A hash of doc_id and text below a bound that each language's count gives: about as many rows of each, without a shuffle of the rest. Of rows that agree in both one counts.
    each = max(sample / len(counted), LEAST)
    bounds = docs.sparkSession.createDataFrame([(lang, int(min(1.0, each / n) * (1 << 32))) for lang, n in counted.items()], "lang string, bound long")
    key = F.xxhash64("doc_id", "text")
    chosen = labelled.withColumn("key", key).join(F.broadcast(bounds), "lang").where(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)) < F.col("bound"))
    chosen = chosen.groupBy("lang", "key").agg(F.first("text").alias("text")).select("text", "lang", "key")
    rows = chosen.mapInArrow(_sample_features, "lang string, key long, index binary, counts binary").collect()
    languages = sorted({r["lang"] for r in rows})
    model = LanguageModel(languages, idf, np.zeros((FEATURES, len(languages)), np.float32), np.zeros(len(languages)))
    if not languages:
        return model
    coded = []
    place = {lang: k for k, lang in enumerate(languages)}
    for r in sorted(rows, key=lambda r: (r["key"], r["lang"], len(r["index"]))):
        counts = np.zeros(FEATURES, np.int64)
        counts[np.frombuffer(r["index"], np.int32)] = np.frombuffer(r["counts"], np.int32)
        coded.append((*model.features(counts), place[r["lang"]]))
    model.weights, model.bias = fit_ftrl(coded, len(languages))
    model.temperature = calibrate(coded, len(languages))
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All rows and columns of ``docs``, with lang_pred and score, from the whole text alone. Columns of those names are replaced.

    Null texts and texts without letters are ``und`` with score 0; equal texts get equal results.
    """
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("lang_pred string, score double").fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=schema.names)

    return docs.mapInArrow(predict, schema)


def accepted(found: DataFrame) -> DataFrame:
    """Rows whose language is decided with the least score at least."""
    return found.where((F.col("lang_pred") != UNDECIDED) & (F.col("score") >= MIN_SCORE))


def op4_langid(spark, sf_dir: str) -> DataFrame:
    """The contract's digest: doc_id, held_out, lang_pred, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
