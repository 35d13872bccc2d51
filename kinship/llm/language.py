"""Operator 6: language identification by a string kernel with Nyström landmarks and kernel ridge regression.

A text is the set of its byte n-grams of 1 to 4 bytes (blended spectrum, presence only), each set hashed to BINS places.
The kernel of two texts is the number of common places over the geometric mean of their counts. Landmarks from every
language span the approximate feature space; one-versus-rest ridge regression in it is solved in closed form on the
driver. A batch of texts is scored as two matrix products: presence x landmarks, then kernel x coefficients.

Training sees at most SAMPLE labelled texts, equally many of each language as far as there are, chosen by the hash of
their ids; their packed presence bits (2 kB each) are all that the driver gets. Null and letterless texts are `und` with
score 0, as is everything where nothing can be learned; repeated rows count as rows. Other columns stay, but for those that are
called like an output, which are replaced. Training learns the LANGUAGES most common languages at most: others are taken for noise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinship.llm.common import WORD_BYTES, giving_back, held_out, release_memory, slices, small_batches, texts, without

#: Places of the n-gram sets, a power of two.
BINS = 1 << 14
#: Labelled texts that training sees at most, and landmarks among them.
SAMPLE, LANDMARKS = 3200, 192
#: Languages that are learned, at most: as many as may have a landmark each.
LANGUAGES = 192
#: What a text may fall short of the fitted ones: a share of the least kernel value, and of the least output.
KIN_SHARE, OUTPUT_SLACK = 0.7, 0.1
#: Rows of a matrix product.
ROWS = 64
UNKNOWN = "und"


def bins(text: bytes, longest: int = 4) -> np.ndarray:
    """The place of each n-gram of each length, repeats included. ASCII signs and digits count as spaces."""
    a = np.frombuffer(b" " + text.translate(_LETTERS) + b" ", np.uint8).astype(np.uint32)
    out, h = [], np.zeros(len(a), np.uint32)
    for n in range(1, min(longest, len(a)) + 1):
        with np.errstate(over="ignore"):
            h = (h[: len(a) - n + 1] + a[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        out.append(h >> np.uint32(32 - BINS.bit_length() + 1))
    return np.concatenate(out)


_LETTERS = bytes(32 if 48 <= b <= 57 else WORD_BYTES[b] for b in range(256))


def has_letter(text: bytes) -> bool:
    if text.translate(None, _NO_LETTERS):
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))


_NO_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))


def presence(items: list[bytes]) -> np.ndarray:
    """A row of zeros and ones for each text."""
    x = np.zeros((len(items), BINS), np.float32)
    for row, text in zip(x, items, strict=True):
        for start in range(0, len(text), 1 << 18):  # long texts in parts that overlap
            row[bins(text[max(0, start - 3) : start + (1 << 18)])] = 1
    return x


@dataclass
class Model:
    """What scoring needs: the languages, the landmarks' bits, a column of coefficients for each language, and the least kernel value with a landmark and the least output that a text in one of the languages has."""

    languages: list[str]
    bits: np.ndarray
    coefficients: np.ndarray
    least_kin: float = 0.0
    least_output: float = -np.inf

    def scorer(self):
        z = np.unpackbits(self.bits, axis=1).astype(np.float32).T.copy()
        norm, beta = np.sqrt(z.sum(axis=0)), self.coefficients.astype(np.float32)

        def score(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            """The output for each language, and the largest kernel value with a landmark."""
            x = presence(items)
            k = (x @ z) / norm / np.sqrt(np.maximum(1, x.sum(axis=1)))[:, None]
            return k @ beta, k.max(axis=1)

        return score


def kernel(bits: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """The kernel values of texts (packed presence bits) with landmarks, some texts at a time."""
    rows = lambda x: (lambda y: y / np.sqrt(np.maximum(1, y.sum(axis=1)))[:, None])(np.unpackbits(x, axis=1).astype(np.float32))
    z = rows(landmarks).T
    return np.concatenate([rows(bits[i : i + 256]) @ z for i in range(0, len(bits), 256)]).astype(float)


def solve(k: np.ndarray, y: np.ndarray, landmarks: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients over the landmarks' kernel values, from those of all fitted texts: Nyström features, then ridge regression for each column of y. landmarks: their places among the texts."""
    value, vector = np.linalg.eigh(k[landmarks])
    keep = value > 1e-8 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    features = k @ root
    return root @ np.linalg.solve(features.T @ features + ridge * len(k) * np.eye(features.shape[1]), features.T @ y)


def limits(k: np.ndarray, landmarks: np.ndarray, coefficients: np.ndarray) -> tuple[float, float]:
    """The least kernel value and the least output that a text may have to count as one of a learned language: a bit below the fitted texts' own, where a landmark's with itself doesn't count."""
    others = k.copy()
    others[landmarks, np.arange(len(landmarks))] = 0
    return KIN_SHARE * float(others.max(axis=1).min()), float((k @ coefficients).max(axis=1).min()) - OUTPUT_SLACK


def fit(docs: DataFrame, train: Column, sample: int = SAMPLE, landmarks: int = LANDMARKS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from rows of docs where train holds, and text and language are not null; None where there are none."""
    docs = small_batches(docs)
    labelled = docs.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    counts = dict(labelled.groupBy("l").count().orderBy(F.desc("count"), "l").limit(LANGUAGES).collect())
    if not counts:
        return None
    labelled = labelled.filter(F.col("l").isin(*counts))
    each = max(1, sample // len(counts))
    part = F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(1_000_000)) / 1_000_000
    odds = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2 * each / n + 30 / n))))
    near = Window.partitionBy("l").orderBy(F.xxhash64(id_col, F.lit(1)), id_col)

    def packed(batches):
        for batch in batches:
            data = texts(batch, "t")
            for a, b in slices([len(x) for x in data]):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([np.packbits(r).tobytes() for r in (presence([x])[0] > 0 for x in data[a:b])], pa.binary())], names=[id_col, "l", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    few = labelled.filter(part < F.element_at(odds, F.col("l"))).select(id_col, "l", "t").mapInArrow(packed, f"`{id_col}` {kind}, l string, bits binary")
    rows: pd.DataFrame = few.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= each).toPandas().sort_values(["r", "l"], kind="stable")
    if rows.empty:
        return None
    languages = sorted(rows["l"].unique())
    bits = np.stack([np.frombuffer(x, np.uint8) for x in rows["bits"]])
    y = np.where(rows["l"].to_numpy()[:, None] == np.array(languages)[None], 1.0, -1.0)
    chosen = np.arange(min(landmarks, len(rows)))  # by rank, so each language has its share
    k = kernel(bits, bits[chosen])
    coefficients = solve(k, y, chosen)
    model = Model(languages, bits[chosen], coefficients, *limits(k, chosen, coefficients))
    del rows, bits, k
    release_memory()
    return model


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs' columns with lang_pred, score (0 to 1, how surely the language is this one), kin (the largest kernel value with a landmark) and learned (whether kernel value and output are those of texts in the languages that were fitted; false for `und`)."""
    docs = small_batches(without(docs, "lang_pred", "score", "kin", "learned"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LANDMARKS x BINS bits: under 1 MB

    def run(batches):
        scorer = shared.value.scorer() if shared.value else None
        for batch in batches:
            data = texts(batch, text_col)
            for a in range(0, len(data), ROWS):
                part = data[a : a + ROWS]
                known = np.array([has_letter(x) for x in part]) & (scorer is not None)
                lang, score, kin, learned = [UNKNOWN] * len(part), np.zeros(len(part)), np.zeros(len(part)), np.zeros(len(part), bool)
                if known.any():
                    f, near = scorer([x for x, k in zip(part, known, strict=True) if k])
                    e = np.exp(4 * (f - f.max(axis=1, keepdims=True)))
                    score[known], kin[known] = (e.max(axis=1) / e.sum(axis=1)), near
                    learned[known] = (near >= shared.value.least_kin) & (f.max(axis=1) >= shared.value.least_output)
                    for i, best in zip(np.flatnonzero(known), f.argmax(axis=1), strict=True):
                        lang[i] = shared.value.languages[best]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, len(part)) for c in batch.columns), pa.array(lang), pa.array(score, pa.float64()), pa.array(kin, pa.float64()), pa.array(learned)], names=[*batch.schema.names, "lang_pred", "score", "kin", "learned"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(giving_back(run), f"{schema}, lang_pred string, score double, kin double, learned boolean")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, ~held_out(F.col("doc_id")))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "kin", "learned")
