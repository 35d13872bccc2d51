"""Operator 4: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's chance is the logistic function of the summed weights of its words, and a
document's chance is the noisy-or of its sentences': one minus the product of their complements. The weights are trained
from document labels alone, by gradient descent through the noisy-or, and then say which sentences offend.

Training sees at most POSITIVE and NEGATIVE labelled documents, and SAMPLE bytes of text of each kind, chosen by the hash of
their ids and weighted back to the shares that they stand for; of rows that share an id the text with the smallest hash is seen.
Words that fewer than RARE of them hold, or whose documents are toxic about as often as others (by less than
SURE standard deviations), have no weight: so single wrong labels aren't learned by heart. Null and empty texts are scored as bags
without words; labels of a document that contradict each other count as toxic; repeated rows are scored as rows; without
labels of both kinds everything scores the share of the one kind. Other columns stay, but for those that are called like an
output, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinship.llm.common import WORD_BYTES, giving_back, held_out, release_memory, slices, small_batches, texts, without, word_hashes

#: Labelled documents that training sees at most, and bytes of either kind's texts: the driver gets 4 bytes for each word.
POSITIVE, NEGATIVE, SAMPLE = 4000, 8000, 1 << 25
#: Documents that a word has to occur in, and standard deviations by which its toxic ones have to differ from chance.
RARE, SURE = 4, 4.0
#: Places of the weights, as a power of two.
BITS = 20
#: Sentences' ends.
ENDS = b".!?\n"
_ENDS = bytes(10 if b in ENDS else 32 for b in range(256))


def sentence_words(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """The place of each word, the number of its sentence, and how many sentences there are."""
    words = (word_hashes(text) >> np.uint64(64 - BITS)).astype(np.int32)
    if not len(words):
        return words, words, 0
    clean = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 32
    starts = np.flatnonzero(clean & ~np.concatenate(([False], clean[:-1])))
    at = np.flatnonzero(np.frombuffer(text.translate(_ENDS), np.uint8) == 10)
    _, sentence = np.unique(np.searchsorted(at, starts), return_inverse=True)
    return words, sentence.astype(np.int32), int(sentence[-1]) + 1


def spans(text: bytes) -> list[tuple[int, int]]:
    """The characters from and to of each sentence that has words, in the order that sentence_words numbers them in."""
    out, start = [], 0
    marks = text.translate(_ENDS)
    while start < len(text):
        end = marks.find(b"\n", start)
        end = len(text) if end < 0 else end + 1
        if text[start:end].translate(WORD_BYTES).strip():
            first = len(text[:start].decode("utf-8", "replace"))
            out.append((first, first + len(text[start:end].decode("utf-8", "replace"))))
        start = end
    return out


@dataclass
class Model:
    """A weight for each place, what every sentence starts from, and the chance of a bag without words."""

    places: np.ndarray
    values: np.ndarray
    bias: float
    empty: float

    def scorer(self):
        weight = np.zeros(1 << BITS)
        weight[self.places] = self.values

        def score(text: bytes) -> tuple[float, np.ndarray]:
            """The document's chance and its sentences'."""
            words, sentence, n = sentence_words(text)
            if not n:
                return self.empty, np.zeros(0)
            s = self.bias + np.bincount(sentence, weights=weight[words], minlength=n)
            return float(-np.expm1(-np.logaddexp(0, s).sum())), 1 / (1 + np.exp(-np.clip(s, -50, 50)))

        return score


def loss_slope(w: np.ndarray, word: np.ndarray, sentence: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The gradient of the bags' weighted log loss by the words' weights and, last, the bias. word: the number of each word that has a weight, sentence: the sentence that it stands in, bag: the bag of each sentence."""
    s = w[-1] + np.bincount(sentence, weights=w[word], minlength=len(bag))
    p = 1 / (1 + np.exp(-np.clip(s, -50, 50)))
    clean = np.exp(-np.bincount(bag, weights=np.logaddexp(0, s), minlength=len(y)))
    slope = np.where(y > 0, -clean / np.maximum(1e-9, 1 - clean), 1.0) * weight
    d = p * slope[bag]
    return np.append(np.bincount(word, weights=d[sentence], minlength=len(w) - 1), d.sum())


def train(bags: list[tuple[np.ndarray, np.ndarray, int]], y: np.ndarray, weight: np.ndarray, rounds: int = 250, ridge: float = 2e-4) -> Model:
    """Weights under which the noisy-or of the sentences explains the labels; gradient descent with Adam over all bags."""
    prior = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
    holds, toxic = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for (words, _, _), label in zip(bags, y, strict=True):
        once = np.unique(words)
        holds[once] += 1
        toxic[once] += label
    expected = holds * y.mean()
    places = np.flatnonzero((holds >= RARE) & (np.abs(toxic - expected) >= SURE * np.sqrt(np.maximum(1e-9, expected * (1 - y.mean())))))
    if y.min() == y.max() or not len(places):
        return Model(places[:0], np.zeros(0), -30.0, prior)
    number = np.full(1 << BITS, -1, np.int32)
    number[places] = np.arange(len(places))
    first = np.cumsum([0, *(n for _, _, n in bags)])
    kept = []  # of each bag only the words that have a weight
    for (words, inside, _), start in zip(bags, first[:-1], strict=True):
        at = number[words]
        some = at >= 0
        kept.append((at[some], inside[some] + start))
    word, sentence = (np.concatenate(x) for x in zip(*kept, strict=True))
    bag = np.repeat(np.arange(len(bags)), np.diff(first))
    w, weight = np.zeros(len(places) + 1), weight / weight.sum()
    w[-1] = np.log(prior / 4 / max(1.0, first[-1] / len(bags)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = loss_slope(w, word, sentence, bag, y, weight)
        g[:-1] += ridge * w[:-1] / len(places) ** 0.5
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (1 - t / rounds / 1.1) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(places.astype(np.int32), w[:-1], float(w[-1]), 0.0)


def fit(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the documents that labels names and that aren't held out."""
    docs = small_batches(docs)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    total = dict(known.groupBy("y").count().collect())  # two rows
    order = F.xxhash64("id", F.lit(2))
    chosen = [known.filter(F.col("y") == k).orderBy(order, "id").limit(n) for k, n in ((1, positive), (0, negative))]
    few = chosen[0].unionByName(chosen[1])  # at most positive + negative ids
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).withColumn("h", F.coalesce(F.xxhash64("t"), F.lit(0)))
    seen = named.join(F.broadcast(few), "id").groupBy("y", "id").agg(F.min(F.struct("h", F.coalesce(F.octet_length("t"), F.lit(0)).alias("n"))).alias("s"))
    rows = seen.select("y", "id", "s.h", "s.n", order.alias("o")).toPandas().sort_values(["y", "o", "id"])  # no texts
    rows = rows[rows.groupby("y")["n"].cumsum() <= sample]
    if rows.empty:
        return Model(np.zeros(0, np.int32), np.zeros(0), -30.0, 0.0)
    picked = docs.sparkSession.createDataFrame(list(zip(rows["y"].tolist(), rows["id"].tolist(), rows["h"].tolist(), strict=True)), f"y int, id {docs.schema[id_col].dataType.simpleString()}, h long")

    def bags(batches):
        for batch in batches:
            data = texts(batch, "t")
            for a, b in slices([len(x) for x in data]):
                words, sentences, n = zip(*map(sentence_words, data[a:b]), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([x.tobytes() for x in words], pa.binary()), pa.array([np.bincount(x).astype(np.int32).tobytes() for x in sentences], pa.binary())], names=["y", "id", "w", "s"])

    found = named.join(F.broadcast(picked), ["id", "h"]).select("y", "id", "t").mapInArrow(bags, f"y int, id {docs.schema[id_col].dataType.simpleString()}, w binary, s binary")
    rows = found.groupBy("y", "id").agg(F.first("w").alias("w"), F.first("s").alias("s")).toPandas().sort_values(["y", "id"])  # rows that repeat are alike
    y = rows["y"].to_numpy()
    share = np.array([total.get(0, 0) / max(1, (y == 0).sum()), total.get(1, 0) / max(1, (y == 1).sum())])
    sizes = [np.frombuffer(s, np.int32) for s in rows["s"]]  # words of each sentence
    model = train([(np.frombuffer(w, np.int32), np.repeat(np.arange(len(s), dtype=np.int32), s), len(s)) for w, s in zip(rows["w"], sizes, strict=True)], y, share[y])
    del rows, sizes
    release_memory()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs' columns with score and offending, the sentences at 0.5 or more as (begin, end, score) by characters."""
    docs = small_batches(without(docs, "score", "offending"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights at most: 12 MB
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        rate = shared.value.scorer()
        for batch in batches:
            chance, offending = [], []
            for text in texts(batch, text_col):
                p, each = rate(text)
                chance.append(p)
                bad = np.flatnonzero(each >= 0.5)
                at = spans(text) if len(bad) else []
                offending.append([{"begin": at[i][0], "end": at[i][1], "score": float(each[i])} for i in bad])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance, pa.float64()), pa.array(offending, kind)], names=[*batch.schema.names, "score", "offending"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(giving_back(run), f"{schema}, score double, offending array<struct<begin:int,end:int,score:double>>")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance of every document to be toxic, learned from the labels that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"), F.try_element_at("offending", F.lit(1))["begin"].alias("first_begin"), F.try_element_at("offending", F.lit(1))["end"].alias("first_end"))
