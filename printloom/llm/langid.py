"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters (lower case) make n-grams of one to three, hashed into bins. Document frequencies of the bins and counts of
the languages come from all training documents. Weights are trained by follow-the-regularised-leader with L1 and L2
penalties on a bounded, hash-chosen sample of SAMPLE_PER_LANGUAGE documents a language (rows that repeat an id and its
text count once in it), a fifth of which is kept apart to fit the temperature by which scores are calibrated.

Cases: null texts and texts without a letter (a character of one of Unicode's letter categories) get ``und`` with score 1; rows with a null language teach nothing; a
training set without languages gives ``und`` with score 0 for all; whole texts are read, in parts; ties go to the
language that sorts first; repeated rows give repeated results; an empty table gives an empty one; other columns are
not read.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from printloom.llm.common import CHUNK_ROWS, chunks, crc_mod, written

#: Bins of hashed n-grams; longest n-gram; characters hashed at once.
BINS, ORDER, PART = 1 << 14, 3, 1 << 18
#: The bounds of the labelled sample: documents of a language, languages (the most frequent labels teach, others do not),
#: and bytes of all features, beyond which the documents of greatest hash are left out.
SAMPLE_PER_LANGUAGE, MAX_LANGUAGES, SAMPLE_BYTES = 600, 1000, 1 << 26
#: FTRL: learning rate, smoothing of it, L1, L2, passes.
ALPHA, BETA, L1, L2, PASSES = 0.3, 1.0, 0.02, 0.01, 4
#: Below this score a document is rejected.
REJECT_BELOW = 0.5
UNKNOWN = "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def bin_counts(text: str) -> np.ndarray:
    """How often each bin's n-grams stand in the whole text."""
    out = np.zeros(BINS, np.int64)
    low = text.lower()
    for at in range(0, len(low), PART):
        # parts overlap by what an n-gram needs; an n-gram counts where it begins
        c = np.frombuffer(low[at : at + PART + ORDER - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n, h = min(PART, len(low) - at), np.zeros(len(c), np.uint64)
        for order in range(ORDER):
            own = c[order:]
            h = (h[: len(own)] + own + np.uint64(1)) * _MIX
            h ^= h >> np.uint64(29)
            out += np.bincount(((h[:n] * _MIX) >> _SHIFT).astype(np.int64), minlength=BINS)
    return out


def features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins and their TF-IDF, of length 1."""
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    norm = math.sqrt(float(x @ x))
    return at, x / norm if norm else x


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # bins x languages
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text):
            return UNKNOWN, 1.0
        if not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*features(bin_counts(text), self.idf)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], min(1.0, float(p[best]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after ``passes`` over the examples, in the order given.

    Per coordinate z and n are kept; a weight is zero where |z| is within L1, else the closed form of the proximal step.
    """
    z, n = np.zeros((BINS + 1, classes)), np.zeros((BINS + 1, classes))

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(passes):
        for at, x, label in examples:
            at, x = np.append(at, BINS), np.append(x, 1.0)  # the last coordinate is the bias
            w = weights(at)
            error = softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
            n[at] = more
    w = weights(np.arange(BINS + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature in [0.05, 20] of least negative log likelihood, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / math.exp(t))
        return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    a, b = math.log(0.05), math.log(20.0)
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return math.exp((a + b) / 2)


def fit(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from the rows for which ``training`` holds, from text and language alone."""
    labelled = docs.where(training & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    sizes = {r["l"]: r["count"] for r in labelled.groupBy("l").count().orderBy(F.desc("count"), "l").limit(MAX_LANGUAGES).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(BINS), np.zeros((BINS, 0)), np.zeros(0))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(BINS, np.int64), 0
        for (texts,) in chunks(batches, "t"):
            for t in texts:
                found += bin_counts(t) > 0
                rows += 1
        at = np.flatnonzero(found)
        yield pa.record_batch({"bin": pa.array([*at.tolist(), -1], pa.int64()), "n": pa.array([*found[at].tolist(), rows], pa.int64())})

    df = {r["bin"]: r["n"] for r in labelled.select("t").mapInArrow(frequencies, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    total = df.pop(-1, 0)
    idf = np.zeros(BINS)
    for i, n in df.items():
        idf[i] = math.log((1 + total) / (1 + n)) + 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts, labels in chunks(batches, "h", "t", "l"):
            own = [features(bin_counts(t), idf) for t in texts]
            yield pa.record_batch({"h": pa.array(keys, pa.int64()), "l": pa.array(labels, pa.string()), "at": pa.array([a.astype(np.int32).tobytes() for a, _ in own], pa.binary()), "x": pa.array([x.astype(np.float32).tobytes() for _, x in own], pa.binary())})

    chance = F.element_at(F.create_map(*[F.lit(v) for name in languages for v in (name, min(1.0, sample / sizes[name]))]), F.col("l"))
    hashed = labelled.withColumn("h", F.xxhash64(F.col("k").cast("string"), "t", F.lit(11)))
    picked = hashed.where(F.pmod("h", F.lit(1 << 30)) < chance * (1 << 30)).select("h", "t", "l").dropDuplicates(["h", "l"])
    vectors = written(picked.mapInArrow(counted, "h long, l string, at binary, x binary"))
    weighed = sorted((r["h"], r["size"]) for r in vectors.select("h", (2 * F.length("at")).alias("size")).collect())  # some 2 * SAMPLE_PER_LANGUAGE * MAX_LANGUAGES at most
    total_bytes = list(accumulate(size for _, size in weighed))
    fits = bisect_right(total_bytes, SAMPLE_BYTES)
    kept = vectors if fits == len(weighed) else vectors.where(F.col("h") < weighed[fits][0])
    rows = sorted(kept.collect(), key=lambda r: (r["h"], r["l"], r["at"]))
    number = {name: i for i, name in enumerate(languages)}
    examples = [(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["x"], np.float32).astype(np.float64), number[r["l"]]) for r in rows]
    apart = examples[::5] if len(examples) >= 10 else []
    weights, bias = train_ftrl([e for i, e in enumerate(examples) if i % 5 or not apart], len(languages))
    model = Model(languages, idf, weights, bias)
    if apart:
        model.temperature = fit_temperature(np.array([model.logits(a, x) for a, x, _ in apart]), np.array([y for *_, y in apart]))
    return model


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, lang_pred and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS x MAX_LANGUAGES numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in chunks(batches, "k", "t"):
            found = [shared.value.predict(t) for t in texts]
            yield pa.record_batch({"k": pa.array(keys), "lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64())})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, lang_pred string, score double").withColumnRenamed("k", key)


def training_rows(key: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(key, 4) != 2, F.lit(False))


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", below: float = REJECT_BELOW) -> DataFrame:
    """The rows whose text is in one of the learned languages with a score of at least ``below``; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, training_rows(key), key, text, lang))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                found = [shared.value.predict(t) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                yield part.filter(pa.array([name != UNKNOWN and score >= below for name, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
