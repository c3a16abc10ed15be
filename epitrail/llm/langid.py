"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text's letters, lower-cased, are cut into subwords (byte n-grams of words with their ends marked), which hash into
rows of an embedding table; the mean of the rows feeds a linear softmax. Both are trained together by
stochastic gradient descent in numpy, on a bounded sample, in one task. A temperature, fitted on a part of the sample that training
never sees, makes the probabilities match the hit rate; texts whose probability is under a threshold, fitted to a
given share of wrongly rejected texts of known languages, are rejected.
"""

from __future__ import annotations

import pickle
import string
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epitrail.llm.common import table

#: At most so many labelled documents train and calibrate the model: those with the smallest hashes.
SAMPLE = 4096
BUCKETS = 1 << 16
DIM = 16
NGRAMS = (2, 3, 4)
UNKNOWN = "und"
#: A text of a known language is rejected about this often at most.
WRONG_REJECTS = 0.0005


def cleaned(text: str) -> bytes:
    """Lower-case letters as UTF-8; runs of anything else are one space, also at the ends."""
    text = text.lower()
    if text.isascii():
        text = text.translate(_ASCII)
    else:
        text = "".join(c if c.isalpha() else " " for c in text) if len(set(text)) > 4096 else text.translate({ord(c): " " for c in set(text) if not c.isalpha()})
    words = text.split()
    return f" {' '.join(words)} ".encode() if words else b""


_ASCII = {i: " " for i in range(128) if chr(i) not in string.ascii_letters}


def subwords(data: bytes, buckets: int = BUCKETS):
    """Bucket numbers of the n-grams of a cleaned text."""
    import numpy as np

    a = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    out = []
    for n in NGRAMS:
        if len(a) < n:
            continue
        h = np.full(len(a) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for i in range(n):
            h ^= a[i : len(a) - n + 1 + i]
            h *= np.uint32(0x01000193)
        out.append((h ^ (h >> np.uint32(15))) & np.uint32(buckets - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    """Class scores of each bucket (the embeddings times the output layer), bias, temperature and threshold."""

    langs: list[str]
    scores: object
    bias: object
    temperature: float
    threshold: float

    def logits(self, data: bytes):
        import numpy as np

        total, n = np.zeros(len(self.langs)), 0
        for at in range(0, len(data), 1 << 20):  # long texts go block by block; blocks overlap by the longest n-gram less one
            block = data[at : at + (1 << 20) + max(NGRAMS) - 1]
            counts = np.bincount(subwords(block), minlength=len(self.scores))
            total += counts @ self.scores
            n += int(counts.sum())
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, probability, rejected."""
        import numpy as np

        data = cleaned(text) if text else b""
        if not data or not self.langs:
            return UNKNOWN, 0.0, True
        z = self.logits(data) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.threshold)


def figures(text: str | None):
    """The subword buckets of a text in ascending order and how often each is met, at most :data:`BUCKETS` of them; None if there is no letter."""
    import numpy as np

    data = cleaned(text) if text else b""
    if not data:
        return None
    total = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(data), 1 << 20):  # by blocks, as in predictions
        total += np.bincount(subwords(data[at : at + (1 << 20) + max(NGRAMS) - 1]), minlength=BUCKETS)
    ids = np.flatnonzero(total)
    return ids.astype(np.uint32), total[ids].astype(np.float32)


def fit(rows: list, epochs: int = 6, rate: float = 20.0, seed: int = 7) -> Model:
    """Train on four fifths of the ``rows`` (:func:`figures`, label), fit temperature and threshold on the rest."""
    import numpy as np

    langs = sorted({label for _, label in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, kept = (order[: len(rows) // 5], order[len(rows) // 5 :]) if len(rows) >= 20 else (order, order)
    table, out, bias = rng.normal(0, 1 / DIM, (BUCKETS, DIM)), np.zeros((DIM, len(langs))), np.zeros(len(langs))
    number = {x: i for i, x in enumerate(langs)}
    steps, step = epochs * len(kept), 0
    for _ in range(epochs):
        for i in rng.permutation(kept):
            (ids, counts), label = rows[i]
            weight = counts / counts.sum()
            mean = weight @ table[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[number[label]] -= 1
            lr = rate * (1 - step / steps)
            step += 1
            back = out @ p
            out -= lr * 0.1 * np.outer(mean, p)
            bias -= lr * 0.01 * p
            table[ids] -= lr * weight[:, None] * back
    model = Model(langs, table @ out, bias, 1.0, 0.0)
    z = np.array([(rows[i][0][1] @ model.scores[rows[i][0][0]]) / rows[i][0][1].sum() + bias for i in held])
    y = np.array([number[rows[i][1]] for i in held])

    def probabilities(t: float):
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    def loss(t: float) -> float:
        return float(-np.log(probabilities(t)[np.arange(len(y)), y] + 1e-12).mean())

    model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    best = probabilities(model.temperature).max(axis=1)
    model.threshold = min(0.5, float(np.quantile(best, WRONG_REJECTS)))
    return model


def held_out(doc_id="doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled rows that are not held out: the ``sample`` of them with the smallest hashes of doc_id, whole texts.

    Null texts, languages and doc_ids take no part.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(), F.lit(False)))
    # ids alone are sorted; of rows with one doc_id, that whose text has the smallest hash is taken, so reruns agree
    ids = labelled.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "lang")).alias("first")
    rows = labelled.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(first).select(F.col("doc_id").cast("string").alias("id"), "first.text", "first.lang")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made = [figures(x.as_py()) for x in batch.column("text")]
            some = [i for i, x in enumerate(made) if x is not None]
            own = batch.select(["id", "lang"]).take(pa.array(some, pa.int64()))
            packed = [pa.array([made[i][j].tobytes() for i in some], pa.binary()) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own.columns, *packed], ["id", "lang", "ids", "counts"])

    def learn(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        got = []
        for batch in batches:
            views = zip(*([x.as_buffer() for x in batch.column(c)] for c in ("ids", "counts")))
            got += zip(batch.column("id").to_pylist(), batch.column("lang").to_pylist(), views)
        got.sort(key=lambda x: x[0])
        model = fit([((np.frombuffer(ids, "u4"), np.frombuffer(counts, "f4")), lang) for _, lang, (ids, counts) in got])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(model))], pa.binary())], ["model"])

    # one task reads the figures of at most ``sample`` texts, whatever the texts' lengths; only the model comes to the driver
    figured = rows.mapInArrow(run, "id string, lang string, ids binary, counts binary").repartition(1)
    made = figured.mapInArrow(learn, "model binary").first()
    return Model(**pickle.loads(made.model)) if made else fit([])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of each row of ``docs``.

    A null text or one without letters gives ``und``, score 0, rejected. A null doc_id counts as not held out. A
    table without any labelled row gives ``und`` throughout, an empty one no rows; repeated rows are predicted each. Texts of any
    length are read whole, block by block. Lang, source and doc_id take no part in predictions.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # BUCKETS x languages numbers

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = Model(**shared.value)
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column("text")]
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            rest = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays(rest + columns, [n for n in batch.schema.names if n != "text"] + ["lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = Model(**shared.value)
        for batch in batches:
            keep = [not model.predict(x.as_py())[2] for x in batch.column("text")]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
