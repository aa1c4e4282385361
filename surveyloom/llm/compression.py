"""Quality scores from compressed sizes.

Two zstandard dictionaries are trained, on texts labelled good and on texts labelled bad.  A
text is compressed whole with either and with none.  The difference of the two sizes, divided by
the text's length, says which side it resembles; with the sizes themselves and the length it is
calibrated by logistic regression to the chance that the label is 1.

A dictionary is trained on pieces from all over the drawn documents, shorter ones whole.

Labels are learnt from the rows that ``learn`` admits only.  Dictionaries and calibration use
different rows, each drawn by hash: at most about FIT_DOCS documents per label and purpose, so
that fitting has a fixed size.  Every document is scored, from its text alone.

* A null text is an empty one and gets a score too.  Null ids are scored, and not held out.
* Null labels are ignored; of several for an id the lowest counts.
* With labels of one kind only, or none, every score is the share of 1 among them, or 0.5.
* Other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from surveyloom.llm.segments import text_bytes

FIT_DOCS = 4000  # per label and purpose, about
PIECES, PIECE_CHARS = 8, 250  # of a document longer than both together, at hashed places: what a dictionary is trained on
DICTIONARY_BYTES = 112 << 10
LEVEL = 3


class Sizes:
    """Compressed sizes of texts under two dictionaries and none."""

    def __init__(self, good: bytes, bad: bytes):
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False}
        self.plain = zstandard.ZstdCompressor(**options)
        self.good, self.bad = (zstandard.ZstdCompressor(dict_data=self._known(d), **options) for d in (good, bad))

    @staticmethod
    def _known(raw: bytes):
        known = zstandard.ZstdCompressionDict(raw)
        known.precompute_compress(level=LEVEL)
        return known

    def features(self, column) -> np.ndarray:
        data, offsets = text_bytes(column)
        raw, cuts = memoryview(data), offsets.tolist()
        out = np.empty((offsets.size - 1, 5))
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            own, n = raw[a:b], b - a + 20
            good, bad, plain = (len(c.compress(own)) for c in (self.good, self.bad, self.plain))
            out[i] = (bad - good) / n, good / n, bad / n, plain / n, np.log(n)
        return out


def _dictionary(texts: list[str]) -> bytes:
    samples = sorted({t.encode() for t in texts if t})
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:  # too few to train on: the texts themselves serve
        return b"\n".join(samples)[:DICTIONARY_BYTES].ljust(8)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the constant first) on standardised columns, by Newton steps that stop at a likelihood no longer rising."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 0

    def loss(w):
        t = z @ w
        return np.logaddexp(0, t).sum() - (y * t).sum() + 0.5 * (penalty * w * w).sum()

    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, z.T @ (y - p) - penalty * w)
        scale = 1.0
        while scale > 1e-6 and loss(w + scale * step) > loss(w):
            scale /= 2
        w = w + scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    return w, mean, sd


def _size_features(good: bytes, bad: bytes):
    def compute(batches):
        sizes = Sizes(good, bad)
        for batch in batches:
            columns = [pa.array(c) for c in sizes.features(batch.column(0)).T]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], [*"abcde", "quality"])

    return compute


def _pieces(text: Column, ident: Column) -> Column:
    """PIECES stretches of a text, at places by hash; a text no longer than they are together is one."""
    text = F.coalesce(text, F.lit(""))
    room = F.length(text) - PIECE_CHARS + 1
    at = lambda k: F.pmod(F.xxhash64(ident, k), room).cast("int") + 1
    cut = F.transform(F.array(*[F.lit(k) for k in range(PIECES)]), lambda k: text.substr(at(k), F.lit(PIECE_CHARS)))
    return F.when(F.length(text) <= PIECES * PIECE_CHARS, F.array(text)).otherwise(cut)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """A model (two dictionaries and a calibration) from the labelled rows that ``learn``, a condition on doc_id, admits."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 1).cast("int").alias("quality"))
    known = known.where(learn).withColumn("purpose", F.pmod(F.xxhash64("doc_id", F.lit("purpose")), F.lit(2)))
    counts = {(r["purpose"], r["quality"]): r["count"] for r in known.groupBy("purpose", "quality").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 30))
    chosen = F.lit(False)
    for (purpose, quality), n in counts.items():
        below = int(min(1.0, FIT_DOCS / n) * (1 << 30))
        chosen = chosen | ((F.col("purpose") == purpose) & (F.col("quality") == quality) & (draw < below))
    # At most 4 x FIT_DOCS rows on average, and never over twice as many: small enough to send to the documents.
    drawn = known.where(chosen).limit(8 * FIT_DOCS).withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "_id")
    texts = rows.where("purpose = 0").select(_pieces(F.col("text"), F.col("_id")).alias("texts"), "quality").limit(4 * FIT_DOCS).collect()
    share = [n * q for (_, q), n in counts.items()], list(counts.values())
    constant = sum(share[0]) / sum(share[1]) if counts else 0.5
    sides = [[t for r in texts if r["quality"] == q for t in r["texts"]] for q in (1, 0)]
    if not all(sides):
        return {"constant": constant}
    good, bad = (_dictionary(side) for side in sides)
    measured = rows.where("purpose = 1").select("text", "quality").mapInArrow(_size_features(good, bad), "a double, b double, c double, d double, e double, quality int")
    table = np.array(measured.limit(4 * FIT_DOCS).collect(), float).reshape(-1, 6)
    if np.unique(table[:, 5]).size < 2:
        return {"constant": constant}
    weights, mean, sd = _logistic(table[:, :5], table[:, 5])
    return {"good": good, "bad": bad, "weights": weights, "mean": mean, "sd": sd}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every whole text."""

    def compute(batches):
        sizes = Sizes(model["good"], model["bad"]) if "good" in model else None
        for batch in batches:
            if sizes is None:
                p = np.full(batch.num_rows, float(model["constant"]))
            else:
                z = (sizes.features(batch.column(1)) - model["mean"]) / model["sd"]
                p = 1 / (1 + np.exp(-np.clip(model["weights"][0] + z @ model["weights"][1:], -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(id_col, text_col).mapInArrow(compute, schema)
