"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded (measured, standardised and sent through a layer); gated attention
weighs the encodings; the document's score comes from their weighted sum. Only documents are labelled, so the attention
learns from them which passages decide. Scores use sums in a fixed order, so a text's score does not depend on the texts
that are scored with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import documents, released
from postloom.llm.textscan import Scan, scans
from postloom.session import ship

#: Words of a passage; the model is fitted on at most so many labelled documents, those with the smallest hashes, and on at
#: most so many passages of each, evenly spaced over the text. Scores use all passages.
PASSAGE, TRAIN_DOCS, TRAIN_PASSAGES = 48, 6000, 128
#: Sizes of the encoding and of the attention; steps, documents of a step, rate of the fit and decay of the weights.
ENCODING, ATTENTION, STEPS, BATCH, RATE, DECAY = 16, 8, 600, 512, 0.02, 1e-4
FOLDS, THRESHOLD = 5, 0.3


def _class(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Byte classes that are counted in words.
CLASSES = (_class(range(65, 91)), _class(range(97, 123)), _class(range(48, 58)), _class(b"#*$%&|<>"), _class(b"!"), _class(b".,;:?"), _class(b"@/\\_=+~^{}[]()"), _class(range(0xC0, 0x100)))
N_FEATURES = 3 * len(CLASSES) + 9


def passages(scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Measurements of every passage, and each document's first passage; a document without words has one, all zeros."""
    counts = scan.counts()
    n_passages = np.maximum(1, -(-counts // PASSAGE))
    first = np.concatenate(([0], np.cumsum(n_passages)))
    docs = scan.word_docs()
    at = first[docs] + (np.arange(len(docs)) - scan.first[docs]) // PASSAGE
    n = first[-1]
    words = np.bincount(at, minlength=n)
    total = np.maximum(words, 1)
    mean = lambda x: np.bincount(at, x, minlength=n) / total
    sums = np.zeros(len(scan.data) + 1, np.int64)

    def in_words(marks: np.ndarray) -> np.ndarray:
        np.cumsum(marks, out=sums[1:])
        return sums[scan.ends] - sums[scan.starts]

    length = in_words((scan.data & 0xC0) != 0x80)
    out, lead, last = [], scan.data[scan.starts], scan.data[scan.ends - 1]
    for chars in CLASSES:
        marked = chars[scan.data]
        k = in_words(marked)
        out += [np.bincount(at, k, minlength=n) / np.maximum(np.bincount(at, length, minlength=n), 1), mean(k == length), mean(marked[scan.ends - 1])]
    hashes = scan.words()
    before = lambda k: np.concatenate((np.zeros(min(k, len(hashes)), bool), (hashes[k:] == hashes[:-k]) & (docs[k:] == docs[:-k]))) if len(hashes) else np.zeros(0, bool)
    order = np.lexsort((hashes, at))
    new = np.ones(len(order), bool)
    new[1:] = (at[order][1:] != at[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    out += [mean(before(1)), mean(before(2)), np.bincount(at[order][new], minlength=n) / total, mean(length) / 10, np.sqrt(np.maximum(0, mean(length**2) - mean(length) ** 2)) / 10]
    out += [mean(length == 1), mean((lead >= 65) & (lead < 91)), mean(last == lead), np.log1p(words) / 4]
    return np.stack(out, 1).astype(np.float32) * (words > 0)[:, None], first


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w, starts = self.weights, first[:-1]
        bag = np.repeat(np.arange(len(starts)), np.diff(first))
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(product(x, w["encode"]) + w["encode0"])
        t, g = np.tanh(product(h, w["tanh"])), sigmoid(product(h, w["gate"]))
        e = product(t * g, w["attend"][:, None])[:, 0]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag, "score": sigmoid(product(z, w["out"][:, None])[:, 0] + w["out0"])}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)["score"]


def product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w with every row's terms added one after another: what a row gives does not depend on the rows beside it, as it
    does in a blocked product."""
    out = np.zeros((len(x), w.shape[1]))
    for k in range(len(w)):
        out += x[:, k, None] * w[k]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 7) -> Model | None:
    """Minimise the log loss with Adam; None unless both labels are there."""
    if len(y) == 0 or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    init = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
    w = {"encode": init(d, ENCODING), "encode0": np.zeros(ENCODING), "tanh": init(ENCODING, ATTENTION), "gate": init(ENCODING, ATTENTION), "attend": init(ATTENTION), "out": init(ENCODING), "out0": np.zeros(1)}
    model = Model(x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-3, w)
    m, v = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    sizes, queue = np.diff(first), np.empty(0, np.int64)
    for step in range(1, STEPS + 1):
        if len(queue) < min(BATCH, len(y)):
            queue = np.concatenate((queue, rng.permutation(len(y))))
        docs, queue = np.sort(queue[:BATCH]), queue[BATCH:]
        to = np.concatenate(([0], np.cumsum(sizes[docs])))
        rows = np.arange(to[-1]) + np.repeat(first[docs] - to[:-1], sizes[docs])
        f = model.forward(x[rows].astype(np.float64), to)
        ds = (f["score"] - y[docs]) / len(docs)
        dz = ds[:, None] * w["out"]
        da = (dz[f["bag"]] * f["h"]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, to[:-1])[f["bag"]])
        dt, dg = de[:, None] * w["attend"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * w["attend"] * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dz[f["bag"]] + dt @ w["tanh"].T + dg @ w["gate"].T
        dp = dh * (1 - f["h"] ** 2)
        grads = {"encode": f["x"].T @ dp, "encode0": dp.sum(0), "tanh": f["h"].T @ dt, "gate": f["h"].T @ dg, "attend": (f["t"] * f["g"]).T @ de, "out": f["z"].T @ ds, "out0": ds.sum(keepdims=True)}
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))  # falls over the second half
        for k, p in w.items():
            g = grads[k] + DECAY * p
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS, train_passages: int = TRAIN_PASSAGES) -> Model | None:
    """Fit on at most train_docs labelled documents outside the held-out fold, and train_passages passages of each, which
    bounds what the driver holds. Identifiers with several labels count as the larger; rows without one are left out."""
    ship(docs.sparkSession)
    use = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (remainder(F.col(id_col)) != 0))
    use = use.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    use = use.orderBy(F.xxhash64("_id"), "_id").limit(train_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, scan in scans(batch.column("text")):
                x, first = passages(scan)
                bags = [x[first[i] : first[i + 1]] for i in range(b - a)]
                bags = [bag if len(bag) <= train_passages else bag[np.arange(train_passages) * len(bag) // train_passages] for bag in bags]
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(a, b - a), batch.column("_label").slice(a, b - a), pa.array([bag.tobytes() for bag in bags], pa.binary())], ["_id", "_label", "x"])

    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(use), F.col("_doc") == F.col("_id"))
    rows = rows.select("_id", "_label", "text")
    found = rows.mapInArrow(released(run), f"_id {dict(rows.dtypes)['_id']}, _label int, x binary").toPandas().sort_values(["_id", "x"])
    bags = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in found["x"]]
    if not bags:
        return None
    return fit(np.concatenate(bags), np.concatenate(([0], np.cumsum([len(b) for b in bags]))), found["_label"].to_numpy(float))


def score_quality(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, n_passages.

    Null and blank texts are scored as one empty passage. Without a model (no labels, or one kind only) every score is 0.5.
    A null identifier counts as the empty text for the fold. An empty table gives no rows; rows that repeat are scored each;
    other columns are ignored.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, scan in scans(batch.column("text")):
                x, first = passages(scan)
                score = sent.value.score(x, first) if sent.value else np.full(b - a, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(score, pa.float64()), pa.array(np.diff(first), pa.int64())], ["doc_id", "score", "n_passages"])

    scored = rows.mapInArrow(released(run), f"doc_id {dict(rows.dtypes)['doc_id']}, score double, n_passages bigint")
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages")


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, train(docs, labels)).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op3_quality_model": op3_quality_model}
ORACLES = {}
