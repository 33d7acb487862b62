"""Quality of whole texts by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded; learned filters run over overlapping chunks of ``WIDTH`` bytes, one every
``STRIDE``, from the first byte to the last. Responses are max-pooled per stretch of ``POOL`` chunks, the stretches'
maxima are joined by their mean and maximum, and one logistic unit turns these into a probability. Through a
maximum only the winning chunk receives a gradient, so training costs little more than scoring.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow, released, sample_ids, store, whole

EMBEDDED, WIDTH, STRIDE, FILTERS, POOL = 8, 8, 4, 24, 64
#: Training sample: labelled documents per class and longest text, in order of a hash of the id.
SAMPLE_PER_CLASS, SAMPLE_CHARS = 600, 32_768
EPOCHS, BATCH, RATE, DECAY = 12, 32, 0.01, 1e-4
SEED = 20

Model = dict[str, np.ndarray]


def _chunks(data: bytes) -> np.ndarray:
    """``(stretches * POOL, WIDTH)`` byte values plus one; zero stands for the space after the text."""
    count = max(1, -(-max(len(data) - WIDTH, 0) // STRIDE) + 1)
    padded = -(-count // POOL) * POOL
    values = np.zeros((padded - 1) * STRIDE + WIDTH, dtype=np.int16)
    values[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    values[: len(data)] += 1
    return np.lib.stride_tricks.sliding_window_view(values, WIDTH)[::STRIDE]


def _pooled(model: Model, data: bytes, argmax: bool = False):
    """Maxima per stretch and filter, and with ``argmax`` the chunks they come from."""
    chunks = _chunks(data)
    parts, places = [], []
    for at in range(0, len(chunks), 64 * POOL):  # bounded working memory for any length
        some = chunks[at : at + 64 * POOL]
        response = model["embed"][some].reshape(len(some), -1) @ model["filters"]
        response = response.reshape(-1, POOL, FILTERS)
        parts.append(response.max(axis=1))
        if argmax:
            starts = at + POOL * np.arange(len(response))[:, None]
            places.append(some[(response.argmax(axis=1) + starts - at)])
    pooled = np.maximum(np.concatenate(parts) + model["bias"], 0)
    return (pooled, np.concatenate(places)) if argmax else pooled


def _joined(pooled: np.ndarray) -> np.ndarray:
    return np.concatenate([pooled.mean(axis=0), pooled.max(axis=0)])


def score_text(model: Model, text: str) -> float:
    """Probability of label 1; any text has one, the empty one too."""
    z = float(_joined(_pooled(model, text.encode("utf-8"))) @ model["out"] + model["out_bias"][0])
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _start(rng: np.random.Generator) -> Model:
    return {
        "embed": rng.normal(0, 0.5, (257, EMBEDDED)).astype(np.float32),
        "filters": rng.normal(0, 1 / np.sqrt(WIDTH * EMBEDDED), (WIDTH * EMBEDDED, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        "out_bias": np.zeros(1, np.float32),
    }


def _gradient(model: Model, data: bytes, label: int, weight: float, grads: Model) -> None:
    pooled, winners = _pooled(model, data, argmax=True)
    features = _joined(pooled)
    z = float(features @ model["out"] + model["out_bias"][0])
    delta = np.float32((1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * weight)
    grads["out"] += delta * features
    grads["out_bias"] += delta
    back = np.repeat(delta * model["out"][None, :FILTERS] / len(pooled), len(pooled), axis=0)
    back[pooled.argmax(axis=0), np.arange(FILTERS)] += delta * model["out"][FILTERS:]
    back *= pooled > 0
    grads["bias"] += back.sum(axis=0)
    embedded = model["embed"][winners]  # stretch, filter, position, dimension
    filters = model["filters"].reshape(WIDTH, EMBEDDED, FILTERS)
    grads["filters"] += np.einsum("sfwe,sf->wef", embedded, back, optimize=True).reshape(-1, FILTERS)
    np.add.at(grads["embed"], winners, back[:, :, None, None] * filters.transpose(2, 0, 1)[None])


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Model:
    """Adam on the log-loss with classes weighted equally. One class alone (or none) gives its constant."""
    rng = np.random.default_rng(SEED)
    model = _start(rng)
    positive = sum(labels)
    if positive in (0, len(labels)):
        for value in model.values():
            value[...] = 0
        model["out_bias"][0] = 0 if not labels else 5 if positive else -5
        return model
    weights = {1: len(labels) / (2 * positive), 0: len(labels) / (2 * (len(labels) - positive))}
    data = [x.encode("utf-8") for x in texts]
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH):
            grads = {k: DECAY * v for k, v in model.items()}
            some = order[at : at + BATCH]
            for i in some:
                _gradient(model, data[i], labels[i], weights[labels[i]] / len(some), grads)
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def pack(model: Model) -> bytes:
    out = io.BytesIO()
    np.savez(out, **model)
    return out.getvalue()


def unpack(data: bytes) -> Model:
    with np.load(io.BytesIO(data)) as found:
        return {k: found[k] for k in found.files}


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame) -> bytes:
    """A model from labelled documents outside the held-out third, as bytes.

    The sample is bounded by ``SAMPLE_PER_CLASS`` and ``SAMPLE_CHARS``; it is drawn by a hash of the id, so it is the
    same for any partitioning, and it is fitted in one task. Labels other than 0 and 1 and null ids are left out.
    """
    known = narrow(labels, id="doc_id", label="quality").filter("id is not null and label in (0, 1)").filter(remainder("id") != 1)
    short = narrow(docs, id="doc_id", text=whole("text")).filter(F.length("text") <= SAMPLE_CHARS)
    known = store(short.select("id").join(known, "id").distinct(), "quality-labels")
    chosen = [
        sample_ids(known.filter(F.col("label") == label), SAMPLE_PER_CLASS, SEED).withColumn("label", F.lit(label))
        for label in (0, 1)
    ]
    sample = short.join(F.broadcast(chosen[0].unionByName(chosen[1])), "id")  # bounded by the sample's size

    def run(batches):
        rows = [row for batch in batches for row in batch.to_pylist()]
        rows.sort(key=lambda r: (r["id"], r["label"], r["text"]))
        model = train([r["text"] for r in rows], [r["label"] for r in rows])
        yield pa.record_batch([pa.array([pack(model)], pa.binary())], names=["model"])

    fitted = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return fitted[0]["model"] if fitted else pack(train([], []))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row; repeated rows have one score each, an empty table gives none."""
    narrowed = docs.select("doc_id", "text")
    shipped = docs.sparkSession.sparkContext.broadcast(fit(narrowed, labels))

    def run(batches):
        ready = unpack(shipped.value)
        for batch in batches:
            scores = [score_text(ready, x.as_py()) for x in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = narrow(narrowed, doc_id="doc_id", text=whole("text")).mapInArrow(released(run), "doc_id long, score double")
    return rows.select(
        "doc_id",
        F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The input's rows and columns whose text scores 0.5 or more.

    A missing text is scored as the empty one; rows that repeat stay or go together; an empty table gives none, and
    other columns pass through whatever their names. Rows cross to Python once and only those that stay come back.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        ready = unpack(shipped.value)
        for batch in batches:
            texts = batch.column("row").field("text")
            yield batch.filter(pa.array([score_text(ready, x.as_py() or "") >= 0.5 for x in texts], pa.bool_()))

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(released(run), rows.schema).select("row.*")
