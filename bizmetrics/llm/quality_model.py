"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage of the whole text is encoded from its bytes
and words (shares of character classes, word lengths, repetition within the passage and of earlier parts of the
document, hashed words). Gated attention, tanh(V h) * sigmoid(U h), weighs the passages; the document's score is a logistic
unit on the weighted passage representation. Labels belong to documents only; which passages matter is learned.

The model is written in numpy and trained on the driver on a bounded sample: ``train_rows`` labelled documents, those
with the lowest hash of their id, never with the label, language, source or id as an input. Encoding the sample and
scoring all documents run in Arrow batches on the executors.

Defined results: null and empty texts are a bag of one empty passage and get a score; labels outside 0 and 1, null labels
and labels without a document are ignored; without labels of both kinds every score is the share of label 1 (0.5 when there is
none); rows with equal ids are scored separately; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from bizmetrics.llm.hashing import pieces
from bizmetrics.llm.text import free_names

PASSAGE_WORDS = 64
HASHED, PLAIN, ENCODED, GATE = 16, 13, 16, 8
INPUTS = HASHED + PLAIN


def _classes() -> np.ndarray:
    table = np.zeros((256, 6), np.float64)
    for byte in range(256):
        char = chr(byte)
        kind = 0 if char.islower() and byte < 128 else 1 if char.isupper() and byte < 128 else 2 if char.isdigit() and byte < 128 else 5 if byte > 127 else None
        if kind is None and 32 < byte < 127:
            kind = 3 if char in ".,;:'\"()-" else 4
        if kind is not None:
            table[byte, kind] = 1
    return table.astype(np.uint8)


_CLASS = _classes()


def encode(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For some consecutive texts at a time: number of passages of each text, and one row of inputs per passage."""
    for piece in pieces(column):
        hashes = piece.word_hashes(lower=True)
        texts = len(piece.offsets) - 1
        per_text = np.diff(piece.offsets)
        bags = np.maximum(1, -(-per_text // PASSAGE_WORDS))
        first = np.concatenate([[0], np.cumsum(bags)])
        rows = np.zeros((first[-1], INPUTS), np.float32)
        if len(hashes):
            owner = np.repeat(np.arange(texts), per_text)
            place = np.arange(len(hashes)) - piece.offsets[owner]
            passage = first[owner] + place // PASSAGE_WORDS
            n = np.bincount(passage, minlength=len(rows)).astype(np.float32)
            some = np.maximum(n, 1)
            lengths = (piece.ends - piece.starts).astype(np.float64)
            total = np.maximum(np.bincount(passage, lengths, len(rows)), 1)
            edge = np.flatnonzero(np.diff(passage, prepend=-1))
            held = passage[edge]
            for kind in range(6):
                sums = np.concatenate([[0], np.cumsum(_CLASS[:, kind][piece.data], dtype=np.int64)])
                rows[held, kind] = np.add.reduceat((sums[piece.ends] - sums[piece.starts]).astype(np.float64), edge) / total[held]
            # Previous place of the same word in the same text, by one stable sort.
            key = (owner.astype(np.uint64) << np.uint64(40)) ^ (hashes >> np.uint64(24))
            order = np.argsort(key, kind="stable")
            again = np.flatnonzero(key[order][1:] == key[order][:-1])
            back = np.zeros(len(hashes), np.int64)
            back[order[again + 1]] = order[again + 1] - order[again]
            seen = back > 0
            rows[:, 6] = np.bincount(passage, seen, len(rows)) / some
            rows[:, 7] = np.bincount(passage, seen & (back == 1), len(rows)) / some
            rows[:, 8] = np.bincount(passage, seen & (back <= 16), len(rows)) / some
            steady = seen & (np.diff(back, prepend=-1) == 0)
            rows[:, 9] = np.bincount(passage, steady, len(rows)) / some
            rows[:, 10] = total / some / 10
            rows[:, 11] = np.log1p(n) / 4
            rows[:, 12] = np.bincount(passage, lengths == 1, len(rows)) / some
            cell = passage * HASHED + (hashes % np.uint64(HASHED)).astype(np.int64)
            words = np.bincount(cell, minlength=len(rows) * HASHED).reshape(-1, HASHED)
            rows[:, PLAIN:] = words / some[:, None]
        yield bags, rows


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def forward(net: dict[str, np.ndarray], rows: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
    start = np.concatenate([[0], np.cumsum(bags)[:-1]])
    owner = np.repeat(np.arange(len(bags)), bags)
    scaled = (rows - net["mean"]) / net["spread"]
    h = np.tanh(scaled @ net["W"] + net["b"])
    v, u = np.tanh(h @ net["V"]), _sigmoid(h @ net["U"])
    logits = (v * u) @ net["w"]
    weights = np.exp(logits - np.maximum.reduceat(logits, start)[owner])
    weights /= np.add.reduceat(weights, start)[owner]
    z = np.add.reduceat(weights[:, None] * h, start)
    score = _sigmoid(z @ net["c"] + net["d"][0])
    return {"start": start, "owner": owner, "scaled": scaled, "h": h, "v": v, "u": u, "weights": weights, "z": z, "score": score}


def _gradients(net, rows, bags, labels) -> dict[str, np.ndarray]:
    f = forward(net, rows, bags)
    error = (f["score"] - labels) / len(labels)
    dz = error[:, None] * net["c"]
    dh = f["weights"][:, None] * dz[f["owner"]]
    pull = (f["h"] * dz[f["owner"]]).sum(1)
    dl = f["weights"] * (pull - np.add.reduceat(f["weights"] * pull, f["start"])[f["owner"]])
    dv = dl[:, None] * net["w"] * f["u"] * (1 - f["v"] ** 2)
    du = dl[:, None] * net["w"] * f["v"] * f["u"] * (1 - f["u"])
    dh = (dh + dv @ net["V"].T + du @ net["U"].T) * (1 - f["h"] ** 2)
    return {
        "W": f["scaled"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ dl,
        "c": f["z"].T @ error, "d": error.sum(keepdims=True),
    }


def train(examples: list[tuple[np.ndarray, int]], *, epochs: int = 40, seed: int = 0, decay: float = 1e-4) -> dict[str, np.ndarray]:
    """``examples``: passage rows and label of each document, with both labels present."""
    rng = np.random.default_rng(seed)
    stacked = np.concatenate([rows for rows, _ in examples])
    net = {
        "W": rng.normal(0, INPUTS**-0.5, (INPUTS, ENCODED)), "b": np.zeros(ENCODED), "V": rng.normal(0, 0.25, (ENCODED, GATE)),
        "U": rng.normal(0, 0.25, (ENCODED, GATE)), "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.25, ENCODED), "d": np.zeros(1),
    }
    learned = list(net)
    net |= {"mean": stacked.mean(0), "spread": stacked.std(0) + 1e-2}
    first, second = ({k: np.zeros_like(net[k]) for k in learned} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), 64):
            chosen = [examples[i] for i in order[at : at + 64]]
            bags = np.array([len(rows) for rows, _ in chosen])
            labels = np.array([label for _, label in chosen], float)
            grads = _gradients(net, np.concatenate([rows for rows, _ in chosen]), bags, labels)
            step += 1
            for k in learned:
                grad = grads[k] + decay * net[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.99 * second[k] + 0.01 * grad**2
                net[k] = net[k] - 0.01 * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned from: crc32 of the id as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _encoded(sample: DataFrame) -> list[tuple[np.ndarray, int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for bags, rows in encode(batch.column(0)):
                packed += [part.tobytes() for part in np.split(rows, np.cumsum(bags)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1)], ["rows", "label"])

    found = sample.mapInArrow(run, "rows binary, label int").collect()
    return [(np.frombuffer(r.rows, np.float32).reshape(-1, INPUTS), r.label) for r in found]


def with_scores(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    train_rows: int = 3_000,
    name: str = "quality_score",
) -> DataFrame:
    """``docs`` with the score in the new column ``name``. Rows stay where they are."""
    if name in docs.columns:
        raise ValueError(f"docs already has a column {name}")
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    usable = labels.select(F.col(id_column).alias("doc_id"), F.col(label).cast("int").alias("label"))
    usable = usable.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # At most train_rows rows.
    sample = source.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id", "text")).limit(train_rows)
    examples = _encoded(sample.select("text", "label"))
    marks = [mark for _, mark in examples]
    net = train(examples) if 0 < sum(marks) < len(marks) else None
    share = sum(marks) / len(marks) if marks else 0.5
    shared = source.sparkSession.sparkContext.broadcast((net, share))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, constant = shared.value
        for batch in batches:
            scores = [np.empty(0)]
            for bags, rows in encode(batch.column(place)):
                scores.append(forward(model, rows, bags)["score"] if model else np.full(len(bags), constant))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(scores), pa.float64())], [*batch.schema.names, name]
            )

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score_quality(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = with_scores(docs.select(id_column, text), labels, id_column=id_column, text=text, name="score", **options)
    return scored.select(
        F.col(id_column).alias("doc_id"),
        held_out(F.col(id_column)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    (name,) = free_names(docs, "quality_score")
    return with_scores(docs, labels, name=name, **options).where(F.col(name) >= threshold).drop(name)
