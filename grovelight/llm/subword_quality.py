"""Text quality by supervised subword embeddings.

Every word and every run of three or four bytes has a vector, found by hashing into a
table of ``2**BITS`` rows.  A text is the average of its vectors, a linear layer and a
softmax over the two labels follow, and all of it is trained by stochastic gradient
descent, one text at a time with a falling step.  The labelled texts are a bounded
sample of either class (``per_class``); their shares in all labels set the intercept.

Two labels make the finished model one number per table row: how far its vector moves
the log odds.  Scoring averages those numbers over the text, so what tasks receive is a
table of ``2**BITS`` floats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import labelled_sample, small_batches, with_label
from .kernels import LOWER, SPACED, U64, chunks, span_hashes, word_spans

BITS = 18
DIMENSIONS = 16
EPOCHS = 4
STEP = 0.1
#: Labelled texts of either class that are learnt from, at most.
PER_CLASS = 3_000
#: Lengths of the byte runs that have vectors.
RUNS = (3, 4)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - BITS)).astype(np.int32)


def slots(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all words and runs of a chunk, and the text that each belongs to.

    Letters A-Z count as lower case; white space of any kind is the same.
    """
    low = LOWER[data]
    starts, ends, rows = word_spans(low, offs, SPACED)
    low = np.where(SPACED[low], low, np.uint8(32))
    row = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    found, owners = [_slots(span_hashes(low, starts, ends))], [rows.astype(np.int32)]
    wide = low.astype(np.uint32)
    for n in RUNS:
        if len(low) >= n:
            run = np.zeros(len(low) - n + 1, dtype=np.uint32)
            for k in range(n):
                run |= wide[k : len(low) - n + 1 + k] << np.uint32(8 * k)
            inside = row[: len(run)] == row[n - 1 :]
            h = (run.astype(U64) + U64(n << 40)) * U64(0x9E3779B97F4A7C15)
            found.append(_slots(h)[inside])
            owners.append(row[: len(run)][inside])
    return np.concatenate(found), np.concatenate(owners)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, distinct slots, counts) of each text; columns text, id, label."""
    for batch in batches:
        for lo, hi, data, offs in chunks(batch.column(0)):
            slot, owner = slots(data, offs)
            key, count = np.unique(owner.astype(np.int64) << BITS | slot, return_counts=True)
            at = np.searchsorted(key, np.arange(hi - lo + 1, dtype=np.int64) << BITS).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v, pa.int32())) for v in (key & ((1 << BITS) - 1), count)]
            yield pa.RecordBatch.from_arrays([batch.column(1)[lo:hi], batch.column(2)[lo:hi], *lists], names=["id", "label", "slot", "n"])


@dataclass(frozen=True)
class Model:
    table: np.ndarray
    intercept: float


def descend(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, odds: float, seed: int = 5) -> Model:
    """Train on bags of (slots, counts); ``odds`` are the log odds of label 1 among all labels."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((1 << BITS, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32)
    out, bias = np.zeros((2, DIMENSIONS), dtype=np.float32), np.zeros(2, dtype=np.float32)
    shares = [(s, (n / n.sum()).astype(np.float32)[:, None]) for s, n in bags]
    steps, done = max(1, EPOCHS * len(bags)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            slot, share = shares[i]
            if not len(slot):
                continue
            rate = np.float32(STEP * (1 - done / steps))
            done += 1
            own = vectors[slot]
            mean = (own * share).sum(axis=0)
            logit = out @ mean + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= rate * np.outer(p, mean)
            bias -= rate * p
            # the mean divides the gradient of a row by the text's length; fastText's rule leaves it whole
            vectors[slot] = own - rate * back * share * len(slot)
    table = vectors @ (out[1] - out[0])
    ones = int(labels.sum())
    sampled = np.log((ones + 0.5) / (len(labels) - ones + 0.5))
    return Model(table.astype(np.float32), float(bias[1] - bias[0]) + odds - float(sampled))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column, per_class: int = PER_CLASS, seed: int = 13) -> Model:
    """Learn ``label_col`` from whole texts of a sample of the ``usable`` labelled ids."""
    sample = labelled_sample(labels, id_col, label_col, per_class, seed, usable)
    texts = with_label(docs, sample, id_col, "inner").select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("string").alias("id"), "label")
    found = texts.mapInArrow(_bags, "id string, label int, slot array<int>, n array<int>").toArrow()
    order = np.argsort(np.array(found.column("id").to_pylist(), dtype=object), kind="stable")  # the order of learning does not depend on tasks
    slot, n = found.column("slot"), found.column("n")
    bags = [(slot[int(i)].values.to_numpy(), n[int(i)].values.to_numpy()) for i in order]
    y = found.column("label").to_numpy()[order].astype(np.int64)
    ones, rest = labels.where(usable).agg(F.count_if(F.col(label_col) == 1), F.count_if(F.col(label_col) == 0)).first()
    return descend(bags, y, float(np.log((ones + 0.5) / (rest + 0.5))), seed)


def score(docs: DataFrame, id_cols: list[str], text_col: str, model: Model) -> DataFrame:
    """(id columns, score) of every row; null and empty texts get the score of the intercept alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, intercept = shared.value.table, shared.value.intercept
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for lo, hi, data, offs in chunks(batch.column(batch.num_columns - 1)):
                slot, owner = slots(data, offs)
                n = np.bincount(owner, minlength=hi - lo)
                total[lo:hi] = np.bincount(owner, weights=table[slot], minlength=hi - lo) / np.maximum(n, 1)
            p = 1 / (1 + np.exp(-np.clip(total + intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], names=[*batch.schema.names[:-1], "score"])

    picked = small_batches(docs).select(*id_cols, F.col(text_col).cast("string").alias("_llm_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), "score double"])
    return picked.mapInArrow(predict, schema)
