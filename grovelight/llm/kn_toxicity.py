"""Toxicity by class-conditional Kneser-Ney models over letters.

Texts are folded to 32 symbols (letters, a digit, a gap, and classes of other letters),
so a run of five symbols is a number below 2**25.  Two models predict a symbol from the
four before it, one from toxic and one from ordinary labelled texts.  Both discount their
own counts and hand what is left to the *same* lower orders, whose continuation counts
come from every document: a run that neither class has seen says nothing either way, and
a rare one only as much as its discounted count.

A text is described by its log-likelihood ratio per symbol, and by that of its most toxic
passage of ``WINDOW`` symbols, so that long texts don't dilute an insult.  A logistic
curve over the two, fitted on labelled texts that the counts have not seen, gives the
score.

The labelled texts are a bounded sample (``per_class``).  The counts of all documents
are added up in each task, then by Spark.  The finished model has at most 2**25 cells.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import labelled_sample, small_batches, with_label
from .kernels import chunks

#: Symbols a model looks at: four of history and the one predicted.
ORDER = 5
#: Length of the passage whose ratio is the second feature.
WINDOW = 16
#: Labelled texts of either class that are learnt from, at most.
PER_CLASS = 10_000
#: The classes' own counts, of few texts, lose at least this much of one.
LEAST_CUT = 0.9
#: Ratios of single symbols are kept within this bound.
MOST = 8.0

_BITS = 5
_CELLS = 1 << (_BITS * ORDER)
_HISTORIES = 1 << (_BITS * (ORDER - 1))


def _symbols() -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    out[ord("A") : ord("Z") + 1] = np.arange(1, 27)
    out[ord("0") : ord("9") + 1] = 27
    out[0x80:0xC0] = 28 + np.arange(64) % 4  # the last byte of a letter beyond ASCII
    out[0xC0:] = 255  # its first byte: left out
    return out


SYMBOLS = _symbols()


def codes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Five-symbol codes at every symbol of a chunk, and the offsets of its rows.

    A row begins as if after a gap; runs of gaps are one gap.
    """
    n_rows = len(offs) - 1
    symbols = SYMBOLS[data]
    keep = symbols != 255
    gap = symbols == 0
    keep[1:] &= ~(gap[1:] & gap[:-1])
    total = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(keep, out=total[1:])
    at = total[offs]
    pad = ORDER - 1
    padded = np.zeros(at[-1] + pad * n_rows, dtype=np.int32)
    shift = np.repeat(np.arange(1, n_rows + 1, dtype=np.int64) * pad, np.diff(at))
    place = np.arange(at[-1]) + shift
    padded[place] = symbols[keep]
    code = padded.copy()
    for k in range(1, ORDER):
        code[k:] += padded[:-k] << (_BITS * k)
    return code[place], at


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, all, ordinary, toxic) of a task's rows; columns text, label."""
    dense = np.zeros(_CELLS, dtype=np.uint32)
    classes: list[list[np.ndarray]] = [[], []]
    for batch in batches:
        label = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
        for lo, hi, data, offs in chunks(batch.column(0)):
            code, at = codes(data, offs)
            found, count = np.unique(code, return_counts=True)
            dense[found] += count.astype(np.uint32)
            for k in (0, 1):
                if len(mine := code[np.repeat(label[lo:hi] == k, np.diff(at))]):
                    classes[k].append(mine)
    found = np.flatnonzero(dense)
    sums = [np.zeros(len(found), dtype=np.int64) for _ in classes]
    for k, parts in enumerate(classes):
        for part in parts:
            code, count = np.unique(part, return_counts=True)
            sums[k][np.searchsorted(found, code)] += count
    for lo in range(0, len(found), 100_000):
        own = slice(lo, lo + 100_000)
        yield pa.RecordBatch.from_pydict({"code": found[own].astype(np.int32), "n": dense[found[own]].astype(np.int64), "c0": sums[0][own], "c1": sums[1][own]})


@dataclass(frozen=True)
class Ratios:
    """Log ratio of the two models: of cells that a class has seen, else of their history."""

    cells: np.ndarray
    values: np.ndarray
    histories: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.repeat(self.histories, 1 << _BITS)
        out[self.cells] = self.values
        return out


def ratios(code: np.ndarray, n: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> Ratios:
    """The models from the counts of all documents (n) and of the classes."""
    width = 1 << _BITS
    lower = np.full(width, 1 / width)
    types = np.unique(code)
    # continuation counts: distinct symbols before a shorter run, in all documents
    runs = {ORDER - 1: np.bincount(types & (_HISTORIES - 1), minlength=_HISTORIES).astype(np.float64)}
    for k in range(ORDER - 2, 0, -1):
        longer = np.flatnonzero(runs[k + 1])
        runs[k] = np.bincount(longer & ((1 << (_BITS * k)) - 1), minlength=1 << (_BITS * k)).astype(np.float64)
    for k in range(1, ORDER):
        table = runs[k].reshape(-1, width)
        once, twice = (table == 1).sum(), (table == 2).sum()
        cut = once / (once + 2 * twice) if once and twice else 0.75
        total = table.sum(axis=1, keepdims=True)
        kinds = (table > 0).sum(axis=1, keepdims=True)
        below = np.tile(lower, len(table) // (len(lower) // width)).reshape(-1, width) if k > 1 else lower[None, :]
        lower = np.where(total > 0, (np.maximum(table - cut, 0) + cut * kinds * below) / np.maximum(total, 1), below).reshape(-1)
    shared = lower  # by (three of history, symbol)
    seen = (c0 > 0) | (c1 > 0)
    cells = code[seen]
    back = shared[cells & (_HISTORIES - 1)]
    logs, left = [], []
    for c in (c0[seen].astype(np.float64), c1[seen].astype(np.float64)):
        once, twice = (c == 1).sum(), (c == 2).sum()
        cut = max(LEAST_CUT, once / (once + 2 * twice)) if once and twice else LEAST_CUT
        history = cells >> _BITS
        total = np.bincount(history, weights=c, minlength=_HISTORIES)
        kinds = np.bincount(history, weights=c > 0, minlength=_HISTORIES)
        rest = np.where(total > 0, cut * kinds / np.maximum(total, 1), 1.0)
        logs.append(np.log(np.maximum(c - cut, 0) / np.maximum(total[history], 1) + rest[history] * back))
        left.append(np.log(rest))
    order = np.argsort(cells)
    bound = lambda x: np.clip(x, -MOST, MOST).astype(np.float32)
    return Ratios(cells[order].astype(np.int32), bound(logs[1] - logs[0])[order], bound(left[1] - left[0]))


def features(dense: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(rows, 2): ratio per symbol of the whole text, and of its most toxic passage."""
    code, at = codes(data, offs)
    n = np.diff(at)
    total = np.zeros(len(code) + 1)
    np.cumsum(dense[code], out=total[1:])
    out = np.zeros((len(n), 2))
    out[:, 0] = (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1)
    ends = np.arange(1, len(code) + 1)
    starts = np.maximum(ends - WINDOW, np.repeat(at[:-1], n))
    passage = (total[ends] - total[starts]) / WINDOW
    some = n > 0
    if some.any():
        out[some, 1] = np.maximum.reduceat(passage, at[:-1][some])
    return out


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (and intercept) of a slightly ridged logistic regression, by Newton steps."""
    scale = np.maximum(x.std(axis=0), 1e-9) if len(x) else np.ones(x.shape[1])
    a = np.hstack([x / scale, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-2] * x.shape[1] + [1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1])


_dense: dict[str, np.ndarray] = {}


def _table(shared) -> np.ndarray:
    """The dense ratios of a broadcast model, made once per worker process."""
    if shared.value[0] not in _dense:
        _dense.clear()
        _dense[shared.value[0]] = shared.value[1].dense()
    return _dense[shared.value[0]]


@dataclass(frozen=True)
class Model:
    ratios: Ratios
    weights: np.ndarray


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column, tuning: Column, per_class: int = PER_CLASS, seed: int = 11) -> Model:
    """Count all of ``docs``; learn labels of ``usable`` ids, ``tuning`` ones only for the curve."""
    sample = labelled_sample(labels, id_col, label_col, per_class, seed, usable).withColumn("_llm_tune", tuning)
    picked = small_batches(docs).select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    joined = with_label(picked, sample.where(~F.col("_llm_tune")).select(id_col, "label"), id_col, "left")
    counts = joined.select("text", "label").mapInArrow(_counted, "code int, n long, c0 long, c1 long")
    counts = counts.groupBy("code").agg(*(F.sum(c).alias(c) for c in ("n", "c0", "c1"))).toArrow()
    model = ratios(*(counts.column(c).to_numpy() for c in ("code", "n", "c0", "c1")))
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(_table(shared), data, offs) for _, _, data, offs in chunks(batch.column(0))]
            found = np.concatenate(found) if found else np.zeros((0, 2))
            yield pa.RecordBatch.from_pydict({"a": found[:, 0], "b": found[:, 1], "y": batch.column(1).cast(pa.float64())})

    tune = with_label(picked, sample.where("_llm_tune").select(id_col, "label"), id_col, "inner")
    rows = tune.select("text", "label").mapInArrow(measure, "a double, b double, y double").toArrow()
    x = np.stack([rows.column("a").to_numpy(), rows.column("b").to_numpy()], axis=1).reshape(-1, 2)
    return Model(model, logistic(x, rows.column("y").to_numpy()))


def score(docs: DataFrame, id_cols: list[str], text_col: str, model: Model) -> DataFrame:
    """(id columns, score) of every row; null and empty texts get the score of no evidence.

    Repeated rows are scored each; without labels of both classes all scores are alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model.ratios))
    weights = model.weights

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(_table(shared), data, offs) for _, _, data, offs in chunks(batch.column(batch.num_columns - 1))]
            x = np.concatenate(found) if found else np.zeros((0, 2))
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], names=[*batch.schema.names[:-1], "score"])

    picked = small_batches(docs).select(*id_cols, F.col(text_col).cast("string").alias("_llm_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), "score double"])
    return picked.mapInArrow(predict, schema)
