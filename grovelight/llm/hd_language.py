"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of its code point.  The
vector of a letter trigram is the element-wise product of the three letter vectors, the
first rotated by two places and the second by one.  A text is the sum of the vectors of
its trigrams; a language is the sum over the texts that name it.  Texts are compared with
languages by cosine, after the mean profile of all languages is taken off both, since
what all languages share says nothing about any of them.

Training is one pass: each task sums its own profiles and Spark adds them up by language
and dimension.  What reaches the driver is one vector per language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import small_batches
from .kernels import chunks, codepoints, mix

#: Dimensions of the vectors.
DIMENSIONS = 512
#: No set of languages known to the driver may be larger.
MAX_LANGUAGES = 10_000
#: Trigrams whose vectors are held at once.
BLOCK = 8192
#: Letters up to which a chunk's trigrams are counted in a dense table.
DENSE_LETTERS = 64

_letters: dict[str, np.ndarray] = {}


def _letter_table() -> np.ndarray:
    """Code point to lower-case letter, or 0 for what is no letter; made once per process."""
    if "fold" not in _letters:
        fold = np.zeros(0x110000, dtype=np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                fold[cp] = ord(low) if len(low) == 1 else cp
        _letters["fold"] = fold
    return _letters["fold"]


def letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    """Random signs of letters, by hash; code 0 is the gap between words."""
    words = mix(points.astype(np.uint64)[:, None] * np.uint64(0xD1342543DE82EF95) + np.arange((dimensions + 63) // 64, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
    bits = np.unpackbits(words.view(np.uint8).reshape(len(points), -1), axis=1, bitorder="little")[:, :dimensions]
    return bits.astype(np.float32) * 2 - 1


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of each distinct trigram of a chunk, row and index of every trigram, rows with a letter, and the letters.

    Runs of other characters count as one gap, also at either end of a text.
    """
    n_rows = len(offs) - 1
    points, at = codepoints(data, offs)
    folded = _letter_table()[points]
    letter = folded > 0
    ends = at[1:]
    totals = np.zeros(len(folded) + 1, dtype=np.int64)
    np.cumsum(letter, out=totals[1:])
    has = totals[ends] > totals[at[:-1]]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one gap after each word; a row that begins with a gap may inherit one, which is harmless
    np.cumsum(keep, out=totals[1:])
    places = totals[at]
    folded = folded[keep]
    # two gaps between rows, so that each text begins and ends with one and no trigram crosses
    shift = np.repeat(np.arange(1, n_rows + 1, dtype=np.int64) * 2, np.diff(places))
    stream = np.zeros(len(folded) + 2 * n_rows + 2, dtype=np.uint32)
    stream[np.arange(len(folded)) + shift] = folded
    bounds = places + 2 * np.arange(n_rows + 1)
    alphabet = np.flatnonzero(np.bincount(stream, minlength=1)).astype(np.uint32)
    to_code = np.zeros(int(alphabet[-1]) + 1, dtype=np.int32)
    to_code[alphabet] = np.arange(len(alphabet))
    code, a = to_code[stream], len(alphabet)
    if a > DENSE_LETTERS:
        code = code.astype(np.int64)
    tri = (code[:-2] * a + code[1:-1]) * a + code[2:]
    fine = stream[1:-1] > 0
    fine |= (stream[:-2] > 0) & (stream[2:] > 0)
    row = np.repeat(np.arange(n_rows, dtype=np.int32), np.diff(bounds))
    row = np.concatenate([row, np.full(len(tri) - len(row), n_rows - 1, dtype=np.int32)])[: len(tri)]
    tri, row = tri[fine], row[fine]
    if a <= DENSE_LETTERS:
        seen = np.flatnonzero(np.bincount(tri, minlength=1))
        index = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, dtype=np.int32)
        index[seen] = np.arange(len(seen))
        index = index[tri]
    else:
        seen, index = np.unique(tri, return_inverse=True)
    letters = np.stack([alphabet[seen // (a * a)], alphabet[seen // a % a], alphabet[seen % a]], axis=1)
    return letters, row, index, has, alphabet


def bundles(data: np.ndarray, offs: np.ndarray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Profile of each row, and whether it has a letter."""
    n_rows = len(offs) - 1
    letters, row, index, has, alphabet = trigrams(data, offs)
    vectors = letter_vectors(alphabet, dimensions)
    once, twice = np.roll(vectors, 1, axis=1), np.roll(vectors, 2, axis=1)
    place = np.searchsorted(alphabet, letters)
    out = np.zeros((n_rows, dimensions), dtype=np.float32)
    for lo in range(0, len(letters), BLOCK):
        hi = min(lo + BLOCK, len(letters))
        bound = twice[place[lo:hi, 0]] * once[place[lo:hi, 1]] * vectors[place[lo:hi, 2]]
        if len(letters) > BLOCK:
            mine = (index >= lo) & (index < hi)
            cell = row[mine].astype(np.int64) * (hi - lo) + (index[mine] - lo)
        else:
            cell = row.astype(np.int64) * (hi - lo) + index
        counts = np.bincount(cell, minlength=n_rows * (hi - lo)).reshape(n_rows, hi - lo)
        out += counts.astype(np.float32) @ bound
    return out, has


def _row_chunks(column: pa.Array, rows: int = 128) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, data, offs in chunks(column):
        for a in range(lo, hi, rows):
            b = min(hi, a + rows)
            yield a, b, data[offs[a - lo] : offs[b - lo]], offs[a - lo : b - lo + 1] - offs[a - lo]


def learn(texts: DataFrame, text_col: str, lang_col: str, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Profiles of the languages named in ``texts``; rows with a null language are left out."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for lo, hi, data, offs in _row_chunks(batch.column(0)):
                vectors, _ = bundles(data, offs, dimensions)
                mine = langs[lo:hi]
                for lang in set(mine):
                    sums[lang] = sums.get(lang, 0) + vectors[mine == lang].sum(axis=0, dtype=np.float64)
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dimensions, "place": np.arange(dimensions, dtype=np.int32), "value": vector})

    rows = small_batches(texts).where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    summed = rows.mapInArrow(partial, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    profiles = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("p")).select("lang", "p.value")
    found = profiles.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {r["lang"]: np.array(r["value"]) for r in sorted(found, key=lambda r: r["lang"])}


def identify(docs: DataFrame, id_cols: list[str], text_col: str, profiles: dict[str, np.ndarray], keep_text: bool = False) -> DataFrame:
    """(id columns[, text], lang_pred, score) of every row; the text under its own name if kept.

    ``score`` is the cosine with the predicted language moved from [-1, 1] to [0, 1].
    A null text, one without letters, and any text when there are no profiles are
    ``und`` with score 0.  Ties go to the language first in order.
    """
    names = sorted(profiles)
    dimensions = len(next(iter(profiles.values()))) if profiles else DIMENSIONS
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    matrix = unit(np.array([profiles[n] for n in names], dtype=np.float64)) if names else np.zeros((0, dimensions))
    mean = matrix.mean(axis=0) if len(names) > 1 else np.zeros(dimensions)
    centred = unit(matrix - mean).astype(np.float32)
    mean = mean.astype(np.float32)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
            for lo, hi, data, offs in _row_chunks(batch.column(batch.num_columns - 1)):
                vectors, has = bundles(data, offs, dimensions)
                if names:
                    cosine = unit(unit(vectors) - mean) @ centred.T
                    best[lo:hi] = np.where(has, cosine.argmax(axis=1), -1)
                    score[lo:hi] = np.where(has, np.clip((cosine.max(axis=1) + 1) / 2, 0, 1), 0)
                else:
                    best[lo:hi] = -1
            words = pa.array([names[k] if k >= 0 else "und" for k in best], pa.string())
            kept = batch.columns if keep_text else batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, words, pa.array(score)], names=[*batch.schema.names[: len(kept)], "lang_pred", "score"])

    picked = small_batches(docs).select(*id_cols, F.col(text_col).cast("string").alias(text_col if keep_text else "_llm_text"))
    ids = picked.schema.fields if keep_text else picked.schema.fields[:-1]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ids), "lang_pred string", "score double"])
    return picked.mapInArrow(predict, schema)


def train_and_identify(docs: DataFrame, id_cols: list[str], text_col: str, lang_col: str, learn_from: Column) -> DataFrame:
    """Learn from the rows of ``learn_from``, then predict all rows."""
    profiles = learn(docs.where(learn_from), text_col, lang_col)
    return identify(docs, id_cols, text_col, profiles)
