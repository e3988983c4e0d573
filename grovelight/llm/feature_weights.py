"""Resampling towards a target distribution: importance weights and an exact distributed sort.

A text is the multiset of its runs of one to three consecutive words, hashed (CRC-32) into
``BUCKETS`` buckets.  Bucket counts of all documents and of the target give every bucket a
gain, the scaled log ratio of the two; a document's weight is the sum of its gains, read
from one array.  Adding a seeded Gumbel draw to the weight and taking the highest scores is
a draw without replacement in proportion to ``exp(weight)``.

The ranks come from a distributed radix sort, least significant digit first.  Each pass is a
stable counting sort: rows of a block of consecutive places are counted by digit, the counts
are summed in the order (digit, block), and a row's new place is the count before its digit
and block plus its rank within them.  No task sees more than a block, and no pass compares keys.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut, small_batches
from .kernels import ALNUM, LOWER, chunks, word_spans

BUCKETS = 10_000
#: Longest run of words that is a feature.
RUN = 3
#: Scale of gains and draws.
SCALE = 1000
#: Bits of a digit, and rows of a block, of the sort.
DIGIT_BITS = 12
BLOCK_ROWS = 1 << 16

_LONG_WORD = 64
_MIN, _MAX = -(1 << 63), (1 << 63) - 1


def _byte_table() -> np.ndarray:
    """CRC-32 register after one byte, by register byte."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_TABLE = _byte_table()
_BLANK = np.uint32(zlib.crc32(b" "))
_shifts: dict[int, np.ndarray] = {}


def _apply(shift: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return shift[0][crc & 255] ^ shift[1][(crc >> 8) & 255] ^ shift[2][(crc >> 16) & 255] ^ shift[3][crc >> 24]


def _shift(n: int) -> np.ndarray:
    """What ``n`` more bytes make of a CRC before them: four tables, one per byte of the CRC.

    ``crc(x + y) = shift[len(y)](crc(x)) ^ crc(y)``, and shifts of ``n`` compose.
    """
    if n not in _shifts:
        values = np.arange(256, dtype=np.uint32)
        if n == 0:
            found = np.stack([values << np.uint32(8 * k) for k in range(4)])
        elif n == 1:
            found = np.stack([_TABLE[values], values, values << np.uint32(8), values << np.uint32(16)])
        else:
            half = _shift(n // 2)
            found = np.stack([_apply(half, half[k]) for k in range(4)])
            if n % 2:
                found = np.stack([_apply(_shift(1), found[k]) for k in range(4)])
        if len(_shifts) > 4096:
            _shifts.clear()
        _shifts[n] = found
    return _shifts[n]


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes of each span, all spans a byte at a time; very long ones singly."""
    size = ends - starts
    out = np.zeros(len(starts), dtype=np.uint32)
    order = np.argsort(-np.minimum(size, _LONG_WORD + 1), kind="stable")
    for i in order[: np.searchsorted(-size[order], -_LONG_WORD)]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    order = order[np.searchsorted(-size[order], -_LONG_WORD) :]
    held = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    at, left = starts[order], size[order]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k))  # spans of more than k bytes
        own = held[:n]
        held[:n] = _TABLE[(own ^ data[at[:n] + k]) & 255] ^ (own >> np.uint32(8))
    out[order] = ~held
    return out


def feature_buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of a chunk, their rows, and the number of words of each row."""
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offs, ALNUM)
    words = np.bincount(rows, minlength=len(offs) - 1)
    if not len(starts):
        return np.zeros(0, np.int64), rows, words
    size = ends - starts
    lengths, which = np.unique(size, return_inverse=True)
    tables = np.stack([_shift(int(n)) for n in lengths])

    def after(crc: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The CRC's share once a blank and a word of a length follow."""
        crc = _apply(_shift(1), crc)
        return tables[which, 0, crc & 255] ^ tables[which, 1, (crc >> 8) & 255] ^ tables[which, 2, (crc >> 16) & 255] ^ tables[which, 3, crc >> 24]

    own = word_crcs(data, starts, ends)
    spaced = np.zeros_like(own)
    spaced[:] = tables[which, 0, _BLANK & 255] ^ tables[which, 1, (_BLANK >> 8) & 255] ^ tables[which, 2, (_BLANK >> 16) & 255] ^ tables[which, 3, _BLANK >> 24]
    spaced ^= own
    run, found, at = own, [own], [rows]
    for k in range(1, RUN):
        whole = rows[k:] == rows[:-k]
        run = after(run[:-1], which[k:]) ^ spaced[k:]
        found.append(run[whole])
        at.append(rows[k:][whole])
    return np.concatenate(found).astype(np.int64) % BUCKETS, np.concatenate(at), words


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for _, _, data, offs in chunks(batch.column(0)):
            total += np.bincount(feature_buckets(data, offs)[0], minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"bucket": some.astype(np.int32), "n": total[some]})


def bucket_counts(df: DataFrame, text_col: str) -> np.ndarray:
    """How many features of all texts are in each bucket; added per task, then by Spark.

    At most ``BUCKETS`` rows reach the driver.
    """
    texts = small_batches(df).select(F.col(text_col).cast("string"))
    rows = texts.mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled log ratio of the smoothed shares of each bucket in target and source, rounded down."""
    s, t = int(source.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    ratio = [math.floor(SCALE * math.log(float((b + 1) * s) / float((a + 1) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array(ratio, dtype=np.int64)


def weigh(df: DataFrame, id_cols: list[str], text_col: str, gain: np.ndarray) -> DataFrame:
    """(id columns, n_words, n_features, weight) of every row; null and empty texts have none and weigh 0."""
    shared = df.sparkSession.sparkContext.broadcast(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros((0, 3), dtype=np.int64)]
            for _, _, data, offs in chunks(batch.column(batch.num_columns - 1)):
                buckets, rows, words = feature_buckets(data, offs)
                out = np.zeros((len(words), 3), dtype=np.int64)
                out[:, 0] = words
                out[:, 1] = np.bincount(rows, minlength=len(words))
                np.add.at(out[:, 2], rows, shared.value[buckets])
                parts.append(out)
            found = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(found[:, k]) for k in range(3))], names=[*batch.schema.names[:-1], "n_words", "n_features", "weight"])

    picked = small_batches(df).select(*id_cols, F.col(text_col).cast("string").alias("_llm_text"))
    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]]
    return picked.mapInArrow(score, ", ".join([*head, "n_words long, n_features long, weight long"]))


def gumbel(id_col: str, seed: int) -> Column:
    """Scaled Gumbel draw of an id, from its seeded SHA-256, rounded down; a null id counts as empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _digits(column: str, low: int, high: int, descending: bool) -> list[Column]:
    """Digits of a BIGINT column, least significant first, that sort like it; nulls come last.

    ``low`` and ``high`` are its least and greatest value; as many digits as their distance needs.
    """
    mask = (1 << DIGIT_BITS) - 1
    if high - low < _MAX:
        value = (F.lit(high) - F.col(column)) if descending else (F.col(column) - F.lit(low))
        value, bits = F.coalesce(value, F.lit(high - low + 1)), (high - low + 1).bit_length()
    else:  # differences would overflow: the sign bit is flipped instead
        value, bits = F.col(column).bitwiseXOR(F.lit(_MAX if descending else _MIN)), 64
        value = F.coalesce(value, F.lit(-1))
    found = [F.shiftrightunsigned(value, k).bitwiseAND(F.lit(mask)).cast("int") for k in range(0, bits, DIGIT_BITS)]
    return [*found, F.col(column).isNull().cast("int")] if bits == 64 else found


def counting_pass(rows: DataFrame, place: str, digit: Column) -> DataFrame:
    """One stable counting sort of ``rows`` by ``digit``: ``place`` becomes the new place, from 0.

    ``place`` is unique; rows of equal digit keep its order.
    """
    kept = [c for c in rows.columns if c != place]
    dealt = rows.withColumn("_llm_digit", digit).withColumn("_llm_block", F.floor(F.col(place) / BLOCK_ROWS))
    counts = cut(dealt.groupBy("_llm_digit", "_llm_block").agg(F.count("*").alias("n")), "digit-counts")
    # first within a digit over the blocks, then over the digits, of which there are at most 2^DIGIT_BITS
    blocks = Window.partitionBy("_llm_digit").orderBy("_llm_block").rowsBetween(Window.unboundedPreceding, -1)
    digits = Window.partitionBy(F.lit(0)).orderBy("_llm_digit").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.groupBy("_llm_digit").agg(F.sum("n").alias("n")).select("_llm_digit", F.coalesce(F.sum("n").over(digits), F.lit(0)).alias("_llm_less"))
    offsets = counts.withColumn("_llm_start", F.coalesce(F.sum("n").over(blocks), F.lit(0))).drop("n").join(before, "_llm_digit")
    within = Window.partitionBy("_llm_block", "_llm_digit").orderBy(place)
    ranked = dealt.withColumn("_llm_rank", F.row_number().over(within) - 1).join(offsets, ["_llm_block", "_llm_digit"])
    return ranked.select(*kept, (F.col("_llm_less") + F.col("_llm_start") + F.col("_llm_rank")).alias(place))


def radix_ranks(rows: DataFrame, order: list[tuple[str, bool]], place: str) -> DataFrame:
    """``rows`` with ``place``, their place from 0 by the BIGINT columns of ``order`` (name, descending).

    The first of ``order`` decides first; nulls come last.  Rows that are equal in all of them
    get places next to each other, in the order of the stored table.
    """
    start = cut(rows.withColumn(place, F.monotonically_increasing_id()), "places")
    spans = start.agg(*(f(c).alias(f"{f.__name__}_{c}") for c, _ in order for f in (F.min, F.max))).first()
    for c, descending in reversed(order):
        low, high = spans[f"min_{c}"], spans[f"max_{c}"]
        for digit in _digits(c, low or 0, high or 0, descending):
            start = cut(counting_pass(start, place, digit), "places")
    return start


def resample(
    df: DataFrame, id_col: str, text_col: str, target: DataFrame, target_col: str, percent: int, least_words: int, seed: int = 42
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row; the id is a whole number.

    ``rank`` (1, 2, ...) has the drawn rows: ``percent`` of those with at least ``least_words``
    words, rounded down, of highest score, ties to the smaller id, null ids last.  Null and
    empty texts have no features, weight 0, and are not drawn unless ``least_words`` is 0.
    Repeated rows are rows of their own; those equal in id and score take ranks next to each
    other.  An empty table or target is fine: counts are then 0.  Other columns are not read.
    """
    gain = gains(bucket_counts(df, text_col), bucket_counts(target, target_col))
    plain = df.select(F.col(id_col).cast("long").alias("_llm_id"), F.col(text_col).alias("_llm_t"))
    weighed = cut(weigh(plain, ["_llm_id"], "_llm_t", gain).withColumn("score", F.col("weight") + gumbel("_llm_id", seed)), "weights")
    eligible = weighed.where(F.col("n_words") >= least_words)
    drawn = eligible.count() * percent // 100
    placed = radix_ranks(eligible, [("score", True), ("_llm_id", False)], "_llm_place")
    ranked = placed.withColumn("rank", F.when(F.col("_llm_place") < drawn, F.col("_llm_place") + 1)).drop("_llm_place")
    rest = weighed.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).withColumnRenamed("_llm_id", id_col).select(id_col, "n_words", "n_features", "weight", "score", "rank")
