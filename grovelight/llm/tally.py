"""Counts of 64-bit keys over all rows, and the split of counted keys into few common and many rare ones.

A task counts the keys it meets and hands them on in buckets of their hash, sorted, as
differences in compressed bytes: a fifth of what rows of (key, count) would take.  Buckets
are shuffled and merged one at a time, so memory follows the size of a bucket.  As every
task hands on a key once, no key is heavy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut
from .kernels import mix

#: Distinct keys that a task holds before it hands them on.
HELD = 1_500_000
#: Bytes of text for which there is one bucket.
BUCKET_BYTES = 8 << 20
#: The same for values that are looked up.
ANSWER_BYTES = 64 << 20

Counts = tuple[np.ndarray, np.ndarray]
NO_COUNTS: Counts = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def merged(parts: list[Counts]) -> Counts:
    """Distinct keys in order, with the sums of their counts."""
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.concatenate([n for _, n in parts])[order]
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def tallies(keys: Iterator[np.ndarray]) -> Iterator[Counts]:
    """Counts of the keys of a task, handed on whenever very many are held."""
    kept, size = [NO_COUNTS], 0
    for some in keys:
        own = np.sort(some)
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        kept.append((own[first], np.diff(np.append(first, len(own))).astype(np.int64)))
        size += len(first)
        if size > HELD:
            kept = [merged(kept)]
            size = len(kept[0][0])
            if size > HELD // 2:
                yield kept[0]
                kept, size = [NO_COUNTS], 0
    yield merged(kept)


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _values(planes: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(8, n).T).reshape(-1).view(np.int64)


def pack(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted keys and as many 64-bit values, in columns, as compressed bytes."""
    return pa.compress(b"".join(map(_planes, [np.diff(keys, prepend=np.int64(0)), *values])), codec="zstd", asbytes=True)


def unpack(body: bytes, n: int, columns: int = 1) -> tuple[np.ndarray, ...]:
    raw = pa.decompress(body, decompressed_size=8 * n * (1 + columns), codec="zstd", asbytes=True)
    found = [_values(raw[8 * n * k : 8 * n * (k + 1)], n) for k in range(1 + columns)]
    return np.cumsum(found[0]), *found[1:]


def bucketed(buckets: int, keys: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, size, packed) of the buckets of ``keys``, which may repeat."""
    bucket = (mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((keys, bucket))
    for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
        yield int(bucket[own[0]]), len(own), pack(keys[own], *(v[own] for v in values))


def packed_counts(df: DataFrame, keys: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], text_bytes: int, least: int = 1) -> DataFrame:
    """(key, n) of the keys that ``keys`` finds in all rows of ``df``, where n is at least ``least``."""
    buckets = 1 + text_bytes // BUCKET_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, n in tallies(keys(batches)):
            for bucket, size, body in bucketed(buckets, found, n):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "n": pa.array([size], pa.int32()), "body": pa.array([body], pa.binary())})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, kept, size = None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            found, n = merged(kept)
            found, n = found[n >= least], n[n >= least]
            for lo in range(0, len(found), 200_000):
                yield pa.RecordBatch.from_pydict({"key": found[lo : lo + 200_000], "n": n[lo : lo + 200_000]})

        for batch in batches:
            for own, n, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != bucket and kept:
                    yield from done()
                    kept, size = [], 0
                bucket = own
                kept.append(unpack(body, n))
                size += n
                if size > HELD:
                    kept = [merged(kept)]
                    size = len(kept[0][0]) // 2
        if kept:
            yield from done()

    packed = df.mapInArrow(count, "bucket long, n int, body binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, "key long, n long")


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their values."""
    found, which = np.unique(keys, return_inverse=True)
    return found, np.bincount(which, weights=values, minlength=len(found)).astype(np.float64)


def looked_up(asked: DataFrame, values: DataFrame, text_bytes: int, sums: list[str]) -> DataFrame:
    """Rows with sums of the values of the keys that they ask for.

    ``values`` has key and value; values of one key add up.  ``asked`` holds blocks of rows, told apart
    by the BIGINT ``block``: a row of its own has n of 0 and its number in the block,
    ``row``; a packed list of questions (key, number of the row, times) has its bucket, n and
    body.  All other columns belong to the rows.  Returns those columns, and for ``sums`` the
    totals per row: matches of keys below 0, the sum of their values, the sum over other keys.

    Buckets are shuffled; a task holds the values of one bucket and goes through its
    questions list by list.  The answers to a list go back, packed, to its block.  So neither
    a common key nor a long list is ever held whole, and a row's answers are not rows.
    """
    buckets = 1 + text_bytes // ANSWER_BYTES
    inner = ("bucket", "n", "body", "block", "row")
    rest = [f for f in asked.schema.fields if f.name not in inner]
    head = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), ""])

    def offered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, value = (c.to_numpy() for c in batch.columns)
            rows = list(bucketed(buckets, key, value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["bucket", "n", "body"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*(f.name for f in rest), "n", "body", "block", "row"]
        bucket, parts, table = None, [], None
        for batch in batches:
            own, n, body, block, offer = (batch.column(c).to_pylist() for c in ("bucket", "n", "body", "block", "_llm_offer"))
            kept = [k for k in range(batch.num_rows) if not offer[k] and not n[k]]
            if kept:
                yield batch.take(pa.array(kept)).select(names)
            for k in range(batch.num_rows):
                if own[k] != bucket:
                    bucket, parts, table = own[k], [], None
                if offer[k]:
                    parts.append(unpack(body[k], n[k]))
                elif n[k]:
                    if table is None:
                        table = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in range(2)]
                        table = summed(table[0], table[1].view(np.float64))
                    key, row, times = unpack(body[k], n[k], 2)
                    at = np.minimum(np.searchsorted(table[0], key), max(len(table[0]) - 1, 0))
                    found = table[0][at] == key if len(table[0]) else np.zeros(len(key), dtype=bool)
                    if not found.any():
                        continue
                    below, part = key[found] < 0, times[found] * table[1][at[found]]
                    rows, which = np.unique(row[found], return_inverse=True)
                    total = lambda x: np.bincount(which, weights=x, minlength=len(rows))
                    packed = pack(rows, total(times[found] * below).astype(np.int64), total(part * below).view(np.int64), total(part * ~below).view(np.int64))
                    out = [pa.nulls(1, batch.schema.field(f.name).type) for f in rest]
                    out += [pa.array([len(rows)], pa.int32()), pa.array([packed], pa.binary()), pa.array([block[k]], pa.int64()), pa.nulls(1, pa.int64())]
                    yield pa.RecordBatch.from_arrays(out, names=names)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in rest]
        current, rows, answers = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            number = np.concatenate([r.column("row").to_numpy() for r in rows])
            size = int(number.max()) + 1
            totals = [np.zeros(size, np.int64), np.zeros(size), np.zeros(size)]
            for row, *more in answers:  # every row at most once in each
                for k, x in enumerate(more):
                    totals[k][row] += x.view(totals[k].dtype)
            for r in rows:
                at = r.column("row").to_numpy()
                yield pa.RecordBatch.from_arrays([*(r.column(c) for c in names), *(pa.array(t[at]) for t in totals)], names=[*names, *sums])

        for batch in batches:
            block, n = batch.column("block").to_pylist(), batch.column("n").to_pylist()
            lo = 0
            while lo < len(block):
                hi = lo + 1
                while hi < len(block) and block[hi] == block[lo] and not n[hi] and not n[lo]:
                    hi += 1
                if block[lo] != current:
                    if rows:
                        yield from done()
                    current, rows, answers = block[lo], [], []
                if n[lo]:
                    answers.append(unpack(batch.column("body")[lo].as_py(), n[lo], 3))
                else:
                    rows.append(batch.slice(lo, hi - lo))
                lo = hi
        if rows:
            yield from done()

    offers = values.select("key", "value").mapInArrow(offered, "bucket long, n int, body binary").withColumn("_llm_offer", F.lit(True))
    both = asked.withColumn("_llm_offer", F.lit(False)).unionByName(offers, allowMissingColumns=True)
    dealt = both.repartition("bucket").sortWithinPartitions("bucket", F.desc("_llm_offer"))
    answers = dealt.mapInArrow(answer, f"{head}n int, body binary, block long, row long")
    back = answers.repartition("block").sortWithinPartitions("block")
    return back.mapInArrow(settle, f"{head}{sums[0]} long, {sums[1]} double, {sums[2]} double")


def common(counts: DataFrame, most: int, count_col: str = "count") -> tuple[DataFrame, DataFrame]:
    """A stored table in two: at most ``most`` rows of highest count, and all others.

    The limit lies between two counts, so both parts are the same whenever they are made.
    At most 4096 rows are read to find it.
    """
    n = F.col(count_col)
    kinds = cut(counts.groupBy(n).agg(F.count("*").alias("rows")), "count-kinds")
    total = counts.agg(F.sum(n)).first()[0] or 0
    # fewer than ``most`` rows can have more than total / most
    least = total // most + 1
    room = most - (kinds.where(n >= least).agg(F.sum("rows")).first()[0] or 0)
    for row in kinds.where(n < least).orderBy(F.desc(count_col)).limit(4096).collect():
        if row["rows"] > room:
            break
        room, least = room - row["rows"], row[count_col]
    return counts.where(n >= least), counts.where(n < least)
