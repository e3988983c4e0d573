"""Bootstrap draws and block permutations with seeded hashes.

Every random choice is a hash of (seed, bootstrap, variable, position), so a
result does not depend on partitioning, retries or lost executors.

A permutation orders the slots of a bootstrap by a hash.  What moves is packed: a
task sends many slots of one bucket of hashes, or of one block of slots, as one
compressed row, so a slot costs its hash, its number and its few variable bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DRAW_BITS, hash_draw, names, sql
from ..sources.packages import small_batches
from .patterns import WORD_BITS, words

# Values of slots that a task packs at once.
HELD_VALUES = 2_400_000
# Slots of a bucket of hashes, about, and of a block of slots.
BUCKET_SLOTS = 500_000
BLOCK_SLOTS = 1 << 18


def ranged_rows(df: DataFrame, order: str) -> DataFrame:
    """Range-partition by a unique column and note the partition in ``_gl_part``.

    Store the result before reading it twice: a second run may cut the ranges
    elsewhere.
    """
    return df.repartitionByRange(order).withColumn("_gl_part", F.spark_partition_id())


def dense_positions(ranged: DataFrame, order: str) -> DataFrame:
    """Replace ``order`` by ``pos`` = 0, 1, 2, ... in its order.

    Rows are numbered inside their partition and shifted by the sizes of the
    partitions before; only the list of partitions is windowed as a whole.
    """
    kept = names((), *(c for c in ranged.columns if c not in (order, "_gl_part")))
    return sql(
        f"""WITH offsets AS (
            SELECT _gl_part, coalesce(sum(size) OVER (
                ORDER BY _gl_part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) shift
            FROM (SELECT _gl_part, count(*) size FROM {{ranged}} GROUP BY _gl_part)),
        numbered AS (SELECT *, count(*) OVER (
            PARTITION BY _gl_part ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 at FROM {{ranged}})
        SELECT {kept}, at + shift pos FROM numbered JOIN offsets USING (_gl_part)""",
        ranged=ranged,
    )


def bootstrap_draws(spark, n_rows: int, n_boot: int, seed: int) -> DataFrame:
    """``(b, i, pos)``: draw ``i`` of bootstrap ``b`` takes the row at ``pos``."""
    slots = spark.range(n_rows * n_boot)
    return slots.selectExpr(f"cast(id div {n_rows} AS int) AS b", f"id % {n_rows} AS i").selectExpr(
        "b", "i", f"{hash_draw(str(seed), 'b', 'i')} % {n_rows} AS pos"
    )


def bootstrap_sample(positioned: DataFrame, draws: DataFrame) -> DataFrame:
    """``(b, i, words, y)``: a row is drawn about once per bootstrap, so neither
    side of the join has a heavy key."""
    carried = names((), *(c for c in positioned.columns if c != "pos"))
    return sql(f"SELECT b, i, {carried} FROM {{draws}} JOIN {{positioned}} USING (pos)", draws=draws, positioned=positioned)


def variable_masks(variables: Sequence[Sequence[int]], n_features: int) -> list[list[int]]:
    """Per variable, one bit mask per word of packed features."""
    masks = []
    for columns in variables:
        mask = [0] * len(words(n_features))
        for f in columns:
            mask[f // WORD_BITS] |= 1 << (f % WORD_BITS)
        masks.append(mask)
    return masks


def packed(columns: Sequence[np.ndarray]) -> bytes:
    """BIGINT columns as compressed bytes, those of equal weight together."""
    planes = [np.ascontiguousarray(c, dtype=np.int64).view(np.uint8).reshape(-1, 8).T for c in columns]
    return pa.compress(b"".join(p.tobytes() for p in planes), codec="zstd", asbytes=True)


def unpacked(body: bytes, n: int, columns: int) -> list[np.ndarray]:
    if not columns:
        return []
    raw = np.frombuffer(pa.decompress(body, decompressed_size=8 * n * columns, codec="zstd", asbytes=True), dtype=np.uint8)
    return [np.ascontiguousarray(p.T).reshape(-1).view(np.int64) for p in raw.reshape(columns, 8, n)]


def held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """All rows of a task, about ``most`` at a time."""
    kept, size = [], 0
    for batch in batches:
        kept.append(batch)
        size += batch.num_rows
        if size >= most:
            yield pa.Table.from_batches(kept)
            kept, size = [], 0
    if size:
        yield pa.Table.from_batches(kept)


def runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and end of every stretch of equal keys."""
    if not len(keys[0]):
        return
    new = np.any([np.diff(k) != 0 for k in keys], axis=0)
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(keys[0])]
    yield from zip(edges[:-1], edges[1:], strict=True)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Sorted rows by their first ``keys`` columns, one group at a time."""
    key, kept = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key and kept:
                yield key, kept
                kept = []
            key = row[:keys]
            kept.append(row[keys:])
    if kept:
        yield key, kept


def rows_as(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


BUCKETS = pa.schema([("b", pa.int32()), ("var", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
SLICES = pa.schema([("b", pa.int32()), ("block", pa.int64()), ("var", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
BUCKETS_SQL = "b int, var int, bucket long, n long, body binary"
SLICES_SQL = "b int, block long, var int, at long, n long, body binary"


def donors_by_rank(
    sample: DataFrame, variables: Sequence[Sequence[int]], n_rows: int, n_features: int, seed: int
) -> DataFrame:
    """``(b, var, bucket, n, body)``: the variable's bits of all slots, in the order of the
    slots' hashes; one uniform permutation per bootstrap and variable.

    Hash values are uniform, so equal-width buckets hold equal shares, and every bucket
    is sorted by itself.  Equal hashes are in the order of the slots.
    """
    bits = max(0, (n_rows // BUCKET_SLOTS).bit_length())
    masks = variable_masks(variables, n_features)
    own = [[w for w, m in enumerate(mask) if m] for mask in masks]
    columns = words(n_features)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in held(batches, HELD_VALUES // len(masks)):
            b, i = rows.column("b").to_numpy(), rows.column("i").to_numpy()
            hashes = rows.column("h").combine_chunks().flatten().to_numpy().reshape(len(b), len(masks))
            given = [rows.column(c).to_numpy() for c in columns]
            for var, mask in enumerate(masks):
                order = np.lexsort((hashes[:, var], b))
                h, at = hashes[order, var], b[order]
                bucket = h >> (DRAW_BITS - bits)
                bodies = [i[order], *(given[w][order] & mask[w] for w in own[var])]
                rows_out = []
                for lo, hi in runs(at, bucket):
                    body = packed([np.diff(h[lo:hi], prepend=np.int64(0)), *(c[lo:hi] for c in bodies)])
                    rows_out.append((int(at[lo]), var, int(bucket[lo]), hi - lo, body))
                yield rows_as(BUCKETS, rows_out)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (b, var, bucket), parts in groups(batches, 3):
            lists = [unpacked(body, n, 2 + len(own[var])) for n, body in parts]
            h = np.concatenate([np.cumsum(x[0]) for x in lists])
            i, *bits_of = (np.concatenate([x[k] for x in lists]) for k in range(1, 2 + len(own[var])))
            order = np.lexsort((i, h))
            yield rows_as(BUCKETS, [(b, var, bucket, len(h), packed([x[order] for x in bits_of]))])

    draws = ", ".join(hash_draw(str(seed), "b", str(var), "i") for var in range(len(masks)))
    dealt = sample.selectExpr("b", "i", *columns, f"array({draws}) AS h").mapInArrow(deal, BUCKETS_SQL)
    return dealt.repartition("b", "var", "bucket").sortWithinPartitions("b", "var", "bucket").mapInArrow(gather, BUCKETS_SQL)


def permuted_patterns(
    sample: DataFrame,
    variables: Sequence[Sequence[int]],
    n_rows: int,
    n_features: int,
    seed: int,
    cut: Callable[[DataFrame, str], DataFrame],
) -> DataFrame:
    """``(b, var, words) -> (n, p)`` after moving a variable's columns as a block.

    Slot ``i`` takes the variable's columns from the slot of rank ``i``.  Both sides are
    brought together by blocks of slots, and a block's equal patterns are counted there.
    ``sample`` is to be stored: it is read twice.
    """
    sample = small_batches(sample)
    masks = variable_masks(variables, n_features)
    own = [[w for w, m in enumerate(mask) if m] for mask in masks]
    columns = words(n_features)
    donors = cut(donors_by_rank(sample, variables, n_rows, n_features, seed), "donors")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in held(batches, HELD_VALUES // (len(columns) + 2)):
            b, i = rows.column("b").to_numpy(), rows.column("i").to_numpy()
            order = np.lexsort((i, b))
            b, i = b[order], i[order]
            block = i // BLOCK_SLOTS
            given = [i % BLOCK_SLOTS, *(rows.column(c).to_numpy()[order] for c in (*columns, "y"))]
            rows_out = [(int(b[lo]), int(block[lo]), -1, 0, hi - lo, packed([c[lo:hi] for c in given])) for lo, hi in runs(b, block)]
            yield rows_as(SLICES, rows_out)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, var, n, shift, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                given, rows_out, lo = unpacked(body, n, len(own[var])), [], 0
                while lo < n:
                    block, at = divmod(shift + lo, BLOCK_SLOTS)
                    hi = min(n, lo + BLOCK_SLOTS - at)
                    rows_out.append((b, block, var, at, hi - lo, packed([c[lo:hi] for c in given])))
                    lo = hi
                yield rows_as(SLICES, rows_out)

    out = pa.schema([("b", pa.int32()), ("var", pa.int32()), *((c, pa.int64()) for c in columns), ("n", pa.int64()), ("p", pa.int64())])

    def counted(b: int, var: int, given: list[np.ndarray], y: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort(given)
        first = [lo for lo, _ in runs(*(c[order] for c in given))]
        n = np.diff([*first, len(y)])
        values = [np.full(len(first), b, np.int32), np.full(len(first), var, np.int32), *(c[order][first] for c in given)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*values, n, np.add.reduceat(y[order], first))], schema=out)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (b, _), parts in groups(batches, 2):
            kept = [unpacked(body, n, len(columns) + 2) for var, _, n, body in parts if var < 0]
            order = np.argsort(np.concatenate([k[0] for k in kept]))
            *given, y = (np.concatenate([k[c] for k in kept])[order] for c in range(1, len(columns) + 2))
            for var, mask in enumerate(masks):
                moved = [c & ~m for c, m in zip(given, mask, strict=True)]
                for found, at, n, body in parts:
                    if found == var:
                        for w, bits_of in zip(own[var], unpacked(body, n, len(own[var])), strict=True):
                            moved[w][at : at + n] |= bits_of
                yield counted(b, var, moved, y)

    shifted = sql(
        """WITH offsets AS (SELECT b, var, bucket, coalesce(sum(n) OVER (
            PARTITION BY b, var ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) shift FROM {donors})
        SELECT b, var, n, shift, body FROM {donors} JOIN offsets USING (b, var, bucket)""",
        donors=donors,
    )
    slots = sample.select("b", "i", *columns, "y").mapInArrow(keep, SLICES_SQL).unionByName(shifted.mapInArrow(sliced, SLICES_SQL))
    blocks = slots.repartition("b", "block").sortWithinPartitions("b", "block")
    partial = blocks.mapInArrow(combine, f"b int, var int, {', '.join(f'{c} long' for c in columns)}, n long, p long")
    group = names(("b", "var"), *columns)
    return sql(f"SELECT {group}, sum(n) n, sum(p) p FROM {{partial}} GROUP BY {group}", partial=partial)
