"""N-gram Jaccard join in size-banded tiles with hashed bitmap signatures.

Texts are sets of word shingles.  Two sets that link (Jaccard at or above the threshold)
share an element among the first ``n - ceil(t n) + 1`` of either in any one order of all
elements.  The order here puts elements of one document first, then others by hash, then
very common ones; the first kind needs no rows at all, so only documents that are mostly
made of what others have go on.  That order comes from counts over all documents, kept in
two tables of bounded size: a filter of at most ``2**30`` bits of elements that occur
twice, and at most ``2**20`` common elements.  Both may be inexact in one direction
only, and only cost work then.

The documents that share such an element are dealt into tiles by size: only sets of the
same or the next band of sizes can link, and a band of many is cut into chunks, so a
tile holds at most ``2 * CHUNK`` sets.  In a tile, signatures (parities of 512 hashed
counters) bound the overlap from above; what passes is checked by intersecting the sorted
arrays.  No tile emits all its pairs: in each round a set proposes its first partners
outside its component, as many again times four as in the round before; refuted pairs are
remembered, verified ones join components.  When nothing is proposed, every pair of
different components has been ruled out.  Equal sets are one from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import cut, small_batches
from .kernels import LOWER, SPACED, U64, chunks, mix, per_row_unique, shingles, span_hashes, word_spans

WIDTH = 5
#: Links need ``100 * intersection >= PERCENT * union``.
PERCENT = 80
CHUNK = 1024
SIGNATURE_BITS = 512
#: Common elements kept, at most; bits of the filter of repeated elements, at most.
COMMON = 1 << 20
MAX_FILTER_BITS = 30
#: Bytes of text whose elements are counted in one group, about.
RANGE_BYTES = 8 << 20


def sets(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row of a chunk, by row and value, and their rows."""
    low = LOWER[data]
    starts, ends, rows = word_spans(low, offs, SPACED)
    values, at = shingles(span_hashes(low, starts, ends), rows, len(offs) - 1, width)
    return per_row_unique(values, at)


class Counts:
    """What is known of elements over all documents: repeated, and common."""

    def __init__(self, bits: int, shift: int, flags: np.ndarray, common: np.ndarray) -> None:
        self.bits, self.shift, self.flags, self.common = bits, shift, flags, common

    def kinds(self, values: np.ndarray) -> np.ndarray:
        """0 for elements of one document, 2 for common ones, 1 for the rest."""
        at = (values >> U64(64 - self.bits)).astype(np.int64)
        out = (self.flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        if len(self.common):
            some = np.flatnonzero(out)
            short = values[some] >> U64(self.shift)
            place = np.minimum(np.searchsorted(self.common, short), len(self.common) - 1)
            out[some[self.common[place] == short]] = 2
        return out


def count_elements(texts: DataFrame, width: int) -> Counts:
    """One pass over all texts; what is shuffled is three bytes for each element of a document.

    Elements are told apart by their first bits only: the number of a range and 24 more.
    """
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    range_bits = max(4, (max(1, total // RANGE_BYTES) - 1).bit_length())
    bits = min(MAX_FILTER_BITS, max(range_bits + 10, (max(1, total // 6) - 1).bit_length()))
    shift = 64 - range_bits - 24
    least = max(64, total // 6 // COMMON)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(found, np.arange((1 << range_bits) + 1, dtype=U64) << U64(24))
            low = (found & U64(0xFFFFFF)).astype("<u4")
            three = low.view(np.uint8).reshape(-1, 4)[:, :3]
            once, many = [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                single = n[a:b] == 1
                once.append(three[a:b][single].tobytes())
                many.append(np.stack([low[a:b][~single], n[a:b][~single].astype("<u4")], axis=1).tobytes())
            some = [k for k in range(len(once)) if once[k] or many[k]]
            return pa.RecordBatch.from_pydict({"range": pa.array(some, pa.int32()), "once": pa.array([once[k] for k in some], pa.binary()), "many": pa.array([many[k] for k in some], pa.binary())})

        for batch in batches:
            for _, _, data, offs in chunks(batch.column(0)):
                values, _ = sets(data, offs, width)
                held.append(values >> U64(shift))
                size += len(values)
                if size >= 3_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, many = None, [], []

        def done() -> pa.RecordBatch:
            raw = np.frombuffer(b"".join(once), dtype=np.uint8).reshape(-1, 3).astype(np.int64)
            pairs = np.frombuffer(b"".join(many), dtype="<u4").reshape(-1, 2).astype(np.int64)
            values = np.concatenate([raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16, pairs[:, 0]])
            weights = np.concatenate([np.ones(len(raw), dtype=np.int64), pairs[:, 1]])
            order = np.argsort(values, kind="stable")
            found, start = np.unique(values[order], return_index=True)
            n = np.add.reduceat(weights[order], start) if len(found) else np.zeros(0, np.int64)
            own = bits - range_bits  # bits of the filter's number that a range's elements differ in
            flags = np.zeros(1 << own, dtype=np.uint8)
            flags[found[n > 1] >> (24 - own) if own <= 24 else found[n > 1] << (own - 24)] = 1
            common = found[n > least] | (now << 24)
            return pa.RecordBatch.from_pydict({"range": pa.array([now], pa.int32()), "flags": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary()), "common": pa.array([common.tolist()], pa.list_(pa.int64()))})

        for batch in batches:
            for k, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if now is not None and k != now:
                    yield done()
                    once, many = [], []
                now = k
                once.append(a)
                many.append(b)
        if now is not None:
            yield done()

    counted = texts.mapInArrow(count, "range int, once binary, many binary")
    summed = counted.repartition("range").sortWithinPartitions("range").mapInArrow(add, "range int, flags binary, common array<long>")
    flags = np.zeros(1 << (bits - 3), dtype=np.uint8)
    common: list[np.ndarray] = []
    part = 1 << (bits - range_bits - 3)
    for row in summed.toLocalIterator():
        flags[row["range"] * part : (row["range"] + 1) * part] = np.frombuffer(bytes(row["flags"]), dtype=np.uint8)
        common.append(np.array(row["common"], dtype=U64))
    return Counts(bits, shift, flags, np.sort(np.concatenate([np.zeros(0, U64), *common])))


def signatures(values: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Parities of hashed counters, as bytes."""
    bit = (mix(values + U64(0x2545F4914F6CDD1D)) >> U64(64 - 9)).astype(np.int64)
    odd = np.bincount(rows.astype(np.int64) * SIGNATURE_BITS + bit, minlength=n_rows * SIGNATURE_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n_rows, SIGNATURE_BITS), axis=1)


def describe(texts: DataFrame, counts: Counts, width: int, percent: int) -> DataFrame:
    """(row, set_id, n, keys, bits, elements) of every text; the last three null where no link is possible."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(1)):
                rows_n = hi - lo
                values, row = sets(data, offs, width)
                n = np.bincount(row, minlength=rows_n)
                first = np.concatenate([[0], np.cumsum(n)])
                ids = np.zeros(rows_n, dtype=U64)
                some = n > 0
                if some.any():
                    ids[some] = mix(np.add.reduceat(mix(values + U64(77)), first[:-1][some]) + n[some].astype(U64))
                kind = shared.value.kinds(values)
                order = np.lexsort((values, kind, row))
                place = np.arange(len(values)) - first[row[order]]
                need = n + (-percent * n) // 100 + 1  # n - ceil(percent n / 100) + 1
                use = order[(place < need[row[order]]) & (kind[order] > 0)]
                n_keys = np.bincount(row[use], minlength=rows_n)
                lists = lambda flat, at: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))
                keys = lists(values[use], np.concatenate([[0], np.cumsum(n_keys)]))
                go = n_keys > 0
                bits = signatures(values, row, rows_n)
                elements = lists(values, first)
                mask = pa.array(go)
                none = lambda kind: pa.nulls(rows_n, kind)
                import pyarrow.compute as pc

                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[lo:hi],
                        pa.array(ids.view(np.int64)),
                        pa.array(n.astype(np.int32)),
                        pc.if_else(mask, keys, none(keys.type)),
                        pa.array([b.tobytes() if g else None for b, g in zip(bits, go, strict=True)], pa.binary()),
                        pc.if_else(mask, elements, none(elements.type)),
                    ],
                    names=["row", "set_id", "n", "keys", "bits", "elements"],
                )

    row_type = texts.schema["row"].dataType.simpleString()
    return texts.mapInArrow(run, f"row {row_type}, set_id long, n int, keys array<long>, bits binary, elements array<long>")


def tiles(able: DataFrame, percent: int) -> DataFrame:
    """(tile, side, set_id, n): the sets to compare in each tile, sides 0 and 1 with each other, 2 among themselves.

    Near copies share many elements, and so many tiles of the same sets; one of those is kept.
    """
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int")
    rows = able.select(F.explode("keys").alias("key"), "set_id", "n", band.alias("band"))
    counts = rows.groupBy("key", "band").count()
    bands = counts.groupBy("key").agg(F.sum("count").alias("all"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("count") / CHUNK).cast("int").alias("m")))).alias("m")).where("all > 1").drop("all")
    joined = rows.join(bands, "key").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("m")[F.col("band")]).cast("int"))

    def with_band(other: int):
        there = F.col("m")[F.col("band") + other]
        each = F.sequence(F.lit(0), there - 1)
        if other == 0:
            made = F.transform(each, lambda c: F.struct(F.xxhash64("key", "band", "band", F.least(c, "own"), F.greatest(c, "own")).alias("tile"), F.when(c == F.col("own"), 2).otherwise((c < F.col("own")).cast("int")).alias("side")))
        elif other == 1:
            made = F.transform(each, lambda c: F.struct(F.xxhash64("key", "band", F.col("band") + 1, "own", c).alias("tile"), F.lit(0).alias("side")))
        else:
            made = F.transform(each, lambda c: F.struct(F.xxhash64("key", F.col("band") - 1, "band", c, "own").alias("tile"), F.lit(1).alias("side")))
        return F.when(there.isNotNull(), made).otherwise(F.array().cast("array<struct<tile:bigint,side:int>>"))

    dealt = joined.select("set_id", "n", F.explode(F.concat(with_band(-1), with_band(0), with_band(1))).alias("t"))
    dealt = cut(dealt.select("t.tile", "t.side", "set_id", "n"), "dealt")
    member = lambda seed: F.sum(F.xxhash64(F.lit(seed), "set_id", "side").cast("decimal(38,0)"))
    same = dealt.groupBy("tile").agg(member(1).alias("m1"), member(2).alias("m2"), F.count("*").alias("sets")).where("sets > 1")
    return dealt.join(same.groupBy("m1", "m2", "sets").agg(F.min("tile").alias("tile")).select("tile"), "tile")


def propose(ids: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, bits: np.ndarray, refuted: list, most: int, percent: int) -> list[tuple[int, int]]:
    """For each set of a tile its first ``most`` possible partners of other components among the sets before it.

    Sets come by size and id.
    """
    out: list[tuple[int, int]] = []
    known = {(int(a), int(b)) for a, r in zip(ids, refuted, strict=True) if r is not None for b in r}
    words = bits.view(np.uint64)
    for lo in range(0, len(ids), 256):
        hi = min(lo + 256, len(ids))
        first = int(np.searchsorted(n, -(-percent * int(n[lo]) // 100)))
        apart = np.bitwise_count(words[lo:hi, None, :] ^ words[None, first:hi, :]).sum(axis=2, dtype=np.int32)
        both = n[lo:hi, None] + n[None, first:hi]
        # overlap <= (both - apart) / 2, and a link needs (100 + percent) * overlap >= percent * both
        fine = (100 + percent) * (both - apart) >= 2 * percent * both
        fine &= 100 * n[None, first:hi] >= percent * n[lo:hi, None]
        fine &= comp[lo:hi, None] != comp[None, first:hi]
        fine &= (side[lo:hi, None] == 2) | (side[lo:hi, None] != side[None, first:hi])
        fine &= np.arange(lo, hi)[:, None] > np.arange(first, hi)[None, :]
        for i in np.flatnonzero(fine.any(axis=1)):
            left = most
            for j in np.flatnonzero(fine[i]):
                pair = (int(ids[lo + i]), int(ids[first + j]))
                if pair not in known:
                    out.append(pair)
                    left -= 1
                    if not left:
                        break
    return out


def _proposals(rows: DataFrame, most: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def tile(part: pa.Table) -> list[tuple[int, int]]:
            bits = np.frombuffer(b"".join(part.column("bits").to_pylist()), dtype=np.uint8).reshape(-1, SIGNATURE_BITS // 8)
            array = lambda c: part.column(c).to_numpy()
            return propose(array("set_id"), array("n").astype(np.int64), array("comp"), array("side"), bits, part.column("refuted").to_pylist(), most, percent)

        def pairs(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
            found = [p for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1 for p in tile(table.slice(int(a), int(b - a)))]
            found = np.array(found, dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_pydict({"a": found[:, 0], "b": found[:, 1]})

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            key = held.column("tile").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1]) if len(key) else np.zeros(1, np.int64)
            if len(cuts) > 1:
                yield pairs(held, cuts)
                held = held.slice(int(cuts[-1]))
        if held is not None and held.num_rows:
            yield pairs(held, np.array([0, held.num_rows]))

    # dealt by a hash of the tile: an exchange by the tile itself would be dropped above a join by it,
    # and adaptive execution may then turn that join into one that leaves the rows of a tile apart
    dealt = rows.withColumn("deal", F.xxhash64("tile")).repartition("deal").drop("deal")
    return dealt.sortWithinPartitions("tile", "n", "set_id").mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, elements: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy().view(U64), y.values.to_numpy().view(U64)
                if len(x) > len(y):
                    x, y = y, x
                same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                linked.append((100 + percent) * same >= percent * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    side = lambda name, column: elements.select(F.col("set_id").alias(name), F.col("elements").alias(column))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean")


def join(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(row, n_shingles, component_id) of every row, ``row`` being the row's id.

    ``component_id`` is the smallest id of the row's component (null ids don't count).  Null
    and empty texts have no shingles and are alone.  Repeated rows are linked like any
    equal texts.  Sets are told apart by a 64-bit digest, elements by 64-bit hashes.
    """
    texts = small_batches(docs).select(F.col(text_col).cast("string").alias("text"))
    counts = count_elements(texts, width)
    described = cut(describe(docs.select(F.col(id_col).alias("row"), F.col(text_col).cast("string").alias("text")), counts, width, percent), "sets")
    able = described.where(F.col("keys").isNotNull())
    elements = cut(able.dropDuplicates(["set_id"]).select("set_id", "n", "keys", "bits", "elements"), "elements")
    dealt = cut(tiles(elements, percent), "tiles")
    signed = elements.select("set_id", "bits")
    checked, labels, most = None, None, 1
    while True:
        if labels is None:
            rows = dealt.withColumns({"comp": F.col("set_id"), "refuted": F.lit(None).cast("array<long>")})
        else:
            rows = dealt.join(labels.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id"))
            mixed = rows.groupBy("tile").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("tile")
            failed = checked.where("not linked").groupBy("a").agg(F.collect_list("b").alias("refuted")).withColumnRenamed("a", "set_id")
            rows = rows.join(mixed, "tile").join(failed, "set_id", "left")
        rows = rows.join(signed, "set_id")
        found = _proposals(rows, most, percent).distinct()
        first = found.groupBy("a").agg(F.slice(F.sort_array(F.collect_set("b")), 1, most).alias("b")) if most == 1 else found.groupBy("a").agg(F.collect_set("b").alias("b"))
        new = cut(_verify(first.select("a", F.explode("b").alias("b")), elements, percent), "checked")
        if new.isEmpty():
            break
        checked = new if checked is None else checked.unionByName(new)
        links = checked.where("linked")
        labels = components(links)
        most *= 4
    named = described.select("row", "set_id", "n")
    if labels is not None:
        named = named.join(labels.withColumnRenamed("id", "set_id"), "set_id", "left")
    else:
        named = named.withColumn("comp", F.lit(None).cast("long"))
    named = named.withColumn("comp", F.coalesce("comp", "set_id"))
    least = named.where("n > 0").groupBy("comp").agg(F.min("row").alias("least"))
    out = named.where("n > 0").join(least, "comp").select("row", F.col("n").cast("long").alias("n_shingles"), F.col("least").alias("component_id"))
    return out.unionByName(named.where("n = 0").select("row", F.lit(0).cast("long").alias("n_shingles"), F.col("row").alias("component_id")))
