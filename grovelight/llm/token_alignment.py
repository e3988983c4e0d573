"""Alignment of the tokens of two tokenizers over the same bytes, and statistics of their links.

Each tokenizer cuts a text into parts that it encodes one by one (A: pretokens; B: blanks with
the signs up to the next blank), so a worker encodes every distinct part once.  All tokens of
a chunk of texts, of A and of B, are intervals of its bytes.  They are sorted by start (A before B) and the
running maximum of the ends is taken: a group ends where the next start reaches it.  Within a
group every stretch between two starts belongs to one token of A and one of B, which is a
link of the two; since tokens follow each other without gaps, these are all overlapping pairs.

Links are counted per pair of ids over all texts, by Spark.  How often a document's links
occur is then looked up: pairs that hold at least a ``1 / COMMON`` of all links in a broadcast
table of at most ``COMMON`` rows, all others by a join.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, small_batches
from .kernels import chunks, codepoints, span_hashes
from .pretokens import byte_letters, merge_ranks, starts_of
from .tally import HELD, NO_COUNTS, common, merged

#: Pairs of ids that are looked up in a broadcast table, at most (13 bytes each).
COMMON = 1 << 20
#: Distinct parts whose ids a worker keeps.
KEPT = 400_000

BLANK = 0x20
MARK = "▁"


class Parts:
    """Ids of byte strings, each distinct one encoded once; one per tokenizer and worker."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]]) -> None:
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.lens, self.begin, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def ids(self, data: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all spans, one after the other, and how many each has."""
        if not len(low):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        hashes, first, inverse = np.unique(span_hashes(data, low, high), return_index=True, return_inverse=True)
        if len(self.known) > KEPT:
            self.clear()
        values = hashes.tolist()
        new = [k for k, h in enumerate(values) if h not in self.known]
        if new:
            raw = data.tobytes()
            found = self.encode([raw[low[e] : high[e]] for e in first[new]])
            lens = np.array([len(i) for i in found], dtype=np.int64)
            for k, j in enumerate(new, len(self.lens)):
                self.known[values[j]] = k
            self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(lens) - lens])
            self.lens = np.concatenate([self.lens, lens])
            self.pool = np.concatenate([self.pool, np.fromiter((x for i in found for x in i), dtype=np.int32, count=int(lens.sum()))])
        slot = np.fromiter((self.known[h] for h in values), dtype=np.int64, count=len(values))[inverse]
        lens = self.lens[slot]
        ends = np.cumsum(lens)
        return self.pool[np.repeat(self.begin[slot] - (ends - lens), lens) + np.arange(ends[-1])], lens


class Tokens:
    """A tokenizer as this module needs it: the bytes of every id, and the ids of whole texts."""

    def __init__(self, pieces: list[bytes], parts: Parts, split: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        self.sizes, self.begin = sizes, np.cumsum(sizes) - sizes
        self.letters = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.parts, self.split = parts, split

    def chunk(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and how many each row has."""
        low = np.flatnonzero(self.split(data, offs))
        high = np.append(low[1:], len(data)) if len(low) else low
        ids, lens = self.parts.ids(data, low, high)
        row = np.searchsorted(offs, low, "right") - 1
        return ids, np.bincount(row, weights=lens, minlength=len(offs) - 1).astype(np.int64)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of tokens, one after the other."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.letters[np.repeat(self.begin[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def byte_level(path: str) -> Tokens:
    """Tokenizer A: byte-level BPE.  The strings of its special tokens are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    letters = byte_letters()
    words = {i: t for t, i in library.get_vocab(with_added_tokens=True).items()}
    pieces = [bytes(letters.get(c, 63) for c in words.get(i, "")) for i in range(max(words) + 1)]
    ranks = merge_ranks(library)
    if ranks is not None:
        import tiktoken

        fast = tiktoken.Encoding("parts", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

        def encode(parts: list[bytes]) -> list[list[int]]:
            return [fast.encode_ordinary(p.decode("utf-8", "replace")) for p in parts]
    else:

        def encode(parts: list[bytes]) -> list[list[int]]:
            return [e.ids for e in library.encode_batch([p.decode("utf-8", "replace") for p in parts], add_special_tokens=False)]

    def split(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        points, at = codepoints(data, offs)
        out = np.zeros(len(data), dtype=bool)
        first = np.flatnonzero((data & 0xC0) != 0x80)
        if len(first) == len(points):
            out[first[starts_of(points, at)]] = True
        elif len(offs) > 2:  # not valid UTF-8: row by row, so that all others are cut
            for lo, hi in zip(offs[:-1], offs[1:], strict=True):
                out[lo:hi] = split(data[lo:hi], np.array([0, hi - lo]))
        else:  # a row as it is; its bytes will not agree
            out[:1] = True
        return out

    return Tokens(pieces, Parts(encode), split)


def pieces_with_blanks(path: str) -> Tokens:
    """Tokenizer B: pieces that stand for a text with a blank put before it.

    No piece goes on after a blank unless it is all blanks, so blanks with what follows are
    encoded alone; a vocabulary for which that is untrue is given whole texts.  The library
    puts no blank before an empty text, so a last blank's ids are those that it adds to a text.
    """
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    pieces = [bytes([int(n[3:5], 16)]) if library.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
    apart = not any(MARK in n[1:] and n.strip(MARK) for n in names)
    last_blank = library.encode("a ")[len(library.encode("a")) :]

    def encode(parts: list[bytes]) -> list[list[int]]:
        found = library.encode([p[1:].decode("utf-8", "replace") for p in parts], num_threads=1)
        return [ids if len(p) > 1 else last_blank for ids, p in zip(found, parts, strict=True)]

    def split(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        blank = data == BLANK
        out = np.zeros(len(data), dtype=bool)
        if apart:
            out[1:] = blank[1:] & ~blank[:-1]
        out[offs[:-1][np.diff(offs) > 0]] = True
        return out

    return Tokens(pieces, Parts(encode), split)


_loaded: dict[tuple[str, str], Tokens] = {}


def tokens(path: str, kind: Callable[[str], Tokens]) -> Tokens:
    if (key := (kind.__name__, path)) not in _loaded:
        _loaded[key] = kind(path)
    return _loaded[key]


def coalesce(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of two lists of intervals, each without gaps, over the same bytes.

    Returns the group of every A and every B interval, and the A and the B interval of
    every link.
    """
    n = len(start_a)
    start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    side = np.repeat(np.array([0, 1]), [n, len(start_b)])
    order = np.lexsort((side, start))
    start, end, side = start[order], end[order], side[order]
    reached = np.maximum.accumulate(end)
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = start[1:] >= reached[:-1]
    group = np.cumsum(fresh) - 1
    last_a, last_b = np.cumsum(side == 0) - 1, np.cumsum(side == 1) - 1
    stretch = np.ones(len(start), dtype=bool)
    stretch[:-1] = start[1:] != start[:-1]  # the last interval to start there: both sides are known
    return group[side == 0], group[side == 1], last_a[stretch], last_b[stretch]


_digits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def group_text(group_a: np.ndarray, group_b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, new_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``a1,a2|b1;a3|b2`` of all rows, and where each starts; ``new_a`` marks rows' first tokens."""
    if not _digits:
        names = [str(i).encode() for i in range(100_000)]
        size = np.array([len(x) for x in names], dtype=np.int64)
        _digits.append((np.frombuffer(b"".join(names), dtype=np.uint8), size, np.cumsum(size) - size))
    letters, size, begin = _digits[0]
    side = np.repeat(np.array([0, 1], dtype=np.int8), [len(ids_a), len(ids_b)])
    group = np.concatenate([group_a, group_b])
    order = np.lexsort((side, group))
    side, group, ids = side[order], group[order], np.concatenate([ids_a, ids_b])[order]
    new = np.concatenate([new_a, np.zeros(len(ids_b), dtype=bool)])[order]
    sizes = size[ids] + 1
    ends = np.cumsum(sizes)
    at = np.repeat(begin[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    out = letters[np.minimum(at, len(letters) - 1)]
    sign = np.full(len(ids), ord(","), dtype=np.uint8)
    sign[:-1][group[1:] != group[:-1]] = ord(";")
    sign[:-1][(group[1:] == group[:-1]) & (side[1:] != side[:-1])] = ord("|")
    out[ends - 1] = sign
    return out, np.append((ends - sizes)[new], ends[-1] if len(ends) else 0)


def _aligned(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, text: bool) -> Iterator[pa.RecordBatch]:
    a, b = tokens(path_a, byte_level), tokens(path_b, pieces_with_blanks)
    width = len(b.sizes)
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        for lo, hi, data, offs in chunks(column):
            n_rows = hi - lo
            ids_a, n_a = a.chunk(data, offs)
            ids_b, n_b = b.chunk(data, offs)
            # rows that both sides give back byte by byte, and that have a text after the blank
            good = np.diff(offs) > 1
            for side, ids, n in ((a, ids_a, n_a), (b, ids_b, n_b)):
                sizes = np.bincount(np.repeat(np.arange(n_rows), n), weights=side.sizes[ids], minlength=n_rows).astype(np.int64)
                if (sizes != np.diff(offs)).any():
                    good &= sizes == np.diff(offs)
                    back, at = side.joined(ids), np.concatenate([[0], np.cumsum(sizes)])
                    for r in np.flatnonzero(good):
                        good[r] = np.array_equal(back[at[r] : at[r + 1]], data[offs[r] : offs[r + 1]])
                else:
                    wrong = np.flatnonzero(side.joined(ids) != data)
                    good[np.searchsorted(offs, wrong, "right") - 1] = False
            keep_a, keep_b = np.repeat(good, n_a), np.repeat(good, n_b)
            ids_a, ids_b, n_a, n_b = ids_a[keep_a], ids_b[keep_b], n_a * good, n_b * good
            ends_a, ends_b = np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])
            group_a, group_b, link_a, link_b = coalesce(ends_a - a.sizes[ids_a], ends_a, ends_b - b.sizes[ids_b], ends_b)
            row_a = np.repeat(np.arange(n_rows), n_a)
            new_a = np.ones(len(ids_a), dtype=bool)
            new_a[1:] = row_a[1:] != row_a[:-1]
            first = np.ones(len(ids_a), dtype=bool)
            first[1:] = group_a[1:] != group_a[:-1]
            n_groups, row = np.bincount(row_a[first], minlength=n_rows), row_a[link_a]
            # distinct pairs of each row with their counts
            pair = ids_a[link_a].astype(np.int64) * width + ids_b[link_b]
            held, times = np.unique(row.astype(np.int64) << 40 | pair, return_counts=True)
            spans = np.searchsorted(held, np.arange(n_rows + 1, dtype=np.int64) << 40)
            listed = pa.array(spans.astype(np.int32))
            out = [
                *(batch.column(k).slice(lo, n_rows) for k in range(batch.num_columns - 1)),
                *(pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_groups, np.bincount(row, minlength=n_rows))),
            ]
            written, at = group_text(group_a, group_b, ids_a, ids_b, new_a)
            raw, shown, k = written.tobytes(), [], 0
            for there in n_a > 0:
                shown.append(raw[at[k] : at[k + 1] - 1] if there else b"")
                k += bool(there)
            if text:
                out.append(pa.array([s.decode() for s in shown]))
            else:
                out.append(pa.array([hashlib.sha256(s).hexdigest() if s else "" for s in shown]))
            out.append(pa.ListArray.from_arrays(listed, pa.array((held & ((1 << 40) - 1)).astype(np.int64))))
            out.append(pa.ListArray.from_arrays(listed, pa.array(times.astype(np.int32))))
            names = [*batch.schema.names[:-1], "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
            yield pa.RecordBatch.from_arrays(out, names=names)


def align(df: DataFrame, id_cols: list[str], text_col: str, path_a: str, path_b: str, text: bool = True) -> DataFrame:
    """(id columns, n_a, n_b, n_groups, n_links, groups, pairs, times) of every row.

    ``groups`` lists the ids of every group in order (``a1,a2|b1;a3|b2``), or, without
    ``text``, is its SHA-256.  ``pairs`` are the distinct linked pairs of ids, as
    ``a * size of B + b``, and ``times`` how many links hold each.  Texts that are null,
    empty, or not given back byte by byte by both sides have no tokens: zeros, empty lists
    and an empty ``groups``.  Repeated rows are rows of their own; a text is taken whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _aligned(batches, path_a, path_b, text)

    spaced = F.concat(F.lit(" "), F.col(text_col).cast("string")).alias("_llm_text")
    picked = small_batches(df).select(*id_cols, spaced)
    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]]
    return picked.mapInArrow(run, ", ".join([*head, "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"]))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n) of the lists of a task, handed on whenever many are held."""
    kept, size = [NO_COUNTS], 0

    def handed(pair: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(pair), 200_000):
            yield pa.RecordBatch.from_pydict({"pair": pair[lo : lo + 200_000], "n": n[lo : lo + 200_000]})

    for batch in batches:
        pair = batch.column(0).flatten().to_numpy()
        kept.append((pair, batch.column(1).flatten().to_numpy().astype(np.int64)))
        size += len(pair)
        if size > HELD:
            kept = [merged(kept)]
            size = len(kept[0][0])
            if size > HELD // 2:
                yield from handed(*kept[0])
                kept, size = [NO_COUNTS], 0
    yield from handed(*merged(kept))


def link_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, count, best) over all rows: ``best`` if no pair of the same B id has more links."""
    counts = cut(aligned.select("pairs", "times").mapInArrow(_summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("count")), "links")
    b = F.pmod(F.col("pair"), F.lit(width))
    most = counts.groupBy(b.alias("_llm_b")).agg(F.max("count").alias("_llm_most"))  # at most one row per id of B
    joined = counts.withColumn("_llm_b", b).join(most, "_llm_b")
    return cut(joined.select("pair", "count", (F.col("count") == F.col("_llm_most")).alias("best")), "links-best")


def link_statistics(aligned: DataFrame, id_cols: list[str], counts: DataFrame) -> DataFrame:
    """``aligned`` (stored) with n_best and count_sum in the place of its lists.

    ``n_best`` counts the links whose pair is a best one of its B id, ``count_sum`` adds the
    counts of all links' pairs.
    """
    hot, cold = common(counts, COMMON)
    table = hot.orderBy("pair").toArrow()
    shared = aligned.sparkSession.sparkContext.broadcast((table.column("pair").to_numpy(), table.column("count").to_numpy(), table.column("best").to_numpy(zero_copy_only=False)))
    keep = [c for c in aligned.columns if c not in ("pairs", "times")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_pair, at_count, at_best = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            pair, n = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            sizes = pairs.value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), sizes)
            k = np.minimum(np.searchsorted(at_pair, pair), max(len(at_pair) - 1, 0))
            found = at_pair[k] == pair if len(at_pair) else np.zeros(len(pair), dtype=bool)
            best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            if found.any():
                np.add.at(best, row[found], n[found] * at_best[k[found]])
                np.add.at(total, row[found], n[found] * at_count[k[found]])
            spans = np.concatenate([[0], np.cumsum(np.bincount(row[~found], minlength=batch.num_rows))]).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(spans), pa.array(x[~found])) for x in (pair, n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(best), pa.array(total), *rest], names=[*keep, "n_best", "count_sum", "pairs", "times"])

    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema.fields if f.name in keep]
    looked = aligned.mapInArrow(look, ", ".join([*head, "n_best long, count_sum long, pairs array<long>, times array<long>"]))
    looked = cut(looked.withColumn("_llm_row", F.monotonically_increasing_id()), "looked")
    rare = looked.select("_llm_row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("_llm_row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("n"))
    more = rare.join(cold, "pair").groupBy("_llm_row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("_llm_best"), F.sum(F.col("n") * F.col("count")).alias("_llm_sum"))
    added = looked.drop("pairs", "times").join(more, "_llm_row", "left")
    add = lambda c, x: (F.col(c) + F.coalesce(F.col(x), F.lit(0))).alias(c)
    return added.select(*keep, add("n_best", "_llm_best"), add("count_sum", "_llm_sum"))


def align_corpus(df: DataFrame, id_cols: list[str], text_col: str, path_a: str, path_b: str, text: bool = False) -> DataFrame:
    """``align`` with n_best and count_sum of every row in the place of the lists of pairs.

    Counts are over all rows of ``df``, repeated ones included.  An empty table gives an
    empty result.  Other columns of ``df`` are not read.
    """
    taken = ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times", "n_best", "count_sum"]
    own = {c: f"_llm_id{k}" for k, c in enumerate(id_cols)}
    renamed = df.select(*(F.col(c).alias(own[c]) for c in id_cols), F.col(text_col).alias("_llm_t"))
    if clash := [c for c in id_cols if c in taken]:
        raise ValueError(f"id columns {clash} have names of results")
    aligned = cut(align(renamed, list(own.values()), "_llm_t", path_a, path_b, text), "aligned")
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    found = link_statistics(aligned, list(own.values()), link_counts(aligned, width))
    return found.select(*(F.col(own[c]).alias(c) for c in id_cols), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
