"""Probability of texts by a probabilistic suffix tree over words.

States are contexts of zero, one or two words.  A longer context is kept as a state if the
words after it are distributed differently enough from those after its suffix: the
divergence of the two, times the context's occurrences, must exceed ``PRICE`` per stored
word.  A word's probability is that of the longest state that is a suffix of its past.

The state without context has the shares of the training tokens, with 0.1 added to each
count.  A longer state stores the words that follow it at least ``LEAST`` times, less a
discount; what that leaves over is spread like the distribution of its suffix:

    p(w | c) = max(n(c w) - CUT, 0) / n(c)  [stored]  +  left(c) * p(w | suffix of c)

so every distribution sums to one.  The log probability of a text is then a sum: its score
without contexts, ``log left(c)`` for every state passed, and, for every stored n-gram met,
the log ratio of its probability to what the suffix alone gives.  Scoring is a look-up of
n-grams by key, never a walk.

Words are numbered: the commonest up to ``SYMBOLS`` have numbers of their own (a broadcast
table of that size at most), the others share one, inside which they are told apart by their
own counts.  So an n-gram is one BIGINT.  The tables of words and n-grams grow with the
corpus; they are counted by tasks, shuffled in buckets and stay in Spark.  Documents look
up the commonest n-grams in a broadcast table of at most ``COMMON`` rows, and the others by
a join; a bitmap of 2^``FILTER_BITS`` places keeps most n-grams that are in no table out of
that join, and decides nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, small_batches
from .kernels import LOWER, SPACED, chunks, span_hashes, word_spans
from .tally import ANSWER_BYTES, bucketed, common, looked_up, packed_counts, summed

#: Added to each count of the state without context.
ADDED = 0.1
#: A state stores the words that follow it so often at least, less ``CUT`` of each.
LEAST = 3
CUT = 0.75
#: Nats that a state's divergence must gain per stored word, and once more for itself.
PRICE = 3.0
#: Occurrences from which two words are a candidate context.
LEAST_CONTEXT = 3

SYMBOL_BITS = 20
#: Numbers: any rare word, the end of a text, its begin; then the common words.
RARE, END, BEGIN, FIRST = 0, 1, 2, 3
SYMBOLS = (1 << SYMBOL_BITS) - FIRST
#: N-grams that are looked up in a broadcast table, at most.
COMMON = 1 << 13
#: Questions that a task holds before it hands them on.
ASKED = 500_000
FILTER_BITS = 28
#: Primes near 2^FILTER_BITS: an n-gram's places in the bitmap are its key modulo each.
_PLACES = (268435399, 268435367)
_TRIPLE = 1 << 60
_LOW = (1 << SYMBOL_BITS) - 1


@dataclass(frozen=True)
class Vocabulary:
    """Common words by hash, counts by number, and totals of the training tokens."""

    hashes: np.ndarray
    counts: np.ndarray  # by number; RARE: all rare tokens, END: texts
    tokens: int
    words: int
    rare_words: int

    @property
    def total(self) -> float:
        return self.tokens + ADDED * (self.words + 1)

    def shares(self) -> np.ndarray:
        """Probability of every number in the state without context."""
        added = np.full(len(self.counts), ADDED)
        added[RARE] = ADDED * (self.rare_words + 1)
        added[BEGIN] = 0
        if not self.counts[END]:  # no text: the end is unknown as well
            added[END] = 0
        return (self.counts + added) / self.total


def sequences(vocabulary: Vocabulary, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words of all rows between begin and end; their rows; hashes and rows of rare words."""
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offs, SPACED)
    distinct, inverse = np.unique(span_hashes(data, starts, ends), return_inverse=True)
    at = np.searchsorted(vocabulary.hashes, distinct)
    known = np.zeros(len(distinct), dtype=bool)
    inside = at < len(vocabulary.hashes)
    known[inside] = vocabulary.hashes[at[inside]] == distinct[inside]
    number = np.where(known, at + FIRST, RARE)[inverse]
    n = np.bincount(rows, minlength=len(offs) - 1)
    begin = np.cumsum(n + 2) - (n + 2)
    out = np.empty(len(rows) + 2 * len(n), dtype=np.int64)
    out[begin], out[begin + n + 1] = BEGIN, END
    out[np.arange(len(rows)) + 2 * rows + 1] = number
    rare = number == RARE
    return out, np.repeat(np.arange(len(n)), n + 2), distinct[inverse[rare]], rows[rare]


def pairs_of(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all pairs of a text, and the place of their first word."""
    at = np.flatnonzero(seq[:-1] != END)
    return seq[at] << SYMBOL_BITS | seq[at + 1], at


def triples_of(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero((seq[:-2] != END) & (seq[1:-1] != END))
    return _TRIPLE | seq[at] << 2 * SYMBOL_BITS | seq[at + 1] << SYMBOL_BITS | seq[at + 2], at


@dataclass(frozen=True)
class Packed:
    """The blocks of a bitmap, compressed; unpickled, as in a Python worker, it is the array of the bytes."""

    parts: list[bytes]

    def __reduce__(self) -> tuple:
        return _unpacked, (self.parts,)


def _unpacked(parts: list[bytes]) -> np.ndarray:
    out = np.zeros(((1 << FILTER_BITS) // 8 // 4096, 4096), dtype=np.uint8)
    for part in parts:
        n = int.from_bytes(part[:4], "little")
        raw = np.frombuffer(pa.decompress(part[4:], decompressed_size=n * 4100, codec="zstd", asbytes=True), dtype=np.uint8)
        out[raw[: 4 * n].view(np.int32)] = raw[4 * n :].reshape(n, 4096)
    return out.reshape(-1)


def bitmap(keys: DataFrame, column: str) -> Packed:
    """Bitmap of the places of keys, made and compressed by Spark; 2^FILTER_BITS bits, whatever the number of keys.

    The driver only passes it on, compressed: what it holds is far below the 2^FILTER_BITS bits
    while few places are taken, and never much above them.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy().astype(np.int32) - np.int32(1)
            raw = block.tobytes() + b"".join(batch.column(1).to_pylist())
            part = len(block).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.binary())})

    # Spark numbers blocks and bits from one
    places = keys.select(F.explode(F.array(*(F.col(column) % p + 1 for p in _PLACES))).alias("place"))
    placed = places.select(F.bitmap_bucket_number("place").alias("b"), F.bitmap_bit_position("place").alias("p"))
    blocks = placed.groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    return Packed(blocks.mapInArrow(packed, "part binary").toArrow().column("part").to_pylist())


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether both places of each key are in the bitmap: surely if it was put in, rarely else."""
    found = np.ones(len(keys), dtype=bool)
    for p in _PLACES:
        place = keys[found] % p
        found[found] = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
    return found


@dataclass(frozen=True)
class Model:
    """Vocabulary, rare words (key, n), stored n-grams (key, n, value; a key's values add up), states.

    ``words`` and ``left`` are sent once, for training and scoring: the vocabulary, and what
    one-word states leave over by number (1 where there is no state).
    """

    vocabulary: Vocabulary
    words: Broadcast[Vocabulary]
    rare: DataFrame
    values: DataFrame
    left: Broadcast[np.ndarray]
    states: DataFrame


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    return small_batches(df).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_llm_text"))


def vocabulary(texts: DataFrame, n_texts: int, text_bytes: int) -> tuple[Vocabulary, DataFrame]:
    """The numbered words of all texts, and the table (key, n) of the rare ones."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for _, _, data, offs in chunks(batch.column(0)):
                data = LOWER[data]
                starts, ends, _ = word_spans(data, offs, SPACED)
                yield span_hashes(data, starts, ends).view(np.int64)

    counts = cut(packed_counts(texts, keys, text_bytes), "words")
    often, seldom = common(counts, SYMBOLS, "n")
    table = often.toArrow()
    hashes = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    sums = seldom.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    own = table.column("n").to_numpy()[order]
    numbers = np.concatenate([[sums[0], n_texts, 0], own]).astype(np.int64)
    return Vocabulary(hashes[order], numbers, int(numbers.sum()), len(own) + sums[1] + (n_texts > 0), sums[1]), seldom


def _kept(divergence: str) -> str:
    return f"{divergence} > {PRICE} * (k + 1)"


#: Divergence of a state from its suffix, times its occurrences: stored words, and the rest as one word.
_DIVERGENCE = "gain + if(n - held > 0, (n - held) * ln(((n - held) / n) / greatest(1 - share, 1e-12D)), 0D)"


def train(df: DataFrame, text_col: str) -> Model:
    """The tree of all texts of ``df``; null texts are empty, and every text counts its end.

    Repeated rows count each, an empty table gives a tree without words.  Long texts are
    taken whole.
    """
    texts = _texts(df, text_col)
    spark = df.sparkSession
    size, n_texts = texts.agg(F.coalesce(F.sum(F.octet_length("_llm_text")), F.lit(0)), F.count("*")).first()
    words, rare = vocabulary(texts, n_texts, size)
    shared = spark.sparkContext.broadcast(words)

    def pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for _, _, data, offs in chunks(batch.column(0)):
                yield pairs_of(sequences(shared.value, data, offs)[0])[0]

    pairs = cut(packed_counts(texts, pair_keys, size, LEAST), "pairs")

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, share = shared.value.counts.copy(), shared.value.shares()
        counts[BEGIN] = counts[END]
        for batch in batches:
            key = batch.column(0).to_numpy()
            more = {"c": counts[key >> SYMBOL_BITS], "below": share[key & _LOW]}
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more.values())], names=[*batch.schema.names, *more])

    own = pairs.mapInArrow(shares, "key long, n long, c long, below double").withColumn("context", F.shiftright("key", SYMBOL_BITS))
    one = cut(_states(own, "one-word-states"), "one-word-states")  # at most 2^20 contexts
    found = one.toArrow()
    left = np.ones(1 << SYMBOL_BITS)
    left[found.column("context").to_numpy()] = found.column("rest").to_numpy()
    left = spark.sparkContext.broadcast(left)

    def first_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs with their probability in the one-word state, and their value; pairs of no state are worth 0."""
        counts, share = shared.value.counts.copy(), shared.value.shares()
        counts[BEGIN] = counts[END]
        rest = left.value
        kept = rest < 1  # a state keeps something of every word it stores
        for batch in batches:
            key, n = (batch.column(k).to_numpy() for k in range(2))
            c = key >> SYMBOL_BITS
            below = share[key & _LOW]
            p = np.where(kept[c], (n - CUT) / counts[c] + rest[c] * below, below)
            value = np.where(kept[c], np.log(p / (rest[c] * below)), 0.0)
            context = kept[key & _LOW] & (n >= LEAST_CONTEXT)
            yield pa.RecordBatch.from_pydict({"key": key, "n": n, "p": p, "value": value, "context": context})

    pairs = cut(pairs.mapInArrow(first_values, "key long, n long, p double, value double, context boolean"), "pair-values")
    # contexts of two words whose last word is a state
    candidates = pairs.where("context").select(F.col("key").alias("pair"), F.col("n").alias("c"))
    bits = spark.sparkContext.broadcast(bitmap(candidates, "pair"))

    def triple_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for _, _, data, offs in chunks(batch.column(0)):
                key, _ = triples_of(sequences(shared.value, data, offs)[0])
                yield key[marked(bits.value, (key ^ _TRIPLE) >> SYMBOL_BITS)]

    triples = cut(packed_counts(texts, triple_keys, size, LEAST), "triples")
    bits.destroy()
    context = F.shiftright(F.col("key").bitwiseXOR(F.lit(_TRIPLE)), SYMBOL_BITS).alias("context")
    keyed = triples.select("key", "n", context)
    keyed = keyed.join(candidates.select(F.col("pair").alias("context"), "c"), "context")
    last = F.col("key").bitwiseAND(F.lit((1 << 2 * SYMBOL_BITS) - 1))
    keyed = cut(keyed.withColumn("last", last).join(pairs.select(F.col("key").alias("last"), F.col("p").alias("below")), "last").drop("last"), "triple-shares")
    two = cut(_states(keyed, "two-word-states"), "two-word-states")
    value = F.log(((F.col("n") - CUT) / F.col("c") + F.col("rest") * F.col("below")) / (F.col("rest") * F.col("below")))
    second = keyed.join(two.select("context", "rest"), "context").select("key", "n", value.alias("value"))
    # a pair that is a state passes on what it leaves over to the word after it; values of a key add up
    passed = two.select(F.col("context").alias("key"), "n", F.log("rest").alias("value"))
    values = cut(pairs.where("value <> 0").select("key", "n", "value").unionByName(passed).unionByName(second), "ngrams")
    named = one.withColumn("length", F.lit(1)).unionByName(two.withColumn("length", F.lit(2)))
    return Model(words, shared, rare, values, left, named)


def _states(rows: DataFrame, name: str) -> DataFrame:
    """(context, n, rest) of the contexts that are kept as states.

    ``rows`` has, per stored word: the context, its occurrences ``c``, the n-gram's count
    ``n`` and the word's probability ``below`` after the suffix.  Sums are made per context,
    map-side first.
    """
    gain = F.col("n") * F.log(F.col("n") / (F.col("c") * F.col("below")))
    sums = rows.groupBy("context").agg(F.max("c").alias("c"), F.sum("n").alias("held"), F.count("*").alias("k"), F.sum("below").alias("share"), F.sum(gain).alias("gain"))
    sums = sums.withColumnRenamed("c", "n")
    return sums.where(_kept(_DIVERGENCE)).selectExpr("context", "n", f"(n - held + {CUT} * k) / n AS rest")


def score(df: DataFrame, id_cols: list[str], text_col: str, model: Model) -> DataFrame:
    """(id columns, n_tokens, n_known, base_score, score) of every row, logs to base 10.

    Tokens are the words and one end; ``n_known`` counts those of the training texts.
    ``base_score`` is the text's probability without contexts, ``score`` that of the tree.
    Null and empty texts have only their end.  Repeated rows are scored each.
    """
    if clash := [c for c in id_cols if c in ("n_tokens", "n_known", "base_score", "score")]:
        raise ValueError(f"id columns {clash} have names of results")
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    buckets = 1 + size // ANSWER_BYTES
    own = ["bucket", "n", "body", "block", "row", "n_tokens", "known", "base", "extra"]
    often, seldom = common(model.values, COMMON, "n")
    table = often.select("key", "value").toArrow()
    hot = summed(table.column("key").to_numpy(), table.column("value").to_numpy())
    shared = df.sparkSession.sparkContext.broadcast((*hot, bitmap(seldom, "key")))
    vocabulary, left = model.words, model.left

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, hot_values, bits = shared.value
        words, rest = vocabulary.value, left.value
        root = np.log(np.maximum(words.counts + ADDED, ADDED))
        unknown = math.log(ADDED)
        block, number, held, size = TaskContext.get().partitionId() << 33, 0, [], 0

        def asked() -> Iterator[pa.RecordBatch]:
            """The questions of a block, packed."""
            rows = list(bucketed(buckets, *(np.concatenate([h[k] for h in held]) for k in range(3))))
            out = [pa.nulls(len(rows), f.type) for f in given]
            out += [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))]
            out += [pa.array([block] * len(rows), pa.int64()), *(pa.nulls(len(rows), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(out, names=[*(f.name for f in given), *own])

        given: list[pa.Field] = []
        for batch in batches:
            given = list(batch.schema)[:-1]
            for lo, hi, data, offs in chunks(batch.column(batch.num_columns - 1)):
                n_rows = hi - lo
                seq, row, rare, rare_row = sequences(words, data, offs)
                token = seq != BEGIN
                n = np.bincount(row[token], minlength=n_rows)
                known = np.bincount(row[token & (words.counts[seq] > 0) & (seq != RARE)], minlength=n_rows)
                base = np.where(seq == RARE, unknown, root[seq])
                base = np.bincount(row[token], weights=base[token], minlength=n_rows) - n * math.log(words.total)
                extra = np.bincount(row, weights=np.where(seq == END, 0.0, np.log(rest[seq])), minlength=n_rows)
                (two, at_two), (three, at_three) = pairs_of(seq), triples_of(seq)
                key, at = np.concatenate([two, three]), np.concatenate([row[at_two], row[at_three]])
                place = np.minimum(np.searchsorted(hot_keys, key), max(len(hot_keys) - 1, 0))
                found = hot_keys[place] == key if len(hot_keys) else np.zeros(len(key), dtype=bool)
                if found.any():
                    extra += np.bincount(at[found], weights=hot_values[place[found]], minlength=n_rows)
                cold = ~found
                cold[cold] = marked(bits, key[cold])
                # rare words are sent with the sign bit, n-grams without
                key = np.concatenate([key[cold], rare.view(np.int64) | np.int64(-(1 << 63))])
                at = np.concatenate([at[cold], rare_row])
                order = np.lexsort((key, at))
                key, at = key[order], at[order]
                first = np.ones(len(key), dtype=bool)
                first[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
                first = np.flatnonzero(first)
                if len(first):
                    held.append((key[first], number + at[first], np.diff(np.append(first, len(key))).astype(np.int64)))
                    size += len(first)
                # a row itself asks nothing; its bucket is any
                rows = number + np.arange(n_rows)
                number += n_rows
                zero = np.zeros(n_rows, dtype=np.int32)
                out = [*(c.slice(lo, n_rows) for c in batch.columns[:-1]), pa.array(rows % buckets), pa.array(zero), pa.nulls(n_rows, pa.binary())]
                out += [pa.array(np.full(n_rows, block)), pa.array(rows)]
                out += [pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(extra)]
                yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:-1], *own])
                if size > ASKED:
                    yield from asked()
                    block, number, held, size = block + 1, 0, [], 0
        if held:
            yield from asked()

    plain = {c: f"_llm_id{k}" for k, c in enumerate(id_cols)}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_llm_text")
    picked = small_batches(df).select(*(F.col(c).alias(plain[c]) for c in id_cols), text)
    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]]
    asked = picked.mapInArrow(look, ", ".join([*head, "bucket long, n int, body binary, block long, row long, n_tokens long, known long, base double, extra double"]))
    # a rare word adds to the score without contexts, a stored n-gram to the tree's
    rare = model.rare.select(F.col("key").bitwiseOR(F.lit(-(1 << 63))).alias("key"), F.log((F.col("n") + ADDED) / ADDED).alias("value"))
    found = looked_up(asked, seldom.select("key", "value").unionByName(rare), size, ["_llm_known", "_llm_words", "_llm_ngrams"])
    base, ten = F.col("base") + F.col("_llm_words"), F.lit(math.log(10))
    total = base + F.col("extra") + F.col("_llm_ngrams")
    return found.select(*(F.col(plain[c]).alias(c) for c in id_cols), "n_tokens", (F.col("known") + F.col("_llm_known")).alias("n_known"), (base / ten).alias("base_score"), (total / ten).alias("score"))
