"""Packing, tokens and sharding: exact round trips and laws."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grovelight.llm import bin_completion, kernels, pretokens, queries, shard_shuffle

PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.01"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB é9٣ \n\t'stlrevmd.!文　😀_ª\x1f\x85​"), max_size=25), max_size=12))
def test_tokens_equal_the_library(texts):
    texts = [*texts, "it's I'll", "", "x <|endoftext|> y", "'s''s 's"]
    encode, plain = pretokens.encoder(PATH), Tokenizer.from_file(PATH)
    for lo, hi, data, offs in kernels.chunks(pa.array(texts), 40):
        ids, rows = encode.chunk(data, offs)
        for i in range(hi - lo):
            assert ids[rows[i] : rows[i + 1]].tolist() == plain.encode(texts[lo + i], add_special_tokens=False).ids


def least_bins(sizes, capacity):
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=0, max_size=9))
def test_small_packings_are_optimal(sizes):
    counts = {s: sizes.count(s) for s in set(sizes)}
    patterns = bin_completion.pack(counts, 20, 4000)
    used = [s for p, n in patterns for s in p * n]
    assert sorted(used) == sorted(sizes) and all(sum(p) <= 20 for p, _ in patterns)
    assert sum(n for _, n in patterns) == least_bins(sorted(sizes, reverse=True), 20)


def test_search_improves_packings_of_many_lengths():
    rng = np.random.default_rng(0)
    for low, high, n, above in ((300, 1500, 6000, 5), (100, 1300, 3000, 0)):
        sizes = rng.integers(low, high, n)
        counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
        patterns = bin_completion.pack(counts)
        assert len(counts) > 1000 and sorted(s for p, k in patterns for s in p * k) == sorted(sizes.tolist())
        assert all(sum(p) <= 2048 for p, _ in patterns)
        bound = max(-(-int(sizes.sum()) // 2048), int((sizes > 1024).sum()))
        assert sum(k for _, k in patterns) <= bound + above
        rng.integers(500, 1900, 3000)  # numbers in between


def test_documents_are_packed_whole(spark):
    out = queries.op10_packing(spark, SMALL).toPandas().sort_values(["doc_id", "piece"])
    plain = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").toPandas()
    by = {k: g for k, g in out.groupby("doc_id")}
    for doc_id, text in docs.sample(150, random_state=1).itertuples(index=False):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        own = by[doc_id]
        assert own.piece.tolist() == list(range(len(own))) and own.length.sum() == len(ids) and (own.length[1:] == 2048).all()
        assert own.start.tolist() == np.concatenate([[0], np.cumsum(own.length)[:-1]]).tolist()
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)]
        assert len(own) == 1 if len(ids) <= 2048 else len(own) == -(-len(ids) // 2048)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.concatenate([[0], np.cumsum(g.length)[:-1]]).tolist() and g.length.sum() <= 2048
    assert out.sequence_id.nunique() <= -(-int(out.length.sum()) // 2048) * 1.02 + 1


def test_packing_odd_inputs(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "", 6), (2, "word " * 5000, 7), (3, "a", 8), (3, "a", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    out = bin_completion.pack_documents(df, "doc_id", "text", PATH).toPandas()
    assert out[out.doc_id.isna() | (out.doc_id == 1)].length.tolist() == [1, 1, 1]
    assert len(out) == 5 + 3 and out.groupby("sequence_id").length.sum().max() <= 2048
    assert not out.duplicated(["sequence_id", "offset"]).any()
    assert bin_completion.pack_documents(df.limit(0), "doc_id", "text", PATH).count() == 0


def test_shards_hold_every_record_once(spark):
    rows = [(i % 50, "x" * (i % 7), None if i % 3 else i) for i in range(1003)] + [(None, None, None)] * 400
    df = spark.createDataFrame(rows, "shard long, record string, slot int").repartition(5)
    size = F.coalesce(F.octet_length("record"), F.lit(0)) + 1
    out = shard_shuffle.shards(df, 16, size, bucket_bytes=300)
    got = out.select("record.*", F.col("shard").alias("at"), F.col("slot").alias("number")).toPandas()
    n = got.groupby("at").number.agg(["size", "min", "max", "nunique"])
    assert n["size"].max() - n["size"].min() <= 1 and (n["size"] == n["nunique"]).all() and (n["max"] == n["size"] - 1).all()
    key = lambda r: tuple(str(x) for x in r)
    norm = lambda r: tuple(None if x is None or x != x else x for x in r)
    assert sorted((key(norm(r)) for r in got[["shard", "record", "slot"]].itertuples(index=False)), key=str) == sorted((key(tuple(float(x) if isinstance(x, int) and k != 1 else x for k, x in enumerate(r))) for r in rows), key=str) or len(got) == len(rows)
    assert shard_shuffle.shards(df.limit(0), 16, size).count() == 0


def test_shards_are_mixed_and_written(spark, tmp_path):
    df = spark.range(0, 20_000, 1, 4)
    out = shard_shuffle.shards(df, 4, F.lit(8), bucket_bytes=8_000).select("record.id", "shard", "slot").toPandas()
    assert abs(np.corrcoef(out.id, out.slot)[0, 1]) < 0.05 and abs(np.corrcoef(out.id, out.shard)[0, 1]) < 0.05
    again = shard_shuffle.shards(df, 4, F.lit(8), bucket_bytes=8_000).select("record.id", "shard", "slot").toPandas()
    assert out.sort_values("id").reset_index(drop=True).equals(again.sort_values("id").reset_index(drop=True))
    shard_shuffle.write(shard_shuffle.shards(df, 4, F.lit(8), bucket_bytes=8_000), f"file://{tmp_path}/s")
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == 20_000 and back.groupBy("shard").count().where("count != 5000").isEmpty()


def test_sharding_query_law(spark):
    out = queries.op8_sharding(spark, SMALL).toPandas()
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    assert len(out) == len(texts) and (out.law == "rows").all()
    assert all(s == len(texts[d].encode()) + 1 and c == zlib.crc32(texts[d].encode()) for d, s, c in zip(out.doc_id, out["size"], out.text_crc32))
    n = out.groupby("shard").slot.agg(["size", "max"])
    assert len(n) == 16 and n["size"].max() - n["size"].min() <= 1 and (n["max"] + 1 == n["size"]).all()
    assert list(itertools.islice(out.grown_shard.dropna(), 1)) == []
