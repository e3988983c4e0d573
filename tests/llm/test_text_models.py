"""Language ID, toxicity and quality: held-out accuracy and odd inputs."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grovelight.llm import hd_language, kernels, kn_toxicity, queries, subword_quality

SMALL = "/root/testdata/sf0.01"


def crc(ids, folds):
    return np.array([zlib.crc32(str(i).encode()) % folds for i in ids])


def auc(score, y):
    order = np.argsort(np.argsort(score))
    return (order[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_words_and_shingles_match_plain_python():
    rng = np.random.default_rng(1)
    alphabet = ["a", "B", "é", " ", "\n", "\t", "x1", ".", "文", ""]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(300)] + [None]
    for _, _, data, offs in kernels.chunks(pa.array(texts), 200):
        low = kernels.LOWER[data]
        starts, ends, rows = kernels.word_spans(low, offs, kernels.SPACED)
        raw = low.tobytes()
        expected = [(r, w) for r in range(len(offs) - 1) for w in raw[offs[r] : offs[r + 1]].split()]
        assert [(int(r), raw[a:b]) for a, b, r in zip(starts, ends, rows)] == expected
        hashes = kernels.span_hashes(low, starts, ends)
        assert len(set(hashes.tolist())) == len({w for _, w in expected})
        found, at = kernels.shingles(hashes, rows, len(offs) - 1, 5)
        for r in range(len(offs) - 1):
            words = [w for k, w in expected if k == r]
            plain = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
            assert len(set(found[at == r].tolist())) == len(plain)


def test_language_of_held_out_documents(spark):
    out = queries.op3_language_id(spark, SMALL).toPandas()
    lang = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").toPandas()
    both = out.merge(lang, on="doc_id")
    assert len(both) == len(lang) and both.score.between(0, 1).all()
    assert (both.held_out == (crc(both.doc_id, 4) == 2)).all()
    assert (both.lang_pred == both.lang)[both.held_out].mean() > 0.98


def test_bundle_is_the_sum_of_bound_letter_vectors():
    d = 64
    data, offs = kernels.strings(pa.array(["Ab, c", None, "99"]))
    got, has = hd_language.bundles(data, offs, d)
    v = {c: hd_language.letter_vectors(np.array([ord(c) if c != " " else 0], dtype=np.uint32), d)[0] for c in "abc "}
    want = sum(np.roll(v[x], 2) * np.roll(v[y], 1) * v[z] for x, y, z in [" ab", "ab ", "b c", " c "])
    assert np.allclose(got[0], want) and has.tolist() == [True, False, False] and not got[1:].any()


def test_language_odd_inputs(spark):
    rows = [(1, "the cat sat on the mat", "en"), (1, "the cat sat on the mat", "en"), (2, "le chat est la", "fr"), (3, None, "fr"), (4, "", None), (5, "123 !?", "en"), (None, "the mat", None), (6, "le " * 20000, "fr")]
    df = spark.createDataFrame(rows, "id long, score string, lang_pred string")
    profiles = hd_language.learn(df, "score", "lang_pred")
    out = hd_language.identify(df, ["id"], "score", profiles).collect()
    assert len(out) == 8 and sorted(profiles) == ["en", "fr"]
    by = {r["id"]: r for r in out}
    assert by[3]["lang_pred"] == by[4]["lang_pred"] == by[5]["lang_pred"] == "und" and by[3]["score"] == 0
    assert by[6]["lang_pred"] == "fr" and by[None]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in hd_language.identify(df, ["id"], "score", {}).collect()} == {"und"}
    assert hd_language.identify(df.limit(0), ["id"], "score", profiles).count() == 0


@pytest.mark.parametrize(("query", "label", "cut", "least"), [("op1_toxicity", "toxic", 0.5, 0.75), ("op5_quality", "quality", 0.3, 0.9)])
def test_scores_of_held_out_documents(spark, query, label, cut, least):
    out = queries.QUERIES[query](spark, SMALL).toPandas()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas()
    assert len(out) == 1000 and out.score.between(0, 1).all()
    assert (out.held_out == (crc(out.doc_id, 5) == 0)).all() and (out.predicted == (out.score >= cut)).all()
    held = out[out.held_out].merge(labels, on="doc_id")
    assert auc(held.score.to_numpy(), held[label].to_numpy()) > least


def _odd(spark):
    rows = [(i, f"good plain words number {i} here", "a") for i in range(40)] + [(100 + i, f"you stupid idiot {i} trash", "b") for i in range(40)]
    rows += [(200, None, None), (201, "", ""), (None, "who are you", None), (3, rows[3][1], "a"), (202, "stupid " * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i in [*range(40), *range(100, 140)]] + [(None, 1), (5, None), (500, 1)], "doc_id long, y int")
    return docs, labels


def test_toxicity_odd_inputs(spark):
    docs, labels = _odd(spark)
    model = kn_toxicity.train(docs, labels, "doc_id", "text", "y", F.lit(True), F.col("doc_id") % 4 == 0)
    out = kn_toxicity.score(docs, ["doc_id"], "text", model).toPandas()
    assert len(out) == 85 and out.columns.tolist() == ["doc_id", "score"] and out.score.notna().all()
    assert out[out.doc_id.between(0, 39)].score.max() < out[out.doc_id.between(100, 139)].score.min()
    nothing = kn_toxicity.train(docs.limit(0), labels.limit(0), "doc_id", "text", "y", F.lit(True), F.lit(True))
    assert kn_toxicity.score(docs, ["doc_id"], "text", nothing).select("score").distinct().count() == 1
    assert kn_toxicity.score(docs.limit(0), ["doc_id"], "text", model).count() == 0


def test_shared_backoff_cancels_for_unseen_runs():
    code = np.array([1, 33, 1057, 40], dtype=np.int32)
    n = np.array([5, 5, 5, 9])
    r = kn_toxicity.ratios(code, n, np.array([0, 0, 2, 0]), np.array([0, 3, 2, 0]))
    dense = r.dense()
    assert dense[40] == r.histories[40 >> 5] and sorted(r.cells) == [33, 1057]
    assert dense[33] > 0  # seen in toxic texts only


def test_quality_odd_inputs(spark):
    docs, labels = _odd(spark)
    model = subword_quality.train(docs, labels, "doc_id", "text", "y", F.lit(True))
    out = subword_quality.score(docs, ["doc_id"], "text", model).toPandas()
    assert len(out) == 85 and out.score.between(0, 1).all()
    assert out[out.doc_id.between(0, 39)].score.max() < out[out.doc_id.between(100, 139)].score.min()
    assert out[out.doc_id.isin([200, 201])].score.nunique() == 1
    nothing = subword_quality.train(docs, labels.limit(0), "doc_id", "text", "y", F.lit(True))
    assert subword_quality.score(docs, ["doc_id"], "text", nothing).select("score").distinct().count() == 1
    assert subword_quality.score(docs.limit(0), ["doc_id"], "text", model).count() == 0


def test_two_toxicity_models_in_one_session(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    inverted = labels.withColumn("toxic", 1 - F.col("toxic"))
    every = F.col("doc_id").isNotNull()
    models = [kn_toxicity.train(docs, x, "doc_id", "text", "toxic", every, F.col("doc_id") % 5 == 0) for x in (labels, inverted)]
    scored = [kn_toxicity.score(docs, ["doc_id"], "text", m).join(labels, "doc_id").groupBy("toxic").agg(F.avg("score").alias("s")) for m in models]
    plain, turned = ({r.toxic: r.s for r in s.collect()} for s in scored)
    assert plain[1] > plain[0] + 0.5 and turned[0] > turned[1] + 0.3
