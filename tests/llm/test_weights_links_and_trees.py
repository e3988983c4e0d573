"""Resampling, token alignment and the suffix tree against brute force."""

import hashlib
import math
import pickle
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark import SparkContext
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grovelight.llm import feature_weights, suffix_tree_lm, token_alignment
from grovelight.llm.frames import fold
from grovelight.llm.pretokens import byte_letters
from grovelight.llm.queries import op11_alignment, op12_resampling, op13_suffix_tree

PATHS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
TEXTS = [None, "", " ", "  a", "a<|endoftext|> b", "x ▁y", "日本\t\n  é", "</s><s>", "a" * 3000, "12345 67 \r\n", "don't I'll  \n", " x  z", "\x00a", "A a É", "a" * 70 + " b " + "c" * 65]


def lowered(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


# -- resampling -------------------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_draw(docs, target, percent, least):
    def features(text):
        words = WORD.findall(lowered(text))
        return len(words), [zlib.crc32(b" ".join(words[i : i + k])) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    total_s, total_t = s.total() + 10000, t.total() + 10000
    rows = []
    for i, text in docs:
        n, found = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * total_s / ((s[b] + 1) * total_t))) for b in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[: len(fit) * percent // 100])}
    return sorted(([*r, ranks.get(id(r))] for r in rows), key=str)


def test_draw_is_that_of_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(feature_weights, "BLOCK_ROWS", 16)
    monkeypatch.setattr(feature_weights, "DIGIT_BITS", 5)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(10**12 + k, t) for k, t in enumerate(TEXTS)] + [(None, docs[5][1]), (docs[7][0], docs[7][1])]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, weight int")
    got = feature_weights.resample(df, "doc_id", "text", spark.createDataFrame([(t,) for t in target], "text string"), "text", 40, 20)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((list(r) for r in got.collect()), key=str) == brute_draw(docs, target, 40, 20)


def test_draw_of_the_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    expected = sorted(([r[0], *r[2:]] for r in brute_draw(docs, target, 5, 20)), key=str)
    assert sorted((list(r) for r in op12_resampling(spark, sf).collect()), key=str) == expected


def test_draw_from_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert feature_weights.resample(empty, "doc_id", "text", some, "text", 50, 0).count() == 0
    got = feature_weights.resample(some, "doc_id", "text", empty, "text", 100, 0).collect()
    assert sorted((r.doc_id, r.n_features, r["rank"]) for r in got) == [(1, 3, 2), (2, 0, 1)] or sorted(r["rank"] for r in got) == [1, 2]


@pytest.mark.parametrize("low, high", [(-5, 5), (-(1 << 63), (1 << 63) - 1), (0, 0), (1 << 61, (1 << 61) + 9000)])
def test_ranks_over_the_whole_range(spark, low, high):
    values = [low, high, low, (low + high) // 2, None, high - (high - low) // 3, low + (high - low) // 7]
    rows = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v long, k long").repartition(3)
    for descending in (False, True):
        placed = feature_weights.radix_ranks(rows, [("v", descending), ("k", True)], "at").collect()
        got = [r.k for r in sorted(placed, key=lambda r: r.at)]
        assert sorted(r.at for r in placed) == list(range(len(values)))
        sign = -1 if descending else 1
        assert got == sorted(range(len(values)), key=lambda k: (values[k] is None, sign * (values[k] or 0), -k))


# -- alignment --------------------------------------------------------------------------


def brute_alignment(texts):
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = byte_letters()
    names = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab().items() if all(c in letters for c in t)}

    def piece(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()

    rows, links = [], Counter()
    for text in texts:
        row, own = (0, 0, 0, ""), []
        if text:
            ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
            shown = [[names[i] for i in ids[0]], [piece(i) for i in ids[1]]]
            if all(b"".join(s) == (" " + text).encode() for s in shown):
                ends = []
                for s in shown:
                    at, total = [], 0
                    for x in s:
                        total += len(x)
                        at.append(total)
                    ends.append(at)
                spans = [[(e - len(x), e, i) for e, x, i in zip(at, s, side, strict=True)] for at, s, side in zip(ends, shown, ids, strict=True)]
                lists, low = [], 0
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    lists.append([[x for x in side if low <= x[0] and x[1] <= cut] for side in spans] if len(text) < 300 else None)
                    low = cut
                k = 0
                for lo, hi, i in spans[0]:
                    while k and spans[1][k][0] > lo:
                        k -= 1
                    while spans[1][k][1] <= lo:
                        k += 1
                    m = k
                    while m < len(spans[1]) and spans[1][m][0] < hi:
                        own.append((i, spans[1][m][2]))
                        m += 1
                text_of = ";".join("|".join(",".join(str(x[2]) for x in side) for side in group) for group in lists) if len(text) < 300 else None
                row = (len(ids[0]), len(ids[1]), len(lists), text_of)
        links.update(own)
        rows.append((row, own))
    most = defaultdict(int)
    for (_, j), n in links.items():
        most[j] = max(most[j], n)
    return [(*row[:3], len(own), sum(links[x] == most[x[1]] for x in own), sum(links[x] for x in own), row[3]) for row, own in rows]


@pytest.mark.parametrize("most", [1 << 20, 5])
def test_alignment_is_that_of_brute_force(spark, sf, monkeypatch, most):
    monkeypatch.setattr(token_alignment, "COMMON", most)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()] + TEXTS + TEXTS[2:6]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, pairs string")
    got = {r.doc_id: tuple(r)[1:] for r in token_alignment.align_corpus(df, ["doc_id"], "text", *PATHS, text=True).collect()}
    for k, expected in enumerate(brute_alignment(texts)):
        assert got[k][:6] == expected[:6], texts[k]
        assert expected[6] is None or got[k][6] == expected[6]


def test_alignment_of_last_blanks_equal_sums_newer_letters_and_broken_neighbours(spark):
    """A single blank at the end, words whose running sums agree, letters newer than Python's Unicode, bad UTF-8 beside."""
    waves = ["".join(letters[bin(k).count("1") % 2] for k in range(1024)) for letters in ("ab", "ba")]
    texts = ["x ", "a b ", "\n ", "x  ", "\u1c89's a", "\U000105c0'll", *waves, "don't  go 12"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    broken = [spark.sql(f"SELECT {k}L doc_id, cast(unhex('{h}') AS string) text") for k, h in ((100, "61FF20"), (101, "802062"), (102, "E282"))]
    for more in broken:
        df = df.union(more)
    got = {r.doc_id: tuple(r)[1:] for r in token_alignment.align_corpus(df.coalesce(1), ["doc_id"], "text", *PATHS, text=True).collect()}
    for k, expected in enumerate(brute_alignment(texts)):
        assert got[k][:6] == expected[:6], texts[k]
        assert expected[6] is None or got[k][6] == expected[6]
    assert [got[k] for k in (100, 101, 102)] == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_alignment_digest_and_odd_tables(spark, sf):
    rows = {r.doc_id: r for r in op11_alignment(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    listed = token_alignment.align(docs, ["doc_id"], "text", *PATHS).select("doc_id", "groups", "n_links", "n_a", "n_b", "n_groups")
    for r in listed.collect():
        assert rows[r.doc_id].groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
        assert r.n_links == r.n_a + r.n_b - r.n_groups
    assert token_alignment.align_corpus(docs.limit(0), ["doc_id"], "text", *PATHS).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in token_alignment.align_corpus(nulls, ["doc_id"], "text", *PATHS).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
    with pytest.raises(ValueError):
        token_alignment.align_corpus(docs.withColumnRenamed("doc_id", "n_a"), ["n_a"], "text", *PATHS)


# -- suffix tree ------------------------------------------------------------------------


class BruteTree:
    """The same tree from plain dictionaries of words."""

    def __init__(self, texts, symbols):
        lm = suffix_tree_lm
        self.n = Counter(w for t in texts for w in self.words(t))
        kinds = sorted({c for w, c in self.n.items() if w != "</>"}, reverse=True)
        self.common, room = set(), symbols
        for c in kinds:
            some = {w for w, n in self.n.items() if n == c and w != "</>"}
            if len(some) > room:
                break
            self.common |= some
            room -= len(some)
        self.tokens, self.kinds = self.n.total(), len(self.n)
        self.z = self.tokens + 0.1 * (self.kinds + 1)
        rare = [x for x in self.n if x not in self.common and x != "</>"]
        self.rare = (sum(self.n[x] for x in rare) + 0.1 * (len(rare) + 1)) / self.z
        counts = [Counter(), Counter()]
        for t in texts:
            s = ["<>", *map(self.symbol, self.words(t))]
            for k in (1, 2):
                counts[k - 1].update(tuple(s[i : i + k + 1]) for i in range(len(s) - k))
        stored = [{g: n for g, n in c.items() if n >= lm.LEAST} for c in counts]
        self.stored, self.states = stored, {}
        occurs = Counter()
        for g, n in counts[0].items():
            occurs[g[0]] += n
        for k in (1, 2):
            follow = defaultdict(dict)
            for g, n in stored[k - 1].items():
                follow[g[:-1]][g[-1]] = n
            for context, after in follow.items():
                if k == 1:
                    total = occurs[context[0]]
                else:
                    total = stored[0].get(context, 0)
                    if total < lm.LEAST_CONTEXT or context[1:] not in self.states:
                        continue
                below = {w: self.p_symbol(w, context[1:]) for w in after}
                rest = total - sum(after.values())
                gain = sum(n * math.log(n / (total * below[w])) for w, n in after.items())
                if rest:
                    gain += rest * math.log(rest / total / max(1 - sum(below.values()), 1e-12))
                if gain > lm.PRICE * (len(after) + 1):
                    self.states[context] = (total, after, (rest + lm.CUT * len(after)) / total)

    def words(self, text):
        return [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", lowered(text))] + ["</>"]

    def symbol(self, w):
        return w if w in self.common or w == "</>" else "<rare>"

    def p_symbol(self, w, context):
        while context and context not in self.states:
            context = context[1:]
        if not context:
            if w == "<rare>":
                return self.rare
            return (self.n[w] + 0.1) / self.z
        total, after, rest = self.states[context]
        return max(after.get(w, 0) - suffix_tree_lm.CUT, 0) / total + rest * self.p_symbol(w, context[1:])

    def score(self, text):
        words = self.words(text)
        base = sum(math.log10((self.n[w] + 0.1) / self.z) for w in words)
        past, total = ("<>",), 0.0
        rare = self.p_symbol("<rare>", ())
        for w in words:
            s = self.symbol(w)
            p = self.p_symbol(s, past)
            if s == "<rare>":
                p *= (self.n[w] + 0.1) / self.z / rare
            total += math.log10(p)
            past = (*past, s)[-2:]
        return len(words), sum(self.n[w] > 0 for w in words), base, total


@pytest.mark.parametrize("symbols, most", [((1 << 20) - 3, 1 << 20), (60, 20)])
def test_tree_is_that_of_brute_force(spark, sf, monkeypatch, symbols, most):
    monkeypatch.setattr(suffix_tree_lm, "SYMBOLS", symbols)
    monkeypatch.setattr(suffix_tree_lm, "COMMON", most)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None if k == 3 else 10**6 + k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    learnt = [t for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 10 != 0]
    tree = BruteTree(learnt, symbols)
    assert any(len(c) == 1 for c in tree.states) and any(len(c) == 2 for c in tree.states)
    model = suffix_tree_lm.train(docs.where(fold("doc_id", 10) != 0), "text")
    assert Counter(r.length for r in model.states.collect()) == Counter(len(c) for c in tree.states)
    assert (model.vocabulary.tokens, model.vocabulary.words) == (tree.tokens, tree.kinds)
    got = suffix_tree_lm.score(docs.withColumn("_llm_n", F.lit("x")), ["doc_id", "_llm_n"], "text", model).collect()
    found = sorted(((r.doc_id or 0, r.n_tokens, r.n_known), r.base_score, r.score) for r in got)
    wanted = []
    for i, t in rows:
        n, known, base, total = tree.score(t)
        wanted.append(((i or 0, n, known), base, total))
    for a, b in zip(found, sorted(wanted), strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-9) and a[2] == pytest.approx(b[2], rel=1e-9)
    # every state's distribution sums to one, a rare word's part included
    alphabet = [*tree.common, "</>", "<rare>"]
    for context in [(), *list(tree.states)[:20]]:
        assert sum(tree.p_symbol(w, context) for w in alphabet) == pytest.approx(1, abs=1e-9)


def test_tree_predicts_held_out_texts(spark):
    rows = op13_suffix_tree(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > 0.97 * sum(r.base_score for r in rows)
    assert sum(r.score > r.base_score for r in rows) > 0.85 * len(rows)
    assert all(r.score <= 0 and r.n_known <= r.n_tokens for r in rows)


def test_tree_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b a"), (2, None), (2, None)], "doc_id long, text string")
    model = suffix_tree_lm.train(empty, "text")
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in suffix_tree_lm.score(some, ["doc_id"], "text", model).collect()) == [
        (1, 4, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)
    ]
    assert suffix_tree_lm.score(empty, ["doc_id"], "text", suffix_tree_lm.train(some, "text")).count() == 0
    with pytest.raises(ValueError):
        suffix_tree_lm.score(some.withColumnRenamed("doc_id", "score"), ["score"], "text", model)


def test_driver_sends_bitmaps_packed_and_words_once(spark, monkeypatch):
    """the driver held every bitmap as 2^28 bits, and sent words and states twice."""
    sent, broadcast = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(pickle.dumps(value)) or broadcast(self, value))
    docs = spark.createDataFrame([(k, "a b c d " * 5 + "e f") for k in range(9)], "doc_id long, text string")
    suffix_tree_lm.score(docs, ["doc_id"], "text", suffix_tree_lm.train(docs, "text")).collect()
    assert sum(map(len, sent)) < 8 * 2**20 + 2**20  # 2^20 doubles of the states, and little else
    # every place of every key comes back, and no other
    keys = [0, 1, 32767, 32768, 1 << 60, (1 << 61) - 1, 268435398, *range(5, 10**9, 10**7)]
    packed = suffix_tree_lm.bitmap(spark.createDataFrame([(k,) for k in keys], "key long").repartition(3), "key")
    assert sum(map(len, packed.parts)) < 100_000
    bits = pickle.loads(pickle.dumps(packed))
    wanted = sorted({k % p for k in keys for p in (268435399, 268435367)})
    assert len(bits) == 2**25 and np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist() == wanted
    assert suffix_tree_lm.marked(bits, np.array(keys)).all()
    assert not pickle.loads(pickle.dumps(suffix_tree_lm.bitmap(spark.createDataFrame([], "key long"), "key"))).any()
