"""Line dedup, Jaccard join, decontamination, URL filters and nearest neighbours against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovelight.llm import patience_lines, queries, routed_search, suffix_contamination, tile_join, url_trees

SMALL = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- line dedup


def longest_common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_is_a_common_subsequence_and_longest_for_distinct_lines():
    rng = random.Random(4)
    for distinct in (True, False):
        for _ in range(200):
            a = rng.sample(range(12), rng.randint(1, 9)) if distinct else [rng.randrange(4) for _ in range(8)]
            b = rng.sample(range(12), rng.randint(1, 9)) if distinct else [rng.randrange(4) for _ in range(8)]
            common = sorted(set(a) & set(b))
            got = patience_lines.align([[i for i, x in enumerate(a) if x == c] for c in common], [[i for i, x in enumerate(b) if x == c] for c in common])
            assert all(a[i] == b[j] for i, j in got)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
            if distinct:
                assert len(got) == longest_common(a, b)


def passage(k, n=60):
    return " ".join(f"p{k}w{i}" for i in range(n))


def test_line_dedup(spark):
    own = lambda k: f"only here {k} " + " ".join(f"o{k}x{i}" for i in range(55))
    short = "All rights reserved."
    rows = [
        (1, f"{own(1)}\n{passage(1)}\n{short}", "a"),
        (2, f"{short}\n{own(2)}\n\n  {passage(1)}  \n", "a"),
        (3, f"{own(1)}\n{passage(1)}\n{short}", "a"),  # a copy of 1
        (4, f"{own(4)}\n{short}", "a"),
        (5, "\n".join([own(5), *(" ".join(f"s{j}q{i}" for i in range(20)) for j in range(4))]), "a"),
        (6, "\n".join([*(" ".join(f"s{j}q{i}" for i in range(20)) for j in range(4)), own(6)]), "a"),  # a passage of four lines
        (None, None, None),
        (7, "", "a"),
        (8, f"{passage(2)}\n{passage(2)}", "a"),
        (9, "x" * 300_000 + "\n" + passage(2), "a"),
        (4, f"{own(4)}\n{short}", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    out = {(r["doc_id"], r["h"]): r for r in patience_lines.deduplicate(df, "doc_id", "text").collect()}
    assert patience_lines.deduplicate(df, "doc_id", "text").count() == len(rows)
    text = {k[0]: r["text"] for k, r in out.items()}
    assert text[1] == rows[0][1] and text[4] == rows[3][1] and text[5] == rows[4][1] and text[8] == rows[8][1]
    assert text[2] == f"{short}\n{own(2)}\n\n" and text[3] == ""
    assert text[6] == own(6) and text[9] == "x" * 300_000 and text[None] is None and text[7] == ""
    assert patience_lines.deduplicate(df.limit(0), "doc_id", "text").count() == 0


def test_line_dedup_query_leaves_unrepeated_text_alone(spark):
    out = queries.op4_line_dedup(spark, SMALL).toPandas()
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    first = {}
    for d in sorted(texts):
        for line in texts[d].split("\n"):
            first.setdefault(line.strip(), d)
    assert len(out) == len(texts)
    for d, text, n in zip(out.doc_id, out.text, out.n_removed):
        kept = text.split("\n") if text else []
        gone = [x for x in texts[d].split("\n") if x.strip() and x not in kept]
        assert all(first[x.strip()] != d for x in gone) and (n > 0) == (text != texts[d])


def brute_blocks(docs, least):
    """Lines of each document (lists of lines, by rising id) in a block of an earlier one."""
    out = []
    for k, mine in enumerate(docs):
        gone = set()
        for other in docs[:k]:
            for i in range(len(mine)):
                for j in range(len(other)):
                    n = 0
                    while i + n < len(mine) and j + n < len(other) and mine[i + n] == other[j + n]:
                        n += 1
                    if sum(len(x.split()) for x in mine[i : i + n]) >= least:
                        gone |= set(range(i, i + n))
        out.append(gone)
    return out


def removed_lines(spark, docs, least):
    df = spark.createDataFrame([(k, "\n".join(x)) for k, x in enumerate(docs)], "doc_id long, text string")
    found = {r["doc_id"]: r["_llm_runs"] or [] for r in patience_lines.deduplicate(df, "doc_id", "text", least).collect()}
    return [{x for a, b in zip(found[k][::2], found[k][1::2]) for x in range(a, b + 1)} for k in range(len(docs))]


def test_no_line_goes_without_a_block_of_one_earlier_document(spark):
    menu = [f"menu entry {k} of many here" for k in range(12)]  # 72 words
    scattered = [x for k, line in enumerate(menu) for x in (line, f"between {k}")]
    docs = [[menu[k], f"own {k}"] for k in range(12)] + [scattered, ["start here", *menu, "the end"], [*menu[:9], "a tail", *menu[9:]]]
    assert sum(len(x.split()) for x in menu[:9]) >= 50
    got = removed_lines(spark, docs, 50)
    assert got[13] == set() and got[14] == set(range(9)) and got[:13] == [set()] * 13
    rng = random.Random(6)
    docs = []
    for _ in range(70):
        lines = [" ".join(f"t{rng.randrange(2)}" for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(1, 9))]
        if lines not in docs:
            docs.append(lines)
    want = brute_blocks(docs, 5)
    assert removed_lines(spark, docs, 5) == want and sum(map(len, want)) > 20


def test_blocks_of_any_earlier_document_are_found(spark):
    p, q = passage(1), passage(2)
    short = [" ".join(f"b{k}w{i}" for i in range(10)) for k in range(6)]
    docs = [["a", p, q, "b"], ["c", q, "d"], ["e", q, "f", p, "g"]]  # swapped passages
    docs += [["h", *(x for k in (4, 2, 0) for x in (short[k], f"i{k}"))], ["j", *short, "k"], ["l", *short, "m"]]  # lines borrowed from an earlier document
    assert removed_lines(spark, docs, 50) == [set(), {1}, {1, 3}, set(), set(), set(range(1, 7))]


def test_repeated_passages_are_found(spark):
    p, q = passage(1), passage(2)
    docs = [[p, q, p, q], [q, p], ["a", p, "b", p, "c"], [p, "d", p]]
    assert removed_lines(spark, docs, 50) == [set(), {0, 1}, {1, 3}, {0, 2}]


# --- Jaccard join


def brute_components(texts, width=5, percent=80):
    sets = {}
    for k, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: (len(sets[k]), root(k)) for k in keys}


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 6, 40, 120]))] for _ in range(12)]
    texts = []
    for k in range(260):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        if rng.random() < 0.2:
            words += rng.choice(base)
        texts.append((k, " ".join(words).title() if rng.random() < 0.3 else "  ".join(words)))
    texts += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE\ttwo"), (1005, " ".join(f"L{i}" for i in range(30_000)))]
    df = spark.createDataFrame([(k, t, k) for k, t in texts], "doc_id long, text string, n long").repartition(3)
    got = {r["row"]: (r["n_shingles"], r["component_id"]) for r in tile_join.join(df, "doc_id", "text").collect()}
    assert got == brute_components(texts)


def test_join_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(tile_join, "CHUNK", 4)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(70):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        texts.append((k, " ".join(words[: rng.randint(48, 60)])))
    got = {r["row"]: (r["n_shingles"], r["component_id"]) for r in tile_join.join(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == brute_components(texts)


def test_join_odd_inputs(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["row"]), r["n_shingles"], r["component_id"]) for r in tile_join.join(df, "doc_id", "text").collect())
    assert got == [("5", 2, 5), ("5", 2, 5), ("None", 0, None), ("None", 2, 5)]
    assert tile_join.join(df.limit(0), "doc_id", "text").count() == 0


# --- decontamination


def brute_hits(text, items, window=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    words, hit, which = find(text), set(), set()
    for k, t in items:
        w = find(t)
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                which.add(str(k))
    return len(words), len(hit), sorted(which)


@pytest.mark.parametrize("block", [200_000, 12])
def test_decontamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_contamination, "BLOCK_WORDS", block)
    rng = random.Random(6)
    items = [(k, " ".join(rng.choice("abcdé") for _ in range(n)).upper()) for k, n in enumerate([3, 5, 13, 14, 20, 1, 40])] + [(7, None), (8, "  ..."), (0, "é é é é")]
    texts = [" ".join(rng.choice("abcdefé") for _ in range(rng.randrange(60))) for _ in range(60)] + [f"x, {t}! y" for _, t in items if t] + [None, "", "a " * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, items string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = suffix_contamination.scan(docs, ["doc_id"], "items", bench, "item_id", "text").collect()
    assert len(out) == len(texts)
    for r in out:
        if r["doc_id"] != len(texts) - 1:
            assert (r["n_words"], r["n_hit"], r["items"]) == brute_hits(texts[r["doc_id"]], items)
    assert suffix_contamination.scan(docs, ["doc_id"], "items", bench.limit(0), "item_id", "text").where("n_hit > 0").isEmpty()
    assert suffix_contamination.scan(docs.limit(0), ["doc_id"], "items", bench, "item_id", "text").isEmpty()


def test_contaminated_spans_are_removed(spark):
    item = " ".join(f"k{i}" for i in range(20))
    clean = " ".join(f"é{i}" for i in range(500))
    rows = [(1, f"before, {item}. after", "s"), (2, f"{clean} {item}", "s"), (3, item, "s"), (4, clean, None), (5, None, None), (6, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in suffix_contamination.remove(docs, "text", bench, "item_id", "text").collect()}
    assert got[1]["text"] == "before, \n. after" and got[1]["spans"] == "s"
    assert got[2]["text"] == rows[1][1] and 3 not in got and got[4]["text"] == clean and got[5]["text"] is None and got[6]["text"] == ""


# --- URL filters


def url_cases():
    return {
        "https://A.example.ORG/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org/en/12?x=/fr/": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/en/2#a": ("example.org", "/en/2", "org/", "allow"),
        "http://xexample.org/es/": ("xexample.org", "/es/", "org/", "allow"),
        "x://org/": ("org", "/", "org/", "allow"),
        "http://a.com/fr/x": ("a.com", "/fr/x", "com/fr/", "allow"),
        "http://a.com/de/": ("a.com", "/de/", "com/de/", "block"),
        "http://a.org": ("a.org", "", None, None),
        "http://a.com?q=/de/": ("a.com", "", None, None),
        "a.com/de/": ("", "", None, None),
        "": ("", "", None, None),
        "http://": ("", "", None, None),
    }


def test_url_verdicts(spark):
    want = url_cases()
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate([*want, None, "http://b.com/de/" + "9" * 20_000])], "page_id long, url string, depth string")
    got = {r["page_id"]: r for r in url_trees.judge(df, ["page_id", "depth"], "url", queries.URL_RULES).collect()}
    assert len(got) == len(want) + 2
    for k, (host, path, rule, verdict) in enumerate(want.values()):
        r = got[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["block_score"] >= 0.5 else "allow"))
    assert (got[len(want)]["host"], got[len(want)]["rule"]) == ("", None)
    none = url_trees.judge(df.where("page_id = 7"), ["page_id"], "url", queries.URL_RULES).collect()
    assert none[0]["verdict"] == "allow"
    assert url_trees.judge(df.limit(0), ["page_id"], "url", queries.URL_RULES).isEmpty()
    assert {r["depth"] for r in got.values()} == {"x"}


def test_url_columns_of_any_name_are_kept(spark):
    names = ["host", "path", "rule", "entropy", "_llm_url", "url_len", "block_score"]
    df = spark.createDataFrame([(*[f"{c} {k}" for c in names], u) for k, u in enumerate(url_cases())], [*names, "url"])
    out = url_trees.judge(df, names, "url", queries.URL_RULES)
    assert out.columns == [*names, "judged_host", "judged_path", "judged_rule", "verdict", "judged_block_score"]
    got = {r["host"]: r for r in out.collect()}
    for k, (host, path, rule, _) in enumerate(url_cases().values()):
        r = got[f"host {k}"]
        assert [r[c] for c in names] == [f"{c} {k}" for c in names]
        assert (r["judged_host"], r["judged_path"], r["judged_rule"]) == (host, path, rule)
    twice = [*queries.URL_RULES, url_trees.Rule("block", "org", "/")]
    assert {r["verdict"] for r in url_trees.judge(df, names, "url", twice).where("judged_rule = 'org/'").collect()} == {"allow"}


def plain_features(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match("[^/?#]*", rest)[0].lower()
    path = re.match("[^/?#]*([^?#]*)", rest)[1]
    query = re.search(r"\?([^#]*)", url)
    query = query[1] if query else ""
    shares = [url.count(c) / len(url) for c in set(url)]
    return [
        len(url), len(host), len(path), len(re.findall("/[^/]", path)), len(host.split(".")),
        len(re.findall("[0-9]", url)) / max(len(url), 1), -sum(p * math.log2(p) for p in shares),
        query.count("&") + 1 if query else 0, host.count("-"), int("#" in url), int(url.lower().startswith("https")),
    ]


def test_url_features_match_plain_python(spark):
    rng = random.Random(5)
    urls = ["".join(rng.choice(["a", "B", "7", ".", "-", "/", "?", "&", "=", "#", "é", "https://", "://"]) for _ in range(rng.randrange(30))) for _ in range(200)]
    urls += [*url_cases(), None, "HTTPS://a.b.c//d/e?x=1&y=2#z&w", "http://h" + "/x1" * 5000]
    df = spark.createDataFrame([(u,) for u in urls], "_llm_url string")
    got = url_trees.features(url_trees.with_parts(df)).select("_llm_url", *url_trees.FEATURES[:-2]).collect()
    assert len(got) == len(urls)
    for r in got:
        assert [r[c] for c in url_trees.FEATURES[:-2]] == pytest.approx(plain_features(r["_llm_url"]), abs=1e-9)


def test_repeated_urls_are_one_of_the_sample(spark):
    rows = [("http://a.org/one", 0)] * 3000 + [(f"http://b{k}.org/", 0) for k in range(50)] + [("http://c.com/de/", 1)] * 100
    df = spark.createDataFrame(rows, "_llm_url string, _llm_y int")
    got = url_trees.sampled(df, 20, 3).collect()
    assert len({r["_llm_url"] for r in got}) == len(got) == 21
    assert len(url_trees.sampled(df, 1000, 3).collect()) == 52


def test_suffix_shares_leave_the_own_fold_out(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(4), rng.randrange(3), rng.randrange(url_trees.FOLDS), rng.randrange(2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "_llm_slot1 int, _llm_slot2 int, _llm_fold int, _llm_y int")
    every, others = url_trees.suffix_shares(df)

    def share(rows, kind, slot):
        overall = sum(r[3] for r in rows) / len(rows)
        own = [r[3] for r in rows if r[kind] == slot]
        return (sum(own) + url_trees.PRIOR * overall) / (len(own) + url_trees.PRIOR)

    for kind in (0, 1):
        for slot in range(5):
            assert every[kind, slot] == pytest.approx(share(rows, kind, slot))
            for fold in range(url_trees.FOLDS):
                assert others[kind, fold, slot] == pytest.approx(share([r for r in rows if r[2] != fold], kind, slot))


def test_rules_left_out_of_learning(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = url_trees.left_out(pages, "url", queries.URL_RULES).collect()
    judged = url_trees.judge(pages, ["page_id"], "url", queries.URL_RULES).where("rule IS NOT NULL").groupBy("rule", "verdict").count().collect()
    assert sorted((r["rule"], r["verdict"], r["urls"]) for r in got) == sorted(tuple(r) for r in judged)
    assert all(0 <= r["right"] <= r["urls"] for r in got)


def test_trees_learn_and_sql_agrees(spark):
    rng = np.random.default_rng(2)
    x = rng.random((800, len(url_trees.FEATURES))).round(2)
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    start, trees = url_trees.boost(x, y)
    margin = start + sum(t.of(x) for t in trees)
    assert ((margin > 0) == (y > 0)).mean() > 0.97
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], url_trees.FEATURES)
    sql = df.select(F.expr(" + ".join([f"{start!r}D", *(t.sql() for t in trees)])).alias("m")).toPandas().m
    assert np.allclose(sorted(sql), sorted(margin))


# --- nearest neighbours


def test_recall_and_scores(spark):
    out = queries.op9_nearest(spark, SMALL).toPandas()
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    x, ids = np.stack(rows.embedding.to_numpy()).astype(np.float64), rows.vec_id.to_numpy()
    at = {v: k for k, v in enumerate(ids)}
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        own = out[out.query_id == q].sort_values("rank")
        score = x @ x[at[q]]
        order = [v for v in ids[np.lexsort((ids, -score))] if v != q][:20]
        hits, total = hits + len(set(own.vec_id) & set(order)), total + 20
        assert own["rank"].tolist() == list(range(1, 21)) and q not in set(own.vec_id)
        assert np.allclose(own.score, score[[at[v] for v in own.vec_id]], rtol=0, atol=1e-12)
        assert (np.diff(own.score) <= 0).all()
    assert hits / total >= 0.9


def test_nearest_odd_inputs(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, -0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [2.0, 0.0]), (9, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = [tuple(r) for r in routed_search.search(df, "vec_id", "embedding", F.col("vec_id") == 0, 20).orderBy("rank").collect()]
    assert got == [(0, 1, 9, 2.0), (0, 2, 1, 0.5), (0, 3, 2, 0.5)]
    assert routed_search.search(df.limit(0), "vec_id", "embedding", F.col("vec_id") == 0, 20).isEmpty()
    assert routed_search.search(df.where("vec_id = 0"), "vec_id", "embedding", F.col("vec_id") == 0, 20).isEmpty()


def test_partition_is_balanced():
    x = np.random.default_rng(3).normal(size=(400, 8))
    label = routed_search.split_graph(routed_search.neighbour_graph(x, 10), 8, 1)
    assert np.bincount(label, minlength=8).max() <= 53 and len(label) == 400
