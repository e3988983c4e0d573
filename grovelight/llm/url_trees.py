"""URL filtering by rules, and by gradient-boosted trees where no rule fits.

A rule names a host and a path; it fits that host and all its subdomains when the URL's
path begins with the rule's.  The longest fitting rule wins.  URLs that a rule decides
are the labelled ones: trees are boosted on their lexical features and judge the rest.

The features are columns of built-in functions: lengths, depth, share of digits, entropy
of the characters, numbers of parameters, and what share of labelled URLs with the same
suffix (last label of the host; last two) are blocked.  Suffix shares are counted over
all labelled URLs in hashed slots, so their table has a fixed size.  A URL that is learnt
from gets the shares of other hosts than its own: hosts are dealt into folds.  So trees
trust a suffix as much as it tells about hosts that have no rule.  The trees are grown
by numpy on a bounded sample of distinct URLs and applied as one SQL expression.

Working columns begin with ``_llm_``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct labelled URLs of either verdict that the trees are grown on, at most.
PER_CLASS = 20_000
#: Hashed slots of suffix statistics.
SLOTS = 4096
TREES = 30
DEPTH = 3
RATE = 0.3
BINS = 32
#: Folds of hosts for the suffix shares of URLs that are learnt from.
FOLDS = 5
#: Weight of the overall share in a suffix's share.
PRIOR = 20.0

_NAMES = ["url_len", "host_len", "path_len", "depth", "labels", "digit_ratio", "entropy", "params", "dashes", "has_fragment", "is_https", "suffix1", "suffix2"]
FEATURES = [f"_llm_{name}" for name in _NAMES]
RESULTS = ["host", "path", "rule", "verdict", "block_score"]


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substr(_llm_url, instr(_llm_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(rules: list[Rule]) -> Column:
    """The longest rule that fits (equal lengths: the earlier one), or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(enumerate(rules), key=lambda r: (len(r[1].text), -r[0])):
        host, path = F.col("_llm_host"), F.col("_llm_path")
        fits = ((host == rule[1].host) | F.endswith(host, F.lit("." + rule[1].host))) & F.startswith(path, F.lit(rule[1].path))
        found = F.when(fits, F.lit(rule[1].text)).otherwise(found)
    return found


def with_parts(urls: DataFrame) -> DataFrame:
    host, path = parts(F.col("_llm_url"))
    return urls.withColumns({"_llm_host": host, "_llm_path": path})


def features(urls: DataFrame) -> DataFrame:
    """Adds the feature columns, but for suffix shares: those get their slots, and the host its fold."""
    url = F.coalesce(F.col("_llm_url"), F.lit(""))
    host, path = F.col("_llm_host"), F.col("_llm_path")
    n = F.length(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    counts = "map_values(aggregate(split(coalesce(_llm_url, ''), ''), cast(map() as map<string,int>), (m, c) -> map_concat(map_filter(m, (k, v) -> k != c), map(c, coalesce(m[c], 0) + 1))))"
    entropy = f"aggregate({counts}, 0D, (s, k) -> s - k / greatest(length(_llm_url), 1) * log2(k / greatest(length(_llm_url), 1)))"
    labels = F.split(host, r"\.")
    last = lambda k: F.pmod(F.xxhash64(F.lit(k), F.array_join(F.slice(labels, F.greatest(F.size(labels) - (k - 1), F.lit(1)), k), ".")), F.lit(SLOTS)).cast("int")
    values = [
        n.cast("double"),
        F.length(host).cast("double"),
        F.length(path).cast("double"),
        F.regexp_count(path, F.lit("/[^/]")).cast("double"),
        F.size(labels).cast("double"),
        F.regexp_count(url, F.lit("[0-9]")) / F.greatest(n, F.lit(1)),
        F.coalesce(F.expr(entropy), F.lit(0.0)),
        F.when(query == "", 0.0).otherwise(F.regexp_count(query, F.lit("&")) + 1.0),
        F.regexp_count(host, F.lit("-")).cast("double"),
        F.contains(url, F.lit("#")).cast("double"),
        F.startswith(F.lower(url), F.lit("https")).cast("double"),
    ]
    slots = {"_llm_slot1": last(1), "_llm_slot2": last(2), "_llm_fold": F.pmod(F.xxhash64(host), F.lit(FOLDS)).cast("int")}
    return urls.withColumns(dict(zip(FEATURES[:-2], values, strict=True)) | slots)


def _drawn(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Shares of the slots, drawn towards the overall share."""
    overall = y.sum() / n.sum() if n.sum() else 0.5
    return (y + PRIOR * overall) / (n + PRIOR)


def suffix_shares(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Blocked shares by (suffix kind, slot), and by (suffix kind, fold, slot) of all *other* folds.

    At most ``2 * FOLDS * SLOTS`` counts are collected, whatever the table.
    """
    slots = F.explode(F.array(*(F.struct(F.lit(k - 1).alias("kind"), F.col(f"_llm_slot{k}").alias("slot")) for k in (1, 2)))).alias("at")
    rows = labelled.select(slots, "_llm_fold", "_llm_y").groupBy("at.kind", "at.slot", "_llm_fold").agg(F.sum("_llm_y").alias("y"), F.count("*").alias("n")).collect()
    y, n = np.zeros((2, FOLDS, SLOTS)), np.zeros((2, FOLDS, SLOTS))
    for r in rows:
        y[r["kind"], r["_llm_fold"], r["slot"]], n[r["kind"], r["_llm_fold"], r["slot"]] = r["y"], r["n"]
    every = np.stack([_drawn(y[k].sum(axis=0), n[k].sum(axis=0)) for k in (0, 1)])
    others = np.stack([[_drawn(y[k].sum(axis=0) - y[k, f], n[k].sum(axis=0) - n[k, f]) for f in range(FOLDS)] for k in (0, 1)])
    return every, others


@dataclass(frozen=True)
class Node:
    feature: int = -1
    cut: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None
    value: float = 0.0

    def sql(self) -> str:
        if self.low is None:
            return f"{self.value!r}D"
        return f"IF({FEATURES[self.feature]} <= {self.cut!r}D, {self.low.sql()}, {self.high.sql()})"

    def of(self, x: np.ndarray) -> np.ndarray:
        if self.low is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.low.of(x), self.high.of(x))


def _grow(binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int) -> Node:
    leaf = Node(value=float(-RATE * grad.sum() / (hess.sum() + 1.0)))
    if depth == 0 or len(grad) < 20:
        return leaf
    best, found = 1e-6, None
    base = grad.sum() ** 2 / (hess.sum() + 1.0)
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        g = np.cumsum(np.bincount(binned[:, f], weights=grad, minlength=len(edges) + 1))
        h = np.cumsum(np.bincount(binned[:, f], weights=hess, minlength=len(edges) + 1))
        gain = (g**2 / (h + 1.0) + (g[-1] - g) ** 2 / (h[-1] - h + 1.0) - base)[:-1]
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = gain[k], (f, k)
    if found is None:
        return leaf
    f, k = found
    low = binned[:, f] <= k
    if low.all() or not low.any():
        return leaf
    return Node(f, float(cuts[f][k]), _grow(binned[low], cuts, grad[low], hess[low], depth - 1), _grow(binned[~low], cuts, grad[~low], hess[~low], depth - 1))


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list[Node]]:
    """Intercept and trees of a logistic loss; histograms of at most ``BINS`` quantile bins."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    start = math.log(share / (1 - share))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))  if len(x) else np.zeros(0) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] if len(x) else c for f, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1) if len(x) else np.zeros((0, x.shape[1]), int)
    margin, trees = np.full(len(y), start), []
    for _ in range(TREES if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        trees.append(_grow(binned, cuts, p - y, p * (1 - p), DEPTH))
        margin += trees[-1].of(x)
    return start, trees


@dataclass(frozen=True)
class Model:
    """The trees as an SQL expression of the features, and the shares of suffix slots."""

    margin: str
    shares: np.ndarray

    def score(self, urls: DataFrame) -> DataFrame:
        """Adds ``_llm_score``, the probability of being blocked, to URLs with features."""
        look = lambda k: F.get(F.array(*map(F.lit, self.shares[k - 1].tolist())), F.col(f"_llm_slot{k}"))
        told = urls.withColumns({FEATURES[-2]: look(1), FEATURES[-1]: look(2)})
        return told.withColumn("_llm_score", F.expr(f"1 / (1 + exp(-({self.margin})))"))


def sampled(labelled: DataFrame, per_class: int, seed: int) -> DataFrame:
    """(_llm_url, _llm_y): at most ``per_class`` distinct URLs of either label, those of smallest seeded hash."""
    one = labelled.groupBy("_llm_url").agg(F.max("_llm_y").alias("_llm_y"))
    order = F.xxhash64(F.lit(seed), "_llm_url")
    picked = [one.where(F.col("_llm_y") == y).orderBy(order, "_llm_url").limit(per_class) for y in (0, 1)]
    return picked[0].unionByName(picked[1])


def train(labelled: DataFrame, per_class: int = PER_CLASS, seed: int = 17) -> Model:
    """Trees from URLs with features and ``_llm_y`` (1 = block)."""
    every, others = suffix_shares(labelled)
    given = [*FEATURES[:-2], "_llm_slot1", "_llm_slot2", "_llm_fold", "_llm_y"]
    sample = features(with_parts(sampled(labelled, per_class, seed))).select(*given).collect()
    rows = np.array([tuple(map(float, r)) for r in sample]).reshape(-1, len(given))
    if not len(rows):
        return Model("-1.0D", every)
    fold = rows[:, -2].astype(int)
    told = np.stack([others[k, fold, rows[:, k - 4].astype(int)] for k in (0, 1)], axis=1)
    start, trees = boost(np.hstack([rows[:, :-4], told]), rows[:, -1])
    return Model(" + ".join([f"{start!r}D", *(t.sql() for t in trees)]), every)


def ruled(pages: DataFrame, id_cols: list[str], url_col: str, rules: list[Rule]) -> DataFrame:
    """(_llm_id<i>, _llm_url) with host, path, rule, what the rule says, label and features."""
    ids = [F.col(c).alias(f"_llm_id{i}") for i, c in enumerate(id_cols)]
    urls = with_parts(pages.select(*ids, F.col(url_col).cast("string").alias("_llm_url"))).withColumn("_llm_rule", rule_of(rules))
    verdicts = {r.text: r.verdict for r in reversed(rules)}  # of equal rules the earlier counts
    said = F.create_map(*(F.lit(x) for pair in verdicts.items() for x in pair))[F.col("_llm_rule")] if rules else F.lit(None).cast("string")
    urls = urls.withColumn("_llm_said", said)
    return features(urls.withColumn("_llm_y", F.when(F.col("_llm_said").isNotNull(), (F.col("_llm_said") == "block").cast("int"))))


def judge(pages: DataFrame, id_cols: list[str], url_col: str, rules: list[Rule], seed: int = 17, per_class: int = PER_CLASS) -> DataFrame:
    """(id columns, host, path, rule, verdict, block_score) of every row.

    Null URLs, and those without ``://``, have an empty host and path, fit no rule and are
    judged by the trees.  Repeated rows are judged each, alike, and learnt from once.  Without
    labelled URLs of both verdicts the trees say what the labelled ones say, and allow when
    there are none.  Columns that are not named as ids are not read; an id column named like a
    result keeps name and values, and the result is called ``judged_<name>``.
    """
    urls = ruled(pages, id_cols, url_col, rules)
    model = train(urls.where(F.col("_llm_y").isNotNull()), per_class, seed)
    verdict = F.coalesce(F.col("_llm_said"), F.when(F.col("_llm_score") >= 0.5, "block").otherwise("allow"))
    scored = model.score(urls).withColumn("_llm_verdict", verdict)
    values = ["_llm_host", "_llm_path", "_llm_rule", "_llm_verdict", "_llm_score"]
    results = [F.col(v).alias(f"judged_{r}" if r in id_cols else r) for v, r in zip(values, RESULTS, strict=True)]
    return scored.select(*(F.col(f"_llm_id{i}").alias(c) for i, c in enumerate(id_cols)), *results)


def left_out(pages: DataFrame, url_col: str, rules: list[Rule], seed: int = 17, per_class: int = PER_CLASS) -> DataFrame:
    """(rule, verdict, urls, right): how many URLs of each rule, repeated ones counted each, trees
    get right that have learnt from the other rules' URLs alone.  Rules that decide no URL have no row."""
    urls = ruled(pages, [], url_col, rules)
    labelled = urls.where(F.col("_llm_y").isNotNull())
    if not rules:
        raise ValueError("no rules")
    found = []
    for text in dict.fromkeys(r.text for r in rules):
        own = F.col("_llm_rule") == text
        scored = train(labelled.where(~own), per_class, seed).score(labelled.where(own))
        right = ((F.col("_llm_score") >= 0.5).cast("int") == F.col("_llm_y")).cast("long")
        found.append(scored.groupBy(F.col("_llm_rule").alias("rule"), F.col("_llm_said").alias("verdict")).agg(F.count("*").alias("urls"), F.sum(right).alias("right")))
    return reduce(DataFrame.unionByName, found)
