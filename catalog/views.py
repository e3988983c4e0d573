"""Binary views of the test tables; the same text runs in Spark and DuckDB."""

# 9 features with a unique row id
ORD_SCORE = """SELECT row_id, f0, f1, f2, f3, f4, f5, f6, f7, f8,
    CASE WHEN (row_id * 7) % 20 = 0 THEN 1 - s ELSE s END y
FROM (SELECT *, CAST(2 * f0 + f1 + f3 + f5 >= 3 AS INT) s FROM (
    SELECT o_orderkey row_id, CAST(o_totalprice > 250000 AS INT) f0, CAST(o_orderstatus = 'F' AS INT) f1,
        CAST(o_orderstatus = 'O' AS INT) f2, CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INT) f3,
        CAST(o_orderpriority = '5-LOW' AS INT) f4, CAST(year(o_orderdate) >= 1998 AS INT) f5,
        CAST(month(o_orderdate) <= 6 AS INT) f6, CAST(o_custkey % 2 = 0 AS INT) f7,
        CAST(o_totalprice > 375000 AS INT) f8
    FROM orders) base) scored"""

_LINES = """SELECT l_orderkey, l_linenumber, CAST(l_quantity > 25 AS INT) f0,
        CAST(l_discount > CAST(0.05 AS DOUBLE) AS INT) f1, CAST(l_tax > CAST(0.04 AS DOUBLE) AS INT) f2,
        CAST(l_returnflag = 'R' AS INT) f3, CAST(l_returnflag = 'A' AS INT) f4, CAST(l_linestatus = 'F' AS INT) f5,
        CAST(l_linenumber >= 4 AS INT) f6, CAST(l_extendedprice > 50000 AS INT) f7,
        CAST(year(l_shipdate) >= 1998 AS INT) f8, CAST(l_quantity > 30 AS INT) f9
    FROM lineitem"""

# 10 features, no row id
LI_SCORE = f"""SELECT f0, f1, f2, f3, f4, f5, f6, f7, f8, f9,
    CASE WHEN (l_orderkey * 7 + l_linenumber) % 20 = 0 THEN 1 - s ELSE s END y
FROM (SELECT *, CAST(2 * f0 + f1 + f2 + f6 >= 3 AS INT) s FROM ({_LINES}) base) scored"""

# parity of three features, one redundant feature: misleads greedy splits
LI_PARITY = f"""SELECT f0, f1, f2, f3, f4, f5, f6, f7, f8, f9,
    CASE WHEN (l_orderkey * 7 + l_linenumber) % 20 = 0 THEN 1 - s ELSE s END y
FROM (SELECT * REPLACE (CAST(f0 = f1 AS INT) AS f9), (f0 + f1 + f2) % 2 s FROM ({_LINES}) base) scored"""

LI_PARITY_SPARK = LI_PARITY.replace("* REPLACE (CAST(f0 = f1 AS INT) AS f9)", "* EXCEPT (f9), CAST(f0 = f1 AS INT) f9")

# labels scattered over eight features: greedy, lookahead and exact trees all differ
LI_SCATTERED = f"""SELECT f0, f1, f2, f3, f4, f5, f6, f7, f8,
    CAST(67 * (f0 + 2 * f1 + 4 * f2 + 8 * f3 + 16 * f4 + 32 * f6 + 64 * f7 + 128 * f8) % 101 < 45 AS INT) y
FROM ({_LINES}) base"""

# a natural label: document quality
DOC_LABELS = """SELECT d.doc_id row_id, CAST(d.n_chars > 1000 AS INT) f0, CAST(d.n_chars > 5000 AS INT) f1,
    CAST(d.lang = 'en' AS INT) f2, CAST(l.toxic = 1 AS INT) f3, CAST(d.n_chars > 20000 AS INT) f4,
    CAST(l.quality AS INT) y
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

FEATURES = {"ord_score": 9, "li_score": 10, "li_parity": 10, "li_scattered": 9, "doc_labels": 5}
DUCK = {"ord_score": ORD_SCORE, "li_score": LI_SCORE, "li_parity": LI_PARITY, "li_scattered": LI_SCATTERED, "doc_labels": DOC_LABELS}
SPARK = DUCK | {"li_parity": LI_PARITY_SPARK}
SOURCES = {"ord_score": ["orders"], "li_score": ["lineitem"], "li_parity": ["lineitem"], "li_scattered": ["lineitem"], "doc_labels": ["documents", "labels"]}
BINS = {0: [0, 8], 1: [1, 2], 2: [3, 4], 3: [5], 4: [6], 5: [7]}


def features(view: str) -> list[str]:
    return [f"f{i}" for i in range(FEATURES[view])]


def load(spark, sf_dir: str, view: str):
    """The view over parquet; only the columns it reads are scanned."""
    text, tables = SPARK[view], {}
    for name in SOURCES[view]:
        tables[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return spark.sql(text, **tables)
