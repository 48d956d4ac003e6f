"""Queries over the driver's tables, one for each family of operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import hashing, metrics
from assayer.operators import channels, claims, costs, fixtures, grid, logs, methods, resample, resolution, rules
from assayer.plans import sql
from assayer.sources.tables import content_digest, join_parts, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes))


# Orders as a binary task: is the priority urgent or high?

ARMS = {"seen": fixtures.Arm(before={"o_orderdate": "1998-01-01"}), "unseen": fixtures.Arm(after={"o_orderdate": "1999-01-01"})}
URGENT = ("1-URGENT", "2-HIGH")


def spec(**changes) -> fixtures.Spec:
    own = dict(
        task="orders", id="o_orderkey", label=F.col("o_orderpriority").isin(*URGENT).cast("int"), keys=sql.KEYS, test=(0.2, "test-v1"),
        validation=0.25, cluster="o_custkey", cell="o_orderstatus", arms=ARMS,
    )
    return fixtures.Spec(**(own | changes))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Assignments of all orders with three deterministic scores."""
    orders = read(spark, d, "orders")
    u = lambda key: hashing.unit_hash(key, F.col("id"))
    ties = F.least(F.lit(1.0), F.floor(F.col("o_totalprice") / 10000) / 50.0)
    out = fixtures.assignments(orders.withColumn("ties", ties), spec(), ["ties"])
    return out.withColumn("score_a", 0.35 * F.col("label") + 0.65 * u("a")).withColumn("score_b", 0.3 * F.col("label") + 0.7 * u("b"))


def tested(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).where(F.col("split__split-0") == "test")


# Splits

WIDE = ", ".join(f'"split__{k}"' for k in sql.KEYS)


@query(f"WITH {sql.ORD} SELECT id, cluster, cell, label, {WIDE}, arm FROM ord")
def split_assignment(spark, d):
    return fixtures.assignments(read(spark, d, "orders"), spec())


LONG = f"WITH {sql.ORD}, l AS (UNPIVOT (SELECT id, cluster, cell, label, {', '.join(f'\"split__{k}\" AS \"{k}\"' for k in sql.KEYS)} FROM ord) ON {', '.join(f'\"{k}\"' for k in sql.KEYS)} INTO NAME split_key VALUE split)"


@query(f"""{LONG} SELECT cell, split_key, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM l GROUP BY ALL""")
def split_counts_by_cell(spark, d):
    return fixtures.split_counts(split_assignment(spark, d), sql.KEYS)


@query(f"{LONG} SELECT id, split_key, split FROM l")
def split_long_unpivot(spark, d):
    return fixtures.long_splits(split_assignment(spark, d), sql.KEYS).select("id", "split_key", "split")


@query(f"{LONG} SELECT tested, count(*) AS ids FROM (SELECT id, count(*) FILTER (split = 'test') AS tested FROM l GROUP BY id) GROUP BY tested")
def test_fixed_across_keys(spark, d):
    per = split_long_unpivot(spark, d).groupBy("id").agg(F.count_if(F.col("split") == "test").alias("tested"))
    return per.groupBy("tested").agg(F.count("*").alias("ids"))


@query(f"SELECT {sql.ID} AS id, {sql.split('split-0', tested=chr(39).join(['o_orderstatus = ', 'O', '']))} AS split FROM orders")
def split_from_column(spark, d):
    return fixtures.assignments(read(spark, d, "orders"), spec(keys=["split-0"], test=("o_orderstatus", "O"))).select("id", F.col("split__split-0").alias("split"))


@query(f'WITH {sql.ORD} SELECT splits, count(*) AS clusters FROM (SELECT cluster, count(DISTINCT "split__split-0") AS splits FROM ord GROUP BY cluster) GROUP BY splits')
def cluster_cohesion(spark, d):
    return fixtures.cluster_splits(split_assignment(spark, d), "split-0").groupBy("splits").agg(F.count("*").alias("clusters"))


@query(f"SELECT o_custkey, {sql.u('key', 'o_custkey::VARCHAR')} AS unit FROM orders GROUP BY o_custkey")
def unit_hash(spark, d):
    return read(spark, d, "orders").select("o_custkey", hashing.unit_hash("key", F.col("o_custkey")).alias("unit")).distinct()


# Labels, exclusions, cells, arms, guards

CODES = {"1-URGENT": 1, "2-HIGH": 1, "3-MEDIUM": 0}


@query("SELECT event_id, CASE WHEN value > 50 THEN 1 ELSE 0 END AS label FROM events")
def label_column(spark, d):
    return read(spark, d, "events").select("event_id", (F.col("value") > 50).cast("int").alias("label"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 0 END AS label FROM orders")
def label_map(spark, d):
    return read(spark, d, "orders").select("o_orderkey", fixtures.label_map("o_orderpriority", CODES).alias("label"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 AND o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders")
def label_function(spark, d):
    orders = read(spark, d, "orders")
    rule = lambda t: ((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "F")).cast("int")
    return orders.select("o_orderkey", fixtures.checked_label(orders, "o_orderkey", rule, ["o_totalprice", "o_orderstatus"]).alias("label"))


def gappy(**changes) -> fixtures.Spec:
    return spec(label=fixtures.label_map("o_orderpriority", CODES), cell="gappy_status", **changes)


def gaps(spark, d):
    return read(spark, d, "orders").withColumn("gappy_status", F.nullif(F.col("o_orderstatus"), F.lit("P")))


LEFT_OUT = "o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"


@query(f"""SELECT count(*) AS rows_in, count(*) FILTER (NOT {LEFT_OUT} AND o_orderstatus <> 'P') AS rows_kept, count(*) FILTER ({LEFT_OUT}) AS no_label,
  count(*) FILTER (NOT {LEFT_OUT} AND o_orderstatus = 'P') AS no_cell FROM orders""")
def excluded_rows(spark, d):
    found = fixtures.exclusions(gaps(spark, d), gappy())
    return found.select("rows_in", "rows_kept", F.col("excluded")[fixtures.NO_LABEL].alias("no_label"), F.col("excluded")["no value for gappy_status"].alias("no_cell"))


@query(f'WITH {sql.ORD} SELECT "split__split-0" AS split, label, count(*) AS rows FROM ord GROUP BY ALL')
def class_counts(spark, d):
    return fixtures.class_counts(split_assignment(spark, d), "split-0")


@query(f"SELECT coalesce({sql.ARM}, '(none)') AS arm, count(*) AS rows FROM orders GROUP BY ALL")
def arm_counts(spark, d):
    return fixtures.arm_counts(split_assignment(spark, d))


EVENT_ARM = "CASE WHEN day IS NULL THEN NULL WHEN day < DATE '2024-01-10' THEN 'early' WHEN day >= DATE '2024-01-20' THEN 'late' END"


@query(f"SELECT event_id, {EVENT_ARM} AS arm FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN ts::DATE END AS day FROM events)")
def arm_assignment(spark, d):
    events = read(spark, d, "events").withColumn("day", F.when(F.col("event_id") % 7 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd")))
    arms = {"early": fixtures.Arm(before={"day": "2024-01-10"}), "late": fixtures.Arm(after={"day": "2024-01-20"})}
    return events.select("event_id", fixtures.arm_column(arms).alias("arm"))


@query("SELECT 'old' AS first, 'new' AS second, count(*) AS rows FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' AND o_orderdate >= TIMESTAMP '1998-01-01'")
def arm_overlap_guard(spark, d):
    return fixtures.arm_overlaps(read(spark, d, "orders"), {"old": fixtures.Arm(before={"o_orderdate": "1999-01-01"}), "new": fixtures.Arm(after={"o_orderdate": "1998-01-01"})})


@query(f"""SELECT cell, split, classes FROM (SELECT 'orders/' || o_orderstatus AS cell, s.split, count(DISTINCT CASE WHEN {sql.split("split-0")} = s.split THEN 0 END) AS classes
  FROM orders, (VALUES ('train'), ('test')) s(split) WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY ALL) WHERE classes < 2""")
def class_presence_guard(spark, d):
    rows = split_assignment(spark, d).where("label = 0")
    return fixtures.one_class_splits(rows, "split-0")


@query("SELECT l_orderkey || '-' || l_linenumber AS id, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_id_guard(spark, d):
    return fixtures.duplicate_ids(read(spark, d, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber")), "id")


@query("SELECT count(*) FILTER (o_orderstatus = 'P') AS null_ids FROM orders")
def null_id_guard(spark, d):
    return gaps(spark, d).agg(F.count_if(F.col("gappy_status").isNull()).alias("null_ids"))


@query("SELECT DISTINCT o_orderstatus AS cell FROM orders WHERE o_orderstatus <> 'P'")
def distinct_cells(spark, d):
    return fixtures.distinct_cells(gaps(spark, d), "gappy_status")


@query(f'WITH {sql.ORD} SELECT cell, count(*) FILTER ("split__split-0" = \'train\') AS train, count(*) FILTER ("split__split-0" = \'validation\') AS validation, count(*) FILTER ("split__split-0" = \'test\') AS test FROM ord GROUP BY cell')
def cell_table(spark, d):
    return fixtures.split_counts(split_assignment(spark, d), sql.KEYS[:1]).drop("split_key")


@query(f"WITH {sql.ORD} SELECT id, cell, label, o_totalprice FROM ord JOIN orders ON id = o_orderkey::VARCHAR WHERE \"split__split-0\" = 'test'")
def fixture_rows_join(spark, d):
    rows = split_assignment(spark, d).where(F.col("split__split-0") == "test")
    return fixtures.with_source(rows, read(spark, d, "orders"), "o_orderkey").select("id", "cell", "label", "o_totalprice")


@query("SELECT count(*) AS rows, sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR AS low, sum(('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR AS mixed FROM (SELECT sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}') AS h FROM nation)")
def fixture_content_digest(spark, d):
    return content_digest(read(spark, d, "nation"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def dimension_join(spark, d):
    return read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def parts_join(spark, d):
    orders = read(spark, d, "orders")
    return join_parts(orders.select("o_orderkey", "o_totalprice"), orders.select("o_orderkey", "o_orderpriority"), "o_orderkey")


@query("SELECT o_orderstatus, count(*) FILTER (s = 'train') AS train, count(*) FILTER (s = 'validation') AS validation, count(*) FILTER (s = 'test') AS test FROM (SELECT o_orderstatus, " + sql.split("split-0") + " AS s FROM orders) GROUP BY 1")
def split_crosstab(spark, d):
    orders = read(spark, d, "orders").withColumn("s", fixtures.split_column(F.col("o_custkey").cast("string"), "split-0", (0.2, "test-v1"), 0.25))
    return orders.groupBy("o_orderstatus").pivot("s", list(fixtures.SPLITS)).count().na.fill(0)


# Metrics

BINARY = {
    "pr_auc": f"SELECT cell, round(pr_auc, 6) AS value FROM ({sql.ranked('t', 'cell', 'ties')})",
    "roc_auc": f"SELECT cell, round(roc_auc, 6) AS value FROM ({sql.ranked('t', 'cell', 'ties')})",
    "accuracy": "SELECT cell, round(avg(CASE WHEN (ties >= 0.5)::INT = label THEN 1.0 ELSE 0 END), 6) AS value FROM t GROUP BY cell",
    "balanced_accuracy": "SELECT cell, round(avg(r), 6) AS value FROM (SELECT cell, label, avg(CASE WHEN (ties >= 0.5)::INT = label THEN 1.0 ELSE 0 END) AS r FROM t GROUP BY ALL) GROUP BY cell",
    "f1": "SELECT cell, round(coalesce(2 * tp / nullif(2.0 * tp + fp + fn, 0), 0), 6) AS value FROM (SELECT cell, count(*) FILTER (label = 1 AND ties >= 0.5) AS tp, count(*) FILTER (label = 0 AND ties >= 0.5) AS fp, count(*) FILTER (label = 1 AND ties < 0.5) AS fn FROM t GROUP BY cell)",
    "macro_f1": "SELECT cell, round(avg(coalesce(2 * tp / nullif(2.0 * tp + fp + fn, 0), 0)), 6) AS value FROM (SELECT cell, k, count(*) FILTER (label = k AND (ties >= 0.5)::INT = k) AS tp, count(*) FILTER (label <> k AND (ties >= 0.5)::INT = k) AS fp, count(*) FILTER (label = k AND (ties >= 0.5)::INT <> k) AS fn FROM t, range(2) r(k) GROUP BY ALL) WHERE tp + fp + fn > 0 GROUP BY cell",
    "brier": "SELECT cell, round(avg((ties - label) ** 2), 6) AS value FROM t GROUP BY cell",
    "log_loss": "SELECT cell, round(avg(-ln(greatest(least(CASE WHEN label = 1 THEN ties ELSE 1 - ties END, 1 - 2.220446049250313e-16), 2.220446049250313e-16))), 6) AS value FROM t GROUP BY cell",
    "tie_share": "SELECT cell, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS value FROM (SELECT cell, ties, count(*) AS n FROM t GROUP BY ALL) GROUP BY cell",
}


def _by_cell(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(metrics.metric(name)(resample.weighted_once(tested(spark, d).withColumnRenamed("ties", "score")), ["cell"]))

    run.__name__ = f"metric_{name}_by_cell"
    return run


for _name, _sql in BINARY.items():
    query(f"WITH {sql.ORD}, t AS ({sql.TEST}) {_sql}")(_by_cell(_name))

#: Embeddings as a ten-class task: the first ten numbers, made positive and normed, are the probabilities.
MANY = """e AS (SELECT vec_id::VARCHAR AS id, label, list_transform(range(1, 11), lambda i: exp(embedding[i]::DOUBLE) + CASE WHEN i - 1 = label THEN 1 ELSE 0 END) AS x FROM embeddings),
t AS (SELECT id, label, list_transform(x, lambda v: v / list_sum(x)) AS probs FROM e), k AS (SELECT id, t.label AS y, c - 1 AS class, probs[c] AS score, CASE WHEN t.label = c - 1 THEN 1 ELSE 0 END AS label FROM t, range(1, 11) r(c))"""


def many(spark: SparkSession, d: str) -> DataFrame:
    first = F.transform(F.slice("embedding", 1, 10), lambda v, i: F.exp(v.cast("double")) + F.when(i == F.col("label"), 1.0).otherwise(0.0))
    rows = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "label", first.alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return rows.withColumn("total", total).select("id", "label", F.transform("x", lambda v: v / F.col("total")).alias("probs"), F.lit(1).alias("w"), F.lit("all").alias("cell"))


ARGMAX = "list_position(probs, list_max(probs)) - 1"
MULTI = {
    "pr_auc": f"SELECT 'all' AS cell, round(avg(pr_auc), 6) AS value FROM ({sql.ranked('k', 'class')})",
    "roc_auc": f"SELECT 'all' AS cell, round(avg(roc_auc), 6) AS value FROM ({sql.ranked('k', 'class')})",
    "accuracy": f"SELECT 'all' AS cell, round(avg(CASE WHEN {ARGMAX} = label THEN 1.0 ELSE 0 END), 6) AS value FROM t",
    "macro_f1": f"SELECT 'all' AS cell, round(avg(coalesce(2 * tp / nullif(2.0 * tp + fp + fn, 0), 0)), 6) AS value FROM (SELECT c, count(*) FILTER (label = c AND p = c) AS tp, count(*) FILTER (label <> c AND p = c) AS fp, count(*) FILTER (label = c AND p <> c) AS fn FROM (SELECT label, {ARGMAX} AS p FROM t), range(10) r(c) GROUP BY c) WHERE tp + fp + fn > 0",
    "brier": "SELECT 'all' AS cell, round(sum((score - label) ** 2) / count(DISTINCT id), 6) AS value FROM k",
    "log_loss": "SELECT 'all' AS cell, round(avg(-ln(probs[label + 1])), 6) AS value FROM t",
    "tie_share": "SELECT 'all' AS cell, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS value FROM (SELECT list_max(probs) AS s, count(*) AS n FROM t GROUP BY ALL)",
}


def _multiclass(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(metrics.metric(name, many=True)(many(spark, d), ["cell"]))

    run.__name__ = f"metric_multiclass_{name}"
    return run


for _name, _sql in MULTI.items():
    query(f"WITH {MANY} {_sql}")(_multiclass(_name))


@query(f"""WITH {sql.ORD}, t AS (SELECT *, 'bucket-' || (cluster::BIGINT % 40) AS bucket FROM ({sql.TEST})), m AS ({sql.ranked("t", "bucket", "ties")}), s AS (SELECT bucket, sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) AS share FROM (SELECT bucket, ties, count(*) AS n FROM t GROUP BY ALL) GROUP BY bucket)
SELECT bucket, round(CASE WHEN classes > 1 THEN roc_auc END, 6) AS score, round(CASE WHEN classes > 1 THEN share END, 6) AS tie_share FROM (SELECT bucket, count(DISTINCT label) AS classes FROM t GROUP BY bucket) JOIN m USING (bucket) JOIN s USING (bucket)""")
def score_guard(spark, d):
    rows = tested(spark, d).withColumn("bucket", F.concat(F.lit("bucket-"), (F.col("cluster").cast("long") % 40).cast("string"))).withColumnRenamed("ties", "score")
    return rounded(metrics.guarded(resample.weighted_once(rows), ["bucket"], "roc_auc"))


# Bootstrap, noise, rules

DRAWS = 1000
TESTED = f"{sql.ORD}, t AS ({sql.TEST})"


@query(f"""WITH {TESTED}, {sql.weights("t", "cell", DRAWS, "'0'")}, x AS (SELECT t.cell, draw, label, ties AS score, w FROM t JOIN w USING (cell, cluster)),
v AS (SELECT cell, draw, roc_auc AS value FROM ({sql.ranked("x", "cell, draw", w="w")})), p AS (SELECT cell, roc_auc AS point FROM ({sql.ranked("t", "cell", "ties")}))
{sql.interval("v", "p", "cell", DRAWS)}""")
def bootstrap_interval(spark, d):
    return rounded(resample.bootstrap_metric(tested(spark, d).withColumnRenamed("ties", "score"), ["cell"], "roc_auc", DRAWS))


def _pair_sql(rows: str, by: str, more: str = "") -> str:
    """CTEs x (both sides with weights), v (by, draw, value) and p (by, point) of a paired AUC difference."""
    sides = f"SELECT *, 'a' AS side, score_a AS score FROM {rows} UNION ALL SELECT *, 'b', score_b FROM {rows}"
    gap = "max(roc_auc) FILTER (side = 'a') - max(roc_auc) FILTER (side = 'b')"
    return f"""b AS ({sides}), x AS (SELECT {", ".join("b." + c.strip() for c in by.split(","))}, side, draw, label, score, w FROM b JOIN w USING ({by}, cluster)),
    v AS (SELECT {by}, draw, {gap} AS value FROM ({sql.ranked("x", f"{by}, draw, side", w="w")}) GROUP BY ALL),
    p AS (SELECT {by}, {gap} AS point FROM ({sql.ranked("b", f"{by}, side")}) GROUP BY ALL)"""


PAIRED = f"""WITH {TESTED}, {sql.weights("t", "cell", DRAWS, "'0'")}, {_pair_sql("t", "cell")}"""


@query(f"{PAIRED} {sql.interval('v', 'p', 'cell', DRAWS)}")
def paired_difference(spark, d):
    return rounded(resample.paired_difference(tested(spark, d), ["cell"], "roc_auc", "score_a", "score_b", DRAWS))


DID_SEED = "CASE arm WHEN 'seen' THEN '0/0' ELSE '0/1' END"
DID = f"""WITH {sql.ORD}, t AS (SELECT * FROM ({sql.TEST}) WHERE arm IS NOT NULL), {sql.weights("t", "arm", DRAWS, DID_SEED)}, {_pair_sql("t", "arm")},
dv AS (SELECT 1 AS one, draw, max(value) FILTER (arm = 'seen') - max(value) FILTER (arm = 'unseen') AS value FROM v GROUP BY draw),
dp AS (SELECT 1 AS one, max(point) FILTER (arm = 'seen') - max(point) FILTER (arm = 'unseen') AS point FROM p)
SELECT * EXCLUDE (one) FROM ({sql.interval("dv", "dp", "one", DRAWS)})"""


@query(DID)
def diff_in_diff(spark, d):
    return rounded(resample.difference_in_differences(tested(spark, d), "arm", "seen", "unseen", "roc_auc", "score_a", "score_b", DRAWS))


@query(f"SELECT *, CASE WHEN excludes_zero THEN 'effect' ELSE 'inconclusive' END AS outcome FROM ({DID})")
def difference_of_drops(spark, d):
    return rounded(rules.difference_of_drops(tested(spark, d), "roc_auc", "seen", "unseen", draws=DRAWS))


#: A grid of runs: two methods, two split keys, three seeds; each run's score of a row is its label and a hash of the run.
GRID_METHODS, GRID_KEYS, GRID_SEEDS = ("steady", "shaky"), ("split-0", "split-1"), (0, 1, 2)
RUN_SCORE = "0.3 * label + 0.7 * " + sql.u("run", "method || '/' || split_key || '/' || seed || '/' || id")
RUNS = f"""{sql.ORD}, g AS (SELECT * FROM (VALUES ('steady'), ('shaky')) m(method), (VALUES ('split-0'), ('split-1')) k(split_key), (VALUES (0), (1), (2)) s(seed)),
runs AS (SELECT *, {RUN_SCORE} AS score FROM (SELECT id, cluster, cell, label, method, split_key, seed, CASE split_key WHEN 'split-0' THEN "split__split-0" ELSE "split__split-1" END AS split FROM ord, g)),
scores AS ({sql.ranked("(SELECT * FROM runs WHERE split = 'validation')", "cell, method, split_key, seed")})"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    rows = split_assignment(spark, d).withColumn("split_key", F.explode(F.array(*map(F.lit, GRID_KEYS))))
    rows = rows.withColumn("split", F.when(F.col("split_key") == "split-0", F.col("split__split-0")).otherwise(F.col("split__split-1")))
    rows = rows.withColumn("method", F.explode(F.array(*map(F.lit, GRID_METHODS)))).withColumn("seed", F.explode(F.array(*map(F.lit, GRID_SEEDS))))
    name = F.concat_ws("/", "method", "split_key", F.col("seed").cast("string"), "id")
    return rows.select("id", "cluster", "cell", "label", "method", "split_key", "seed", "split", (0.3 * F.col("label") + 0.7 * hashing.unit_hash("run", name)).alias("score"))


def run_scores(spark: SparkSession, d: str) -> DataFrame:
    by = ["cell", "method", "split_key", "seed"]
    return resample.roc_auc(runs(spark, d).where("split = 'validation'"), by).withColumnRenamed("value", "score")


SPLIT_TERM = "SELECT cell, method, avg(s) AS split_term FROM (SELECT cell, method, seed, 1.96 * stddev_samp(roc_auc) AS s FROM scores GROUP BY ALL) GROUP BY ALL"
FIT_TERM = "SELECT cell, method, avg(s) AS fit_term FROM (SELECT cell, method, split_key, 1.96 * stddev_samp(roc_auc) AS s FROM scores GROUP BY ALL) GROUP BY ALL"


@query(f"WITH {RUNS} SELECT cell, method, round(split_term, 6) AS split_term FROM ({SPLIT_TERM})")
def noise_split(spark, d):
    return rounded(resolution.split_terms(run_scores(spark, d)))


@query(f"WITH {RUNS} SELECT cell, method, round(fit_term, 6) AS fit_term FROM ({FIT_TERM})")
def noise_fit(spark, d):
    return rounded(resolution.fit_terms(run_scores(spark, d)))


RUN = "cell, method, split_key, seed"
TEST_DRAWS = 200
TEST_CTES = f"""te AS (SELECT * FROM runs WHERE split = 'test'), {sql.weights("te", RUN, TEST_DRAWS, "'0'")},
x AS (SELECT te.cell, te.method, te.split_key, te.seed, draw, label, score, w FROM te JOIN w USING ({RUN}, cluster)),
hw AS (SELECT {RUN}, (quantile_cont(roc_auc, 0.975) - quantile_cont(roc_auc, 0.025)) / 2 AS h FROM ({sql.ranked("x", f"{RUN}, draw", w="w")}) GROUP BY ALL)"""
TEST_TERM = "SELECT cell, method, avg(h) AS test_term FROM hw GROUP BY ALL"


@query(f"WITH {RUNS}, {TEST_CTES} SELECT cell, method, round(test_term, 6) AS test_term FROM ({TEST_TERM})")
def noise_test(spark, d):
    return rounded(resolution.test_terms(runs(spark, d).where("split = 'test'"), "roc_auc", TEST_DRAWS))


FLOORS = f"""WITH {RUNS}, {TEST_CTES}, m AS (SELECT cell, median(split_term) AS split_term, median(fit_term) AS fit_term, median(test_term) AS test_term FROM ({SPLIT_TERM}) JOIN ({FIT_TERM}) USING (cell, method) JOIN ({TEST_TERM}) USING (cell, method) GROUP BY cell)
SELECT cell, round(split_term, 6) AS split_term, round(fit_term, 6) AS fit_term, round(test_term, 6) AS test_term, round(greatest(split_term, fit_term, test_term), 6) AS floor,
CASE greatest(split_term, fit_term, test_term) WHEN split_term THEN 'split' WHEN fit_term THEN 'fit' ELSE 'test' END AS source, greatest(split_term, fit_term, test_term) > 0.05 AS underpowered FROM m"""


@query(FLOORS)
def resolution_floor(spark, d):
    return rounded(resolution.resolve(run_scores(spark, d), runs(spark, d).where("split = 'test'"), "roc_auc", TEST_DRAWS))


@query(f"WITH {TESTED} SELECT cell, count(*) AS n_test, count(DISTINCT cluster) AS n_clusters FROM t GROUP BY cell")
def resolution_sizes(spark, d):
    return resolution.test_sizes(tested(spark, d))


FLOOR = 0.02
OUTCOME = f"CASE WHEN (lo > 0 OR hi < 0) AND abs(point) > {FLOOR} THEN 'effect' WHEN lo > -{FLOOR} AND hi < {FLOOR} THEN 'no_effect' ELSE 'inconclusive' END"


def _floors(spark: SparkSession) -> DataFrame:
    return grid.cells_frame(spark, [("orders", f"orders/{s}") for s in "FOP"]).select("cell", F.lit(FLOOR).alias("floor"))


@query(f"""{PAIRED}, i AS ({sql.interval("v", "p", "cell", DRAWS)}), o AS (SELECT *, {OUTCOME} AS outcome FROM i)
SELECT cell, point, lo, hi, {FLOOR}::DOUBLE AS floor, outcome, CASE WHEN outcome = 'effect' THEN CASE WHEN point > 0 THEN 'score_a' ELSE 'score_b' END END AS better FROM o""")
def difference_clears_floor(spark, d):
    return rounded(rules.difference_clears_floor(tested(spark, d), _floors(spark), "roc_auc", draws=DRAWS))


@query(f"""{PAIRED}, i AS ({sql.interval("v", "p", "cell", DRAWS)}), c AS (SELECT count(*) AS cells, count(*) FILTER (lo > 0 AND point > {FLOOR}) AS clears, count(*) FILTER (NOT (lo > 0 AND point > {FLOOR}) AND NOT hi < {FLOOR}) AS unresolved FROM i)
SELECT *, CASE WHEN clears >= 2 THEN 'effect' WHEN clears + unresolved >= 2 THEN 'inconclusive' ELSE 'no_effect' END AS outcome FROM c""")
def k_of_n_cells(spark, d):
    return rules.k_of_n_cells(difference_clears_floor(spark, d), 2)


@query(f"""WITH {RUNS}, m AS (SELECT cell, method, avg(roc_auc) AS value FROM scores GROUP BY ALL) SELECT cell, method, round(value, 6) AS value FROM m QUALIFY row_number() OVER (PARTITION BY cell ORDER BY value DESC, method) = 1""")
def select_on_validation(spark, d):
    return rounded(rules.best(rules.mean_validation(run_scores(spark, d), "roc_auc")))


@query(f"""WITH {RUNS}, m AS (SELECT cell, method, roc_auc AS value FROM ({sql.ranked("(SELECT * FROM runs WHERE split = 'test' AND split_key = 'split-0' AND seed = 0)", "cell, method")})) SELECT cell, method, round(value, 6) AS value FROM m QUALIFY row_number() OVER (PARTITION BY cell ORDER BY value DESC, method) = 1""")
def oracle_select(spark, d):
    rows = resample.weighted_once(runs(spark, d).where("split = 'test' and split_key = 'split-0' and seed = 0"))
    return rounded(rules.best(metrics.metric("roc_auc")(rows, ["cell", "method"])))


@query(f"WITH {TESTED} SELECT count(*) AS mismatched FROM t WHERE cluster::BIGINT % 50 = 0")
def paired_rows_guard(spark, d):
    rows = tested(spark, d).select("id", "cluster", "label")
    return rules.mismatched(rows, rows.where("cast(cluster as long) % 50 <> 0")).agg(F.count("*").alias("mismatched"))


NULL_DRAWS = 20


def _nulls(seed: str, rows: int, draws: int, boot: int, weak: float, by: str = "cell", boot_seed: str = "'0'") -> str:
    """CTEs up to v and p of a paired difference over rows of two methods that are equally good."""
    lean = f"CASE WHEN arm = 'unseen' THEN {weak} ELSE 0.35 END"
    return f"""r AS (SELECT range::VARCHAR AS id, 'draw-' || lpad((range // {rows})::VARCHAR, 3, '0') AS cell FROM range({rows * draws})),
    l AS (SELECT *, id AS cluster, CASE WHEN {sql.u(f"{seed}/label", "id")} < 0.4 THEN 1 ELSE 0 END AS label, CASE WHEN {sql.u(f"{seed}/arm", "id")} < 0.5 THEN 'seen' ELSE 'unseen' END AS arm FROM r),
    t AS (SELECT *, {lean} * label + (1 - {lean}) * {sql.u(f"{seed}/a", "id")} AS score_a, {lean} * label + (1 - {lean}) * {sql.u(f"{seed}/b", "id")} AS score_b FROM l),
    {sql.weights("t", by, boot, boot_seed)}, {_pair_sql("t", by)}"""


CLAIMS = {
    "difference_clears_floor": f"""WITH {_nulls("null", 240, NULL_DRAWS, 200, 0.35)}, i AS ({sql.interval("v", "p", "cell", 200)}) SELECT count(*) FILTER ((lo > 0 OR hi < 0) AND abs(point) > 0.04) AS effects FROM i""",
    "k_of_n_cells": f"""WITH {_nulls("null-cells", 150, 16 * NULL_DRAWS, 100, 0.35)}, i AS ({sql.interval("v", "p", "cell", 100)}),
        c AS (SELECT right(cell, 3)::INT // 16 AS draw, count(*) FILTER (lo > 0 AND point > 0.05) AS clears FROM i GROUP BY ALL) SELECT count(*) FILTER (clears >= 5) AS effects FROM c""",
    "difference_of_drops": f"""WITH {_nulls("null-drops", 600, NULL_DRAWS, 200, 0.2, "cell, arm", DID_SEED)},
        dv AS (SELECT cell, draw, max(value) FILTER (arm = 'seen') - max(value) FILTER (arm = 'unseen') AS value FROM v GROUP BY ALL),
        dp AS (SELECT cell, max(point) FILTER (arm = 'seen') - max(point) FILTER (arm = 'unseen') AS point FROM p GROUP BY ALL),
        i AS ({sql.interval("dv", "dp", "cell", 200)}) SELECT count(*) FILTER (excludes_zero) AS effects FROM i""",
}
NULLS = " UNION ALL ".join(f"SELECT '{n}' AS rule, {NULL_DRAWS}::BIGINT AS draws, effects, 3::BIGINT AS allowed, 0::BIGINT AS exact_claims, effects <= 3 AS passed FROM ({s})" for n, s in CLAIMS.items())


@query(NULLS)
def null_suite(spark, d):
    return rules.null_suite(spark, None, NULL_DRAWS)


# Grid, coverage, costs

CELLS = "(SELECT DISTINCT 'orders' AS task, 'orders/' || o_orderstatus AS cell FROM orders)"
PLAN = f"plan AS (SELECT task, cell, method, split_key, fit_seed FROM {CELLS}, (VALUES ('majority'), ('logreg')) m(method), (VALUES ('split-0'), ('split-1')) k(split_key), (VALUES (0), (1), (2)) s(fit_seed))"
DONE = f"""{PLAN}, rec AS (SELECT *, CASE WHEN {sql.u("status", "cell || method || split_key || fit_seed")} < 0.6 THEN 'ok' WHEN {sql.u("status", "cell || method || split_key || fit_seed")} < 0.75 THEN 'skipped' ELSE 'error' END AS status,
  CASE WHEN fit_seed = 2 AND method = 'logreg' THEN 'old' ELSE 'new' END AS code FROM plan WHERE NOT (cell = 'orders/P' AND split_key = 'split-1'))"""


def planned(spark: SparkSession, d: str) -> DataFrame:
    cells = read(spark, d, "orders").select(F.lit("orders").alias("task"), F.concat(F.lit("orders/"), "o_orderstatus").alias("cell")).distinct()
    return grid.plan(cells, ["majority", "logreg"], GRID_KEYS, GRID_SEEDS)


def recorded(spark: SparkSession, d: str) -> DataFrame:
    u = hashing.unit_hash("status", F.concat("cell", "method", "split_key", F.col("fit_seed").cast("string")))
    rows = planned(spark, d).where("not (cell = 'orders/P' and split_key = 'split-1')")
    return rows.withColumn("status", F.when(u < 0.6, "ok").when(u < 0.75, "skipped").otherwise("error")).withColumn("code", F.when((F.col("fit_seed") == 2) & (F.col("method") == "logreg"), "old").otherwise("new"))


@query(f"WITH {PLAN} SELECT *, replace(cell, '/', '--') || '__' || method || '__' || split_key || '__s' || fit_seed AS run FROM plan")
def grid_plan(spark, d):
    return planned(spark, d).withColumn("run", grid.run_id())


STATUS = f"WITH {DONE}, st AS (SELECT p.*, CASE WHEN r.status IS NULL THEN 'missing' WHEN r.code <> 'new' THEN 'stale' ELSE r.status END AS status FROM plan p LEFT JOIN rec r USING (task, cell, method, split_key, fit_seed))"
COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in grid.STATUSES)


@query(f"{STATUS} SELECT * FROM st")
def run_status(spark, d):
    return grid.run_status(planned(spark, d), recorded(spark, d), "new")


@query(f"{STATUS} SELECT method, count(*) AS planned, {COUNTS}, count(*) FILTER (status IN ('error', 'missing', 'stale')) = 0 AS complete FROM st GROUP BY GROUPING SETS ((method), ())")
def coverage_by_method(spark, d):
    return grid.coverage(run_status(spark, d))


@query(f"{STATUS} SELECT count(*) AS planned, {COUNTS}, count(*) FILTER (status IN ('error', 'missing', 'stale')) = 0 AS complete FROM st")
def coverage_totals(spark, d):
    return grid.coverage(run_status(spark, d)).where("method is null").drop("method")


@query(f"WITH {DONE} SELECT * FROM plan WHERE (task, cell, method, split_key, fit_seed) NOT IN (SELECT (task, cell, method, split_key, fit_seed) FROM rec WHERE status IN ('ok', 'skipped'))")
def todo_anti_join(spark, d):
    return grid.to_do(planned(spark, d), recorded(spark, d))


@query(f"WITH {DONE} SELECT code, count(*) AS records FROM rec GROUP BY code")
def mixed_code_guard(spark, d):
    return grid.mixed_code(recorded(spark, d))


CALLS = "calls AS (SELECT 'model-' || (conv_id % 4) AS model, length(text) AS input_tokens, turn AS output_tokens FROM conversations)"
PRICES = "prices AS (SELECT * FROM (VALUES ('model-0', 0.003, 0.015), ('model-1', 0.001, 0.002), ('model-2', 0.01, 0.03)) p(model, input_per_1k, output_per_1k))"


def calls(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select(F.concat(F.lit("model-"), (F.col("conv_id") % 4).cast("string")).alias("model"), F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"))


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("model-0", 0.003, 0.015), ("model-1", 0.001, 0.002), ("model-2", 0.01, 0.03)], "model string, input_per_1k double, output_per_1k double")


@query(f"WITH {CALLS}, {PRICES} SELECT model, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round((sum(input_tokens) * any_value(input_per_1k)::DOUBLE + sum(output_tokens) * any_value(output_per_1k)::DOUBLE) / 1000, 6) AS cost FROM calls LEFT JOIN prices USING (model) GROUP BY model")
def cost_rollup(spark, d):
    return rounded(costs.rollup(calls(spark, d), prices(spark), strict=False))


@query(f"WITH {CALLS}, {PRICES} SELECT DISTINCT model FROM calls WHERE model NOT IN (SELECT model FROM prices)")
def unpriced_models(spark, d):
    return costs.unpriced(calls(spark, d), prices(spark))


@query(f"""WITH {TESTED}, a AS ({sql.ranked("t", "cell", "score_b")}), b AS ({sql.ranked("t", "cell", "score_a")}) SELECT a.cell, round(a.roc_auc, 6) AS before, round(b.roc_auc, 6) AS after, round(b.roc_auc - a.roc_auc, 6) AS delta FROM a JOIN b USING (cell)""")
def repair_delta(spark, d):
    rows = resample.weighted_once(tested(spark, d))
    of = lambda c: metrics.metric("roc_auc")(rows.withColumn("score", F.col(c)), ["cell"])
    return rounded(costs.repair_deltas(of("score_b"), of("score_a")))


@query(f"""WITH {TESTED}, a AS ({sql.ranked("t", "cell", "score_b")}), b AS ({sql.ranked("t", "cell", "score_a")}) SELECT round(avg(b.roc_auc - a.roc_auc), 6) AS mean_delta FROM a JOIN b USING (cell)""")
def repair_mean_delta(spark, d):
    rows = resample.weighted_once(tested(spark, d))
    of = lambda c: metrics.metric("roc_auc")(rows.withColumn("score", F.col(c)), ["cell"])
    return rounded(costs.repair_deltas(of("score_b"), of("score_a")).agg(F.avg("delta").alias("mean_delta")))


# Claims: each customer is a claim, each order an event of its log

EVENTS = """ev AS (SELECT o_custkey::VARCHAR AS claim, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, o_orderkey, o_orderdate, o_orderstatus, o_orderpriority FROM orders),
log AS (SELECT claim, seq, CASE WHEN seq = 1 THEN 'register' WHEN o_orderstatus = 'F' THEN 'resolve' WHEN o_orderstatus = 'O' THEN 'amend' ELSE 'untested' END AS kind, strftime(o_orderdate, '%Y-%m-%d') AS at,
  CASE WHEN seq = 1 OR o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'no_effect' WHEN o_orderkey % 3 = 1 THEN 'effect' ELSE 'effect:a' END END AS prediction, CASE WHEN seq = 1 THEN 'Q' || (claim::BIGINT % 5) END AS question,
  CASE WHEN seq = 1 OR o_orderstatus = 'O' THEN seq END AS version, CASE WHEN seq > 1 AND o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'confirmed' ELSE 'refuted' END END AS status FROM ev)"""


def events(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = read(spark, d, "orders").withColumn("claim", F.col("o_custkey").cast("string"))
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("claim").orderBy("o_orderkey")).cast("long"))
    first, state, key = F.col("seq") == 1, F.col("o_orderstatus"), F.col("o_orderkey")
    return rows.select(
        "claim", "seq", F.when(first, "register").when(state == "F", "resolve").when(state == "O", "amend").otherwise("untested").alias("kind"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"),
        F.when(first | (state == "O"), F.when(key % 3 == 0, "no_effect").when(key % 3 == 1, "effect").otherwise("effect:a")).alias("prediction"),
        F.when(first, F.concat(F.lit("Q"), (F.col("claim").cast("long") % 5).cast("string"))).alias("question"), F.when(first | (state == "O"), F.col("seq")).alias("version"),
        F.when(~first & (state == "F"), F.when(key % 2 == 0, "confirmed").otherwise("refuted")).alias("status"),
    )


REPLAY = f"""WITH {EVENTS}, h AS (SELECT *, CASE WHEN kind IN ('register', 'amend') THEN 'registered' WHEN kind = 'untested' THEN 'untested' ELSE status END AS now FROM log),
claims AS (SELECT claim, arg_max(prediction, seq) FILTER (prediction IS NOT NULL) AS prediction, arg_max(question, seq) FILTER (question IS NOT NULL) AS question, arg_max(version, seq) FILTER (version IS NOT NULL) AS version, arg_max(now, seq) FILTER (now IS NOT NULL) AS status,
  min("at") FILTER (kind = 'register') AS registered_at, count(*) FILTER (kind = 'amend') AS n_amended, max("at") FILTER (kind = 'amend') AS amended_at FROM h GROUP BY claim)"""


@query(f"{REPLAY} SELECT * FROM claims")
def claims_replay(spark, d):
    return claims.replay(events(spark, d))


@query(f"{REPLAY} SELECT s.status, count(c.claim) AS claims FROM (VALUES {', '.join(f'({s!r})' for s in claims.STATUSES)}) s(status) LEFT JOIN claims c USING (status) GROUP BY s.status")
def claim_status_counts(spark, d):
    return claims.status_counts(claims_replay(spark, d))


VERDICTS = [("Q0", "effect", "a", False, "s"), ("Q1", "effect", "b", False, "s"), ("Q2", "no_effect", None, False, "s"), ("Q3", "inconclusive", None, False, "other"), ("Q4", "effect", "a", True, "s")]
VERDICT_SQL = "verdicts AS (SELECT * FROM (VALUES ('Q0', 'effect', 'a', false, 's'), ('Q1', 'effect', 'b', false, 's'), ('Q2', 'no_effect', NULL, false, 's'), ('Q3', 'inconclusive', NULL, false, 'other'), ('Q4', 'effect', 'a', true, 's')) v(question, outcome, better, oracle, snapshot))"


@query(f"""{REPLAY}, {VERDICT_SQL} SELECT claim, question, CASE WHEN outcome = 'inconclusive' THEN 'inconclusive' WHEN prediction = 'no_effect' THEN CASE WHEN outcome = 'no_effect' THEN 'confirmed' ELSE 'refuted' END
  WHEN outcome <> 'effect' THEN 'refuted' WHEN prediction = 'effect' OR split_part(prediction, ':', 2) = better THEN 'confirmed' ELSE 'inverted' END AS status, coalesce(amended_at >= '1998-01-01', false) AS amended_after_results,
  CASE WHEN oracle THEN 'oracle selection can''t confirm a claim' WHEN registered_at >= '1998-01-01' THEN 'registered after the first run' WHEN snapshot <> 's' THEN 'the question has changed since' END AS problem
FROM claims JOIN verdicts USING (question) WHERE status <> 'untested'""")
def claim_status(spark, d):
    verdicts = spark.createDataFrame(VERDICTS, "question string, outcome string, better string, oracle boolean, snapshot string")
    times = spark.createDataFrame([(f"Q{i}", t) for i in range(5) for t in ("1998-01-01", "1999-05-05")], "question string, started_at string")
    return claims.resolutions(claims_replay(spark, d).withColumn("claim_snapshot", F.lit("s")), verdicts, times)


CHAIN = """chain AS (SELECT conv_id::VARCHAR AS log, turn, sha256(text) AS hash, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations),
linked AS (SELECT *, CASE WHEN conv_id_bad THEN 'edited' ELSE lag(hash, 1, repeat('0', 64)) OVER (PARTITION BY log ORDER BY seq) END AS prev FROM (SELECT *, log::BIGINT % 11 = 0 AND seq = 2 AS conv_id_bad FROM chain))"""


@query(f"WITH {CHAIN} SELECT log, seq FROM linked WHERE conv_id_bad")
def chain_check(spark, d):
    from pyspark.sql import Window

    own = Window.partitionBy("log").orderBy("turn")
    rows = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("log"), "turn", F.sha2("text", 256).alias("hash"))
    rows = rows.withColumn("seq", F.row_number().over(own).cast("long")).withColumn("prev", F.lag("hash", 1, logs.START).over(own))
    rows = rows.withColumn("prev", F.when((F.col("log").cast("long") % 11 == 0) & (F.col("seq") == 2), "edited").otherwise(F.col("prev")))
    return logs.broken_links(rows).select("log", "seq")


NOTES = "notes AS (SELECT doc_id, 'see [claim:C' || (doc_id % 9) || '] and [claim:C' || (doc_id % 4) || ']' AS text FROM documents)"


def notes(spark: SparkSession, d: str) -> DataFrame:
    mark = lambda n: F.concat(F.lit("[claim:C"), (F.col("doc_id") % n).cast("string"), F.lit("]"))
    return read(spark, d, "documents").select(F.concat(F.lit("see "), mark(9), F.lit(" and "), mark(4)).alias("text"))


def registered(spark: SparkSession) -> DataFrame:
    return spark.range(4, 12).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("claim"))


@query("SELECT 'C' || r AS claim FROM range(4) t(r)")
def cited_unknown_claims(spark, d):
    return claims.unknown_citations(notes(spark, d), registered(spark))


@query(f"WITH {NOTES}, m AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\[claim:([A-Za-z0-9_-]+)\\]', 1)) AS claim FROM notes) SELECT 'C' || r AS claim FROM range(4, 12) t(r) WHERE 'C' || r NOT IN (SELECT claim FROM m)")
def uncited_claims(spark, d):
    return claims.uncited_claims(notes(spark, d), registered(spark))


@query(f"WITH {NOTES} SELECT DISTINCT unnest(regexp_extract_all(text, '\\[claim:([A-Za-z0-9_-]+)\\]', 1)) AS claim FROM notes")
def cited_claims(spark, d):
    return claims.cited(notes(spark, d))


@query("SELECT strftime(min(day), '%Y-%m-%d') AS earliest FROM (SELECT min(o_orderdate) AS day FROM orders UNION ALL SELECT min(l_shipdate) FROM lineitem)")
def earliest_result(spark, d):
    both = read(spark, d, "orders").select(F.col("o_orderdate").alias("at")).unionByName(read(spark, d, "lineitem").select(F.col("l_shipdate").alias("at")))
    return both.agg(F.date_format(F.min("at"), "yyyy-MM-dd").alias("earliest"))


# Channels and features

REGISTRY = channels.Registry(
    [channels.Channel("tabular", "numeric", ["o_totalprice", "o_shippriority"], {"scale": True}), channels.Channel("status", "categorical", ["o_orderstatus"], {"encoding": "one_hot"}), channels.Channel("leak", "categorical", ["o_orderpriority"], {"encoding": "one_hot"})],
    {"o_orderkey": "identifier", "o_custkey": "cluster"},
)


def _columns(spark, d) -> DataFrame:
    return spark.createDataFrame([(c,) for c in read(spark, d, "orders").columns], "column string")


def _registered(spark) -> DataFrame:
    rows = [(c.name, x) for c in REGISTRY.channels for x in c.columns]
    return spark.createDataFrame(rows, "channel string, column string")


REG = "reg AS (SELECT * FROM (VALUES ('tabular', 'o_totalprice'), ('tabular', 'o_shippriority'), ('status', 'o_orderstatus'), ('leak', 'o_orderpriority')) r(channel, \"column\")), cols AS (SELECT column_name AS \"column\" FROM (DESCRIBE SELECT * FROM orders))"


@query(f"WITH {REG} SELECT c.\"column\", CASE WHEN c.\"column\" IN ('o_orderkey', 'o_custkey') THEN 'ignore' ELSE channel END AS owner FROM cols c LEFT JOIN reg USING (\"column\")")
def registry_ownership(spark, d):
    owner = F.coalesce(F.when(F.col("column").isin(*REGISTRY.ignore), "ignore"), F.col("channel"))
    return _columns(spark, d).join(F.broadcast(_registered(spark)), "column", "left").select("column", owner.alias("owner"))


@query(f"WITH {REG} SELECT \"column\", 'unregistered' AS problem FROM cols WHERE \"column\" NOT IN (SELECT \"column\" FROM reg) AND \"column\" NOT IN ('o_orderkey', 'o_custkey') UNION ALL SELECT \"column\", 'missing' FROM reg WHERE \"column\" NOT IN (SELECT \"column\" FROM cols)")
def unregistered_columns(spark, d):
    have, known = _columns(spark, d), _registered(spark)
    loose = have.where(~F.col("column").isin(*REGISTRY.ignore)).join(F.broadcast(known), "column", "left_anti").withColumn("problem", F.lit("unregistered"))
    lacking = known.select("column").join(F.broadcast(have), "column", "left_anti").withColumn("problem", F.lit("missing"))
    return loose.unionByName(lacking)


@query("SELECT 'leak' AS channel, 'o_orderpriority' AS \"column\"")
def leak_guard(spark, d):
    labels = spark.createDataFrame([("o_orderpriority",)], "column string")
    return _registered(spark).join(F.broadcast(labels), "column", "left_semi").select("channel", "column")


@query(f'WITH {sql.ORD} SELECT "split__split-0" AS split, count(*) AS rows FROM ord WHERE "split__split-0" <> \'train\' GROUP BY 1')
def non_training_rows(spark, d):
    return channels.non_training(split_assignment(spark, d), "split__split-0")


#: Orders with a number that has gaps, a code list and a text.
FEAT = f"""{sql.ORD}, f AS (SELECT id, label, "split__split-0" AS split, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END AS category,
  o_orderstatus || '; ' || substr(o_orderpriority, 3) || ';;' || o_orderstatus AS codes FROM ord JOIN orders ON id = o_orderkey::VARCHAR), tr AS (SELECT * FROM f WHERE split = 'train')"""


def featured(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")
    rows = split_assignment(spark, d).select("id", "label", F.col("split__split-0").alias("split"))
    key = F.col("o_orderkey")
    codes = F.concat("o_orderstatus", F.lit("; "), F.substring("o_orderpriority", 3, 100), F.lit(";;"), "o_orderstatus")
    cols = orders.select(key.cast("string").alias("id"), F.when(key % 5 != 0, F.col("o_totalprice")).alias("price"), F.when(key % 6 != 0, F.col("o_orderpriority")).alias("category"), codes.alias("codes"))
    return rows.join(cols, "id")


def _parts(spark, d):
    rows = featured(spark, d)
    return rows, rows.where("split = 'train'"), rows.where("split <> 'train'")


@query(f"""WITH {FEAT}, m AS (SELECT quantile_cont(price, 0.5) AS fill FROM tr), s AS (SELECT fill, avg(coalesce(price, fill)) AS mean, stddev_pop(coalesce(price, fill)) AS std, avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0 END) AS share FROM tr, m GROUP BY fill)
SELECT id, 'tabular:price' AS feature, round((coalesce(price, fill) - mean) / std, 6) AS value FROM f, s WHERE split <> 'train'
UNION ALL SELECT id, 'tabular:missing(price)', round((CASE WHEN price IS NULL THEN 1 ELSE 0 END - share) / sqrt(share * (1 - share)), 6) FROM f, s WHERE split <> 'train'""")
def impute_scale(spark, d):
    _, train, rest = _parts(spark, d)
    own = channels.Channel("tabular", "numeric", ["price"], {"scale": True, "missing_indicator": True})
    return rounded(channels.Featurizer([own], "split").fit(train).transform(rest))


@query(f"""WITH {FEAT}, v AS (SELECT coalesce(category, '<missing>') AS category, count(*) AS n FROM tr GROUP BY 1), th AS (SELECT max(n) AS top FROM v)
SELECT id, 'cat:category=' || coalesce(category, '<missing>') AS feature, 1.0::DOUBLE AS value FROM f WHERE split <> 'train' AND coalesce(category, '<missing>') IN (SELECT category FROM v)""")
def one_hot(spark, d):
    _, train, rest = _parts(spark, d)
    own = channels.Channel("cat", "categorical", ["category"], {"encoding": "one_hot"})
    return channels.Featurizer([own], "split").fit(train).transform(rest)


@query(f"""WITH {FEAT}, c AS (SELECT DISTINCT id, split, trim(x) AS code FROM (SELECT id, split, unnest(string_split(codes, ';')) AS x FROM f) WHERE trim(x) <> '')
SELECT id, 'codes:codes=' || code AS feature, 1.0::DOUBLE AS value FROM c WHERE split <> 'train' AND code IN (SELECT code FROM c WHERE split = 'train')""")
def multihot(spark, d):
    _, train, rest = _parts(spark, d)
    return channels.Featurizer([channels.Channel("codes", "multihot", ["codes"])], "split").fit(train).transform(rest)


@query(f"""WITH {FEAT}, x AS (SELECT id, label, coalesce(category, '<missing>') AS category, floor({sql.u("fold", "id")} * 5)::INT AS fold FROM tr),
a AS (SELECT x.id, any_value(x.category) AS category, avg(y.label) AS prior, sum(y.label) FILTER (y.category = x.category) AS s, count(*) FILTER (y.category = x.category) AS n FROM (SELECT DISTINCT fold, category, fold || category AS id FROM x) x JOIN x y ON x.fold <> y.fold GROUP BY x.id)
SELECT x.id, 'cat:category' AS feature, round((coalesce(a.s, 0) + a.prior) / (a.n + 1.0), 6) AS value FROM x JOIN a ON a.id = x.fold || x.category""")
def target_encode_crossfit(spark, d):
    return rounded(channels.target_encode_train(_parts(spark, d)[1], "cat", "category"))


@query(f"""WITH {FEAT}, p AS (SELECT avg(label) AS prior FROM tr), s AS (SELECT coalesce(category, '<missing>') AS category, (sum(label) + any_value(prior)) / (count(*) + 1.0) AS v FROM tr, p GROUP BY 1)
SELECT id, 'cat:category' AS feature, round(coalesce(v, prior), 6) AS value FROM p, f LEFT JOIN s ON coalesce(f.category, '<missing>') = s.category WHERE split <> 'train'""")
def target_encode(spark, d):
    _, train, rest = _parts(spark, d)
    return rounded(channels.target_encode(rest, train, "cat", "category"))


DOCS = f"d AS (SELECT doc_id::VARCHAR AS id, text, {sql.split('split-0', 'doc_id::VARCHAR')} AS split FROM documents)"


@query(f"""WITH {DOCS}, k AS (SELECT id, split, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')) AS term FROM d), c AS (SELECT id, split, term, count(*) AS tf FROM k WHERE length(term) > 1 GROUP BY ALL),
v AS (SELECT term, count(*) AS df, sum(tf) AS tf FROM c WHERE split = 'train' GROUP BY term HAVING count(*) >= 2 ORDER BY tf DESC, term LIMIT 500), n AS (SELECT count(*) AS n FROM d WHERE split = 'train'),
w AS (SELECT id, c.term, c.tf * (ln((1 + n) / (1.0 + df)) + 1) AS x FROM c JOIN v USING (term), n WHERE split <> 'train')
SELECT id, 'text:' || term AS feature, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS value FROM w""")
def tfidf(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    docs = docs.withColumn("split", fixtures.split_column(F.col("id"), "split-0", (0.2, "test-v1"), 0.25))
    own = channels.Channel("text", "text", ["text"], {"max_features": 500, "min_df": 2})
    return rounded(channels.Featurizer([own], "split").fit(docs.where("split = 'train'")).transform(docs.where("split <> 'train'")))


@query(f"""WITH {FEAT} SELECT coalesce(category, '<missing>') AS category, round(avg(label), 6) AS rate FROM tr GROUP BY 1""")
def outcome_rate(spark, d):
    return rounded(_parts(spark, d)[1].groupBy(F.coalesce("category", F.lit(channels.MISSING)).alias("category")).agg(F.avg("label").alias("rate")))


# Methods

LAST = f"WITH {sql.ORD}"


@query(f"""{LAST}, p AS (SELECT avg(label) AS p1 FROM ord WHERE "split__split-0" = 'train') SELECT id, round(1 - p1, 6) AS p0, round(p1, 6) AS p1 FROM ord, p WHERE "split__split-0" <> 'train'""")
def majority_proba(spark, d):
    rows = split_assignment(spark, d).select("id", "label", F.col("split__split-0").alias("split"))
    found = methods.make("majority").fit_predict(rows.where("split = 'train'"), rows.where("split <> 'train'"), 2, 0)
    return rounded(found.select("id", F.get("probs", F.lit(0)).alias("p0"), F.get("probs", F.lit(1)).alias("p1")))


def _features(spark, d) -> tuple[DataFrame, DataFrame]:
    from assayer.operators.runner import vectorised

    chosen = [channels.Channel("tabular", "numeric", ["price"], {"scale": True}), channels.Channel("cat", "categorical", ["codes"], {"encoding": "one_hot"})]
    _, train, rest = _parts(spark, d)
    return vectorised(chosen, "split", train, rest)[:2]


def _scores(name: str, spark, d) -> DataFrame:
    train, rest = _features(spark, d)
    return methods.make(name).fit_predict(train, rest, 2, 0).select("id", F.get("probs", F.lit(1)).alias("score"))


@query()
def logreg_scores(spark, d):
    return _scores("logreg", spark, d)


@query()
def tree_scores(spark, d):
    return _scores("hist_gbm", spark, d)


@query()
def tfidf_logreg_scores(spark, d):
    from assayer.operators.runner import vectorised

    rows = read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("quality").cast("int").alias("label"))
    rows = rows.withColumn("split", fixtures.split_column(F.col("id"), "split-0", (0.2, "test-v1"), 0.25))
    own = channels.Channel("text", "text", ["text"], {"max_features": 300, "min_df": 2})
    train, rest, _ = vectorised([own], "split", rows.where("split = 'train'"), rows.where("split <> 'train'"))
    return methods.make("tfidf_logreg").fit_predict(train, rest, 2, 0).select("id", F.get("probs", F.lit(1)).alias("score"))
