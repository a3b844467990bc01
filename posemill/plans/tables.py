"""Queries on labels, splits, agreement, clusters and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posemill.functions import scalars as X
from posemill.functions.nulls import nan_to_null
from posemill.operators import agreement as A
from posemill.operators import cluster as C
from posemill.operators import joins, labels, learn, sampling, stats, windows
from posemill.plans.base import FEATURES, FRAMES, features, frames, mean_of, query, r, read, scaled
from posemill.plans.series import RULES, ruled
from posemill.sources import readers, writers

INTERVALS = """intervals AS (
  SELECT o_custkey AS user_id, ((o_orderkey * 7) % 700)::DOUBLE AS a, ((o_orderkey * 7) % 700)::DOUBLE + 8 + (o_orderkey % 5) * 10 AS b, o_orderkey AS ord,
         CAST(substr(o_orderpriority, 1, 1) AS INT) % 3 AS label, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice / 100000 END AS w FROM orders)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = ((F.col("o_orderkey") * 7) % 700).cast("double")
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"), start.alias("a"), (start + 8 + (F.col("o_orderkey") % 5) * 10).alias("b"), F.col("o_orderkey").alias("ord"),
        (F.substring("o_orderpriority", 1, 1).cast("int") % 3).alias("label"), F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice") / 100000).alias("w"))


@query(f"""WITH {FEATURES}, {INTERVALS}
SELECT user_id, start_s, max_by(label, ord) AS label, round_even(coalesce(max_by(w, ord) FILTER (WHERE w IS NOT NULL), 1) + 1e-9, 6) AS weight
FROM features JOIN intervals USING (user_id) WHERE start_s + 36 >= a AND start_s + 36 < b GROUP BY user_id, start_s""")
def interval_label_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = features(spark, sf_dir).select("user_id", "start_s", (F.col("start_s") + 36).alias("centre"))
    out = joins.attach_labels(points, intervals(spark, sf_dir), "user_id", "centre", "a", "b", "ord", "label", "w", ["user_id", "start_s"], slot=48.0)
    return out.select("user_id", "start_s", "label", mean_of(F.col("weight")).alias("weight"))


@query(f"""WITH {FEATURES}, {INTERVALS}, recoded AS (SELECT *, CASE label WHEN 0 THEN 2 WHEN 2 THEN 0 END AS y FROM intervals)
SELECT user_id, start_s, max_by(y, ord) AS y FROM features JOIN recoded USING (user_id) WHERE y IS NOT NULL AND start_s + 36 >= a AND start_s + 36 < b GROUP BY user_id, start_s""")
def interval_label_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    recoded = intervals(spark, sf_dir).withColumn("y", F.when(F.col("label").isin(0, 2), X.reversed_rating(F.col("label")))).filter("y IS NOT NULL")
    points = features(spark, sf_dir).select("user_id", "start_s", (F.col("start_s") + 36).alias("centre"))
    return joins.attach_labels(points, recoded, "user_id", "centre", "a", "b", "ord", "y", None, ["user_id", "start_s"], slot=48.0).drop("weight")


@query(f"""WITH {FEATURES}, j AS (
  SELECT f.user_id, f.start_s, c.c_nationkey AS rating, f.start_s + 36 >= 120 + c_custkey % 600 AND f.start_s + 36 < 240 + c_custkey % 600 AS hit
  FROM features f JOIN customer c ON c.c_custkey = f.user_id
)
SELECT user_id, start_s, rating FROM (SELECT *, bool_or(hit) OVER (PARTITION BY user_id) AS any_hit FROM j) WHERE hit OR NOT any_hit""")
def interval_expand_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("rating"), (F.col("c_custkey") % 600).alias("d"))
    joined = features(spark, sf_dir).join(rated, "user_id")
    centre = F.col("start_s") + 36
    return joins.inside_or_all(joined, ["user_id"], (centre >= 120 + F.col("d")) & (centre < 240 + F.col("d"))).select("user_id", "start_s", "rating")


@query("""SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) GROUP BY c_mktsegment""")
def semi_sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = read(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.members(read(spark, sf_dir, "customer"), keys, "c_custkey").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) GROUP BY c_mktsegment""")
def anti_sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = read(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.non_members(read(spark, sf_dir, "customer"), keys, "c_custkey").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


_SPLIT = """ranked AS (SELECT c_custkey, c_mktsegment, count(*) OVER (PARTITION BY c_mktsegment) AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY (c_custkey * 7919) % 10007, c_custkey) AS i FROM customer),
sized AS (SELECT *, greatest(1, round_even(n * 0.6, 0)) AS tr, round_even(n * 0.2, 0) AS va FROM ranked),
split AS (SELECT c_custkey, c_mktsegment, CASE WHEN i <= tr THEN 'train' WHEN i <= tr + va THEN 'val' ELSE 'test' END AS split FROM sized)"""


@query(f"WITH {_SPLIT} SELECT * FROM split")
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(read(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", (F.col("c_custkey") * 7919) % 10007)


@query(f"""WITH {_SPLIT} SELECT o_orderkey, coalesce(split, 'train') AS split FROM orders LEFT JOIN (SELECT * FROM split WHERE c_mktsegment <> 'BUILDING') ON c_custkey = o_custkey""")
def split_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = split_assign(spark, sf_dir).filter("c_mktsegment <> 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey")
    return joins.with_default(read(spark, sf_dir, "orders"), split, "o_custkey", "split", "train").select("o_orderkey", "split")


@query(r"""WITH named AS (SELECT n_nationkey, upper(repeat(chr(97 + n_nationkey), 3)) || 'o' AS n_name FROM nation), m AS (SELECT s_suppkey, 'P' || s_suppkey AS participant, 'P0' || s_suppkey || '_' || n_name || '_raw_features.csv' AS stem, lower(n_name) AS nm, s_acctbal FROM supplier JOIN named ON n_nationkey = s_nationkey),
v AS (SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '/v/' || n_name || ' ' || c_custkey || ' side front.mp4' WHEN 'BUILDING' THEN '/v/x_P00' || c_custkey || ' Side.mp4' WHEN 'FURNITURE' THEN '/w/' || c_custkey || ' side front.mp4'
  WHEN 'HOUSEHOLD' THEN '/v/P' || c_custkey || ' side top.mp4' ELSE '/v/' || n_name || ' rear side.mp4' END AS path FROM customer JOIN named ON n_nationkey = c_nationkey),
f AS (SELECT path, lower(regexp_extract(path, '[^/]*$')) AS base FROM v WHERE lower(path) LIKE '%side%' AND lower(path) NOT LIKE '%rear%' AND lower(path) NOT LIKE '%top%'),
c AS (
  SELECT s_suppkey, 0 AS tier, '/m/' || s_suppkey AS path FROM m WHERE s_acctbal < 0
  UNION ALL SELECT s_suppkey, 1, path FROM m, f WHERE nm NOT IN ('side', 'front', 'top') AND regexp_matches(nm, '^[a-z]{3,}$') AND contains(base, nm)
  UNION ALL SELECT s_suppkey, 2, path FROM m, f WHERE regexp_matches(base, 'p0*0' || s_suppkey || '([^a-z0-9_]|$)')
  UNION ALL SELECT s_suppkey, 3, path FROM m, f WHERE regexp_matches(base, '^0*' || s_suppkey || '([^a-z0-9_]|$)')
), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY tier, path) = 1)
SELECT participant, stem AS raw_stem, b.path AS video, tier::INT AS tier FROM m LEFT JOIN b USING (s_suppkey)""")
def priority_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants with names and numbers against video files, by the cascade of the manual map, name and number."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.upper(F.repeat(F.char(97 + F.col("n_nationkey")), F.lit(3))), F.lit("o")).alias("n_name"))
    people = read(spark, sf_dir, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey"))
    rows = people.select(F.concat(F.lit("P"), "s_suppkey").alias("participant"), F.concat(F.lit("P0"), "s_suppkey", F.lit("_"), "n_name", F.lit("_raw_features.csv")).alias("raw_stem"))
    k, c = F.col("c_custkey"), F.col("c_mktsegment")
    name = (F.when(c == "AUTOMOBILE", F.concat(F.lit("/v/"), "n_name", F.lit(" "), k, F.lit(" side front.mp4"))).when(c == "BUILDING", F.concat(F.lit("/v/x_P00"), k, F.lit(" Side.mp4")))
            .when(c == "FURNITURE", F.concat(F.lit("/w/"), k, F.lit(" side front.mp4"))).when(c == "HOUSEHOLD", F.concat(F.lit("/v/P"), k, F.lit(" side top.mp4"))).otherwise(F.concat(F.lit("/v/"), "n_name", F.lit(" rear side.mp4"))))
    videos = read(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(name.alias("path"))
    manual = people.filter("s_acctbal < 0").select(F.concat(F.lit("P"), "s_suppkey").alias("participant"), F.concat(F.lit("/m/"), "s_suppkey").alias("video_path"))
    return joins.match_videos(rows, videos, manual)


@query("""SELECT c_custkey, coalesce(o.price, s.price) AS price, CASE WHEN o.price IS NOT NULL THEN 'orders' ELSE 'balance' END AS origin
FROM (SELECT c_custkey, c_acctbal AS price FROM customer) s FULL JOIN (SELECT o_custkey, max(o_totalprice) AS price FROM orders WHERE o_totalprice > 300000 GROUP BY 1) o ON o_custkey = c_custkey WHERE c_custkey IS NOT NULL""")
def first_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").filter("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("price")).withColumn("origin", F.lit("orders"))
    balances = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("price"), F.lit("balance").alias("origin"))
    return joins.first_given([orders.join(balances.select("c_custkey"), "c_custkey", "left_semi"), balances], "c_custkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1""")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return windows.keep_first(read(spark, sf_dir, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(f"""WITH {FRAMES}, a AS (SELECT user_id, t, value FROM frames QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, t) = 1),
b AS (SELECT f.user_id, f.t, f.value FROM frames f JOIN a USING (user_id) WHERE abs(f.t - a.t) >= 24 QUALIFY row_number() OVER (PARTITION BY f.user_id ORDER BY f.value DESC, f.t) = 1),
c AS (SELECT f.user_id, f.t, f.value FROM frames f JOIN a USING (user_id) JOIN b USING (user_id) WHERE abs(f.t - a.t) >= 24 AND abs(f.t - b.t) >= 24 QUALIFY row_number() OVER (PARTITION BY f.user_id ORDER BY f.value DESC, f.t) = 1),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
SELECT user_id, round_even(t, 6) AS t, value FROM (SELECT * FROM u ORDER BY value DESC, user_id, t LIMIT 100)""")
def greedy_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = sampling.spaced_picks(frames(spark, sf_dir).select("user_id", "t", "value"), "user_id", "t", "value", 100, 3, 24.0)
    return picked.select("user_id", r("t").alias("t"), "value")


@query()
def round_robin_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("cluster"), (F.col("vec_id") % 40).alias("group"), ((F.col("vec_id") * 37) % 1000).cast("double").alias("at"), F.col("vec_id").alias("ord"))
    return sampling.round_robin_picks(rows, "cluster", "group", "at", "ord", 60, 3, 6.0)




@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS price, CASE WHEN l_quantity <= 45 THEN l_discount END AS disc FROM lineitem),
b AS (SELECT quantile_cont(price, 0.02) AS p0, quantile_cont(price, 0.98) AS p1, quantile_cont(disc, 0.02) AS d0, quantile_cont(disc, 0.98) AS d1 FROM v),
w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(least(price, p1), p0) AS price, CASE WHEN disc IS NOT NULL THEN greatest(least(disc, d1), d0) END AS disc FROM v, b),
i AS (SELECT w.* REPLACE (coalesce(price, pm) AS price, coalesce(disc, dm) AS disc) FROM w, (SELECT median(price) AS pm, median(disc) AS dm FROM w)),
q AS (SELECT quantile_cont(price, [0.25, 0.5, 0.75]) AS p, quantile_cont(disc, [0.25, 0.5, 0.75]) AS d FROM i)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even((price - p[2]) / CASE WHEN p[3] > p[1] THEN p[3] - p[1] ELSE 1 END, 6) AS price,
       round_even((disc - d[2]) / CASE WHEN d[3] > d[1] THEN d[3] - d[1] ELSE 1 END, 6) AS disc FROM i, q""")
def winsorize_impute_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("price"), F.when(F.col("l_quantity") <= 45, F.col("l_discount")).alias("disc"))
    return stats.prepared(rows, ["price", "disc"]).withColumns({c: r(c) for c in ("price", "disc")})


RATED = """rated AS (SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INT) AS a, CAST(least(floor(o_totalprice / 100000) + 1, 5) AS INT) AS b, o_custkey FROM orders)"""


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("a"), F.least(F.floor(F.col("o_totalprice") / 100000) + 1, F.lit(5)).cast("int").alias("b"), "o_custkey")


@query(f"""WITH {RATED} SELECT a AS true_label, {', '.join(f'count(*) FILTER (WHERE b = {k}) AS pred_{k}' for k in range(1, 6))} FROM rated GROUP BY a""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.confusion_matrix(rated(spark, sf_dir), "a", "b", [1, 2, 3, 4, 5])


_SCORES = """l AS (SELECT DISTINCT unnest([a, b]) AS label FROM rated), s AS (
  SELECT label, count(*) FILTER (WHERE a = label AND b = label) AS hit, count(*) FILTER (WHERE a = label) AS support, count(*) FILTER (WHERE b = label) AS said FROM l, rated GROUP BY label
), k AS (SELECT label, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall, coalesce(2 * hit / nullif(said + support, 0), 0) AS f1, support, hit FROM s)"""


@query(f"WITH {RATED}, {_SCORES} SELECT label, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall, round_even(f1, 6) AS f1, support FROM k")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = A.class_scores(A.pair_counts(rated(spark, sf_dir), "a", "b"))
    return scores.select("label", r("precision").alias("precision"), r("recall").alias("recall"), r("f1").alias("f1"), "support")


@query(f"""WITH {RATED}, {_SCORES} SELECT sum(support)::BIGINT AS n, round_even(sum(hit) / sum(support), 6) AS accuracy, round_even(avg(f1), 6) AS macro_f1,
round_even(sum(f1 * support) / sum(support), 6) AS weighted_f1, round_even(avg(recall) FILTER (WHERE support > 0), 6) AS balanced_accuracy FROM k""")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.summary(A.class_scores(A.pair_counts(rated(spark, sf_dir), "a", "b")))
    return out.withColumns({c: r(c) for c in ("accuracy", "macro_f1", "weighted_f1", "balanced_accuracy")})


def _kappa_sql(power: int) -> str:
    return f"""SELECT {power} AS power, 1 - (SELECT sum(abs(a - b) ** {power}) FROM rated) * (SELECT count(*) FROM rated) / (
      SELECT sum(abs(x.a - y.b) ** {power} * x.n * y.n) FROM (SELECT a, count(*) AS n FROM rated GROUP BY a) x, (SELECT b, count(*) AS n FROM rated GROUP BY b) y) AS kappa"""


@query(f"""WITH {RATED}, k AS ({_kappa_sql(1)} UNION ALL {_kappa_sql(2)})
SELECT power, round_even(kappa, 6) AS kappa, CASE WHEN kappa < 0.2 THEN 'slight' WHEN kappa < 0.4 THEN 'fair' WHEN kappa < 0.6 THEN 'moderate' WHEN kappa < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS text FROM k""")
def weighted_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = A.pair_counts(rated(spark, sf_dir), "a", "b")
    one = A.weighted_kappa(counts, 1, [1, 2, 3, 4, 5]).withColumn("power", F.lit(1))
    both = one.unionByName(A.weighted_kappa(counts, 2).withColumn("power", F.lit(2)))
    return both.select("power", r("kappa").alias("kappa"), X.kappa_text(F.col("kappa")).alias("text"))


@query(f"""WITH {RATED} SELECT count(*) AS n, round_even(avg(CASE WHEN a = b THEN 1.0 ELSE 0 END), 6) AS exact, round_even(avg(CASE WHEN abs(a - b) <= 1 THEN 1.0 ELSE 0 END), 6) AS within_1,
round_even(avg(abs(a - b)), 6) AS mae, round_even(corr(a, b), 6) AS pearson FROM rated""")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.agreement(rated(spark, sf_dir), "a", "b")
    return out.withColumns({c: r(c) for c in ("exact", "within_1", "mae", "pearson")})


@query(f"""WITH {RATED}, c AS (SELECT a = b AS hit, o_totalprice / 600000 AS conf FROM rated JOIN orders USING (o_orderkey))
SELECT least(floor(conf * 10) + 1, 10)::INT AS bin, count(*) AS n, round_even(avg(conf), 6) AS confidence, round_even(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS accuracy FROM c GROUP BY 1""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rated(spark, sf_dir).join(read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 600000).alias("conf")), "o_orderkey")
    return A.calibration(rows, "conf", F.col("a") == F.col("b")).withColumns({c: r(c) for c in ("confidence", "accuracy")})


@query(f"""WITH {RATED} SELECT o_custkey, round_even(avg(a), 0)::INT AS a, round_even(avg(CASE WHEN b < 5 THEN b END), 0)::INT AS b FROM rated GROUP BY o_custkey""")
def mean_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings as text, the highest unknown ('U')."""
    rows = rated(spark, sf_dir).select("o_custkey", F.col("a").cast("string").alias("a"), F.when(F.col("b") < 5, F.col("b").cast("string")).otherwise("U").alias("b"))
    return A.mean_rating(rows, ["o_custkey"], ["a", "b"])


@query("""WITH r AS (SELECT source, 1 - quality AS a, toxic AS b FROM labels JOIN documents USING (doc_id)), m AS (SELECT source FROM r GROUP BY source HAVING count(DISTINCT a) > 1),
c AS (SELECT source, a, b, count(*) AS n FROM r JOIN m USING (source) GROUP BY ALL),
s AS (SELECT source, k AS label, coalesce(sum(n) FILTER (WHERE a = k AND b = k), 0) AS hit, coalesce(sum(n) FILTER (WHERE a = k), 0) AS sup, coalesce(sum(n) FILTER (WHERE b = k), 0) AS said FROM c, (SELECT unnest([0, 1]) AS k) GROUP BY ALL)
SELECT source, round_even(avg(coalesce(2 * hit / nullif(said + sup, 0), 0)), 6) AS macro_f1, sum(sup)::BIGINT AS n FROM s WHERE sup + said > 0 GROUP BY source""")
def per_group_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("source", (1 - F.col("quality")).alias("a"), F.col("toxic").alias("b"))
    counts = A.pair_counts(rows, "a", "b", ["source"])
    mixed = counts.groupBy("source").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo < hi").select("source")
    scores = A.class_scores(joins.members(counts, mixed, "source"), ["source"])
    return A.summary(scores, ["source"]).select("source", r("macro_f1").alias("macro_f1"), "n")


@query("""WITH e AS (SELECT label, list_transform(embedding[1:3], lambda x: exp(4 * x::DOUBLE)) AS x FROM embeddings), p AS (SELECT label, list_transform(x, lambda y: y / list_sum(x)) AS p FROM e),
m AS (SELECT label, [avg(p[1]), avg(p[2]), avg(p[3])] AS m FROM p GROUP BY label)
SELECT label, (list_position(m, list_max(m)) - 1)::INT AS pred, round_even(list_max(m), 6) AS confidence FROM m""")
def mean_proba_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform(F.slice("embedding", 1, 3), lambda v: F.exp(4 * v.cast("double")))
    rows = read(spark, sf_dir, "embeddings").select("label", x.alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    out = learn.mean_shares(rows.withColumn("p", F.transform("x", lambda v: v / total)), ["label"], "p", [0, 1, 2])
    return out.withColumn("confidence", r("confidence"))


@query("""SELECT vec_id, round_even(CASE WHEN vec_id % 3 = 0 THEN embedding[1]::DOUBLE WHEN vec_id % 3 = 1 THEN embedding[2]::DOUBLE ELSE (embedding[1]::DOUBLE + embedding[2]::DOUBLE) / 2 END, 6) AS first FROM embeddings""")
def late_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side and top cameras' shares; a third of the rows lacks either."""
    one = lambda i: F.array(F.col("embedding")[i].cast("double"))
    k = F.col("vec_id") % 3
    fused = learn.fused_views(F.when(k != 1, one(0)), F.when(k != 0, one(1)))
    return read(spark, sf_dir, "embeddings").select("vec_id", r(fused[0]).alias("first"))


_FUSE = """mine AS (SELECT source, doc_id AS seg_id, n_chars::DOUBLE AS start_s, n_chars + 8.0 AS end_s, CASE WHEN quality + toxic < 2 THEN quality + toxic ELSE CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END END AS floating_outcome,
  'mine' AS label_source, CASE doc_id % 4 WHEN 2 THEN 1.0 WHEN 1 THEN 0.6 WHEN 0 THEN 0.25 ELSE 0.8 END AS sample_weight FROM labels JOIN documents USING (doc_id) WHERE n_chars >= 200),
rate AS (SELECT DISTINCT source AS participant, CAST(substr(source, 4) AS INT) % 4 AS y FROM documents WHERE CAST(substr(source, 4) AS INT) % 5 = 0),
win AS (SELECT source, start_s, y, hit, bool_or(hit) OVER (PARTITION BY source) AS any_hit FROM (
  SELECT source, (doc_id % 100)::DOUBLE AS start_s, y, doc_id % 100 + 1.5 >= 30 AND doc_id % 100 + 1.5 < 60 AS hit FROM documents JOIN rate ON participant = source)),
expert AS (SELECT source, start_s::BIGINT AS seg_id, start_s, start_s + 3 AS end_s, y AS floating_outcome, 'expert' AS label_source, 5.0 AS sample_weight FROM win WHERE hit OR NOT any_hit)"""


@query(f"""WITH {_FUSE}, f AS (SELECT * FROM mine WHERE source NOT IN (SELECT source FROM expert) UNION ALL SELECT * FROM expert)
SELECT source, label_source, floating_outcome::INT AS floating_outcome, count(*) AS n, round_even(sum(sample_weight::DOUBLE), 6) AS weight, round_even(sum(start_s), 6) AS starts FROM f GROUP BY ALL""")
def label_fuse_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    mine = read(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "source", F.col("source").alias("participant"), F.col("doc_id").alias("seg_id"), F.col("n_chars").cast("double").alias("start_s"), (F.col("n_chars") + 8.0).alias("end_s"), (F.col("quality") + F.col("toxic")).alias("float_label"),
        F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("passive_active"), (F.col("doc_id") % 4).alias("label_confidence"), F.when(F.col("n_chars") < 200, "1").when(F.col("doc_id") % 2 == 0, "0").alias("exclude"))
    number = F.substring("source", 4, 9).cast("int")
    expert = docs.filter(number % 5 == 0).select(F.col("source").alias("participant"), (number % 4).alias("floating_outcome")).distinct().withColumns({c: F.lit(None).cast("double") for c in ("window_start", "window_end")})
    start = (F.col("doc_id") % 100).cast("double")
    window_rows = docs.select("source", F.col("source").alias("participant"), start.alias("start_s"), (start + 3).alias("end_s"))
    experts = labels.expert_labels(expert, window_rows).withColumn("participant", F.col("source"))
    fused = labels.fused_labels(labels.rater_labels(mine), experts)
    return fused.groupBy("source", "label_source", F.col("floating_outcome").cast("int").alias("floating_outcome")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("sample_weight")).alias("weight"), r(F.sum("start_s")).alias("starts"))


@query(f"""WITH {RULES}, {INTERVALS}, a AS (
  SELECT user_id, start_s, any_value(float_pred) AS pred, max_by(label, ord) AS label FROM ruled JOIN intervals USING (user_id) WHERE start_s + 36 >= a AND start_s + 36 < b GROUP BY user_id, start_s
), v AS (SELECT user_id, pred, count(*) AS n FROM a GROUP BY user_id, pred QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, pred) = 1),
l AS (SELECT user_id, label, count(*) AS n FROM a GROUP BY user_id, label QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, label) = 1)
SELECT a.user_id, any_value(v.pred)::INT AS voted, any_value(l.label)::INT AS true_class, count(*) AS n, round_even(avg(CASE WHEN a.pred = v.pred THEN 1.0 ELSE 0 END), 6) AS share
FROM a JOIN v ON v.user_id = a.user_id JOIN l ON l.user_id = a.user_id GROUP BY a.user_id""")
def video_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = ruled(spark, sf_dir).select("user_id", "start_s", F.col("float_pred").alias("pred"), (F.col("start_s") + 36).alias("centre"))
    attached = joins.attach_labels(points, intervals(spark, sf_dir), "user_id", "centre", "a", "b", "ord", "label", None, ["user_id", "start_s", "pred"], slot=48.0)
    return learn.video_vote(attached, "user_id", "label").withColumn("share", r("share"))


@query("""WITH c AS (SELECT label, vec_id % 7 AS source, count(*) AS n FROM embeddings GROUP BY ALL)
SELECT label, sum(n)::BIGINT AS n, arg_max(source, n * 100 - source) AS dominant, round_even(max(n) / sum(n), 6) AS share FROM c GROUP BY label""")
def cluster_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 7).alias("source"))
    return stats.dominance(rows, "label", "source").withColumn("share", r("share"))


@query("""SELECT label, count(*) AS n, round_even(median(embedding[1]::DOUBLE), 2) AS x_med, round_even(stddev_pop(embedding[1]::DOUBLE), 2) AS x_sd, round_even(median(embedding[2]::DOUBLE), 2) AS y_med, round_even(stddev_pop(embedding[2]::DOUBLE), 2) AS y_sd FROM embeddings GROUP BY label""")
def cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return C.cluster_profile(rows, "label", ["x", "y"])


@query(f"""WITH {FEATURES}, f AS (SELECT *, user_id % 2 AS view, user_id % 8 AS cluster FROM features),
v AS (SELECT view, median(angle) AS va, median(arm + leg) AS ve FROM f GROUP BY view), c AS (SELECT view, cluster, round_even(median(angle), 2) AS a, round_even(median(arm), 2) + round_even(median(leg), 2) AS e FROM f GROUP BY ALL)
SELECT c.view, cluster, CASE WHEN a < va AND NOT e > ve THEN '{X.EFFICIENT}' WHEN a < va AND e > ve THEN '{X.ASSISTED}' WHEN NOT a < va AND e > ve THEN '{X.RECOVERING}' ELSE '{X.INACTIVE}' END AS name FROM c JOIN v ON v.view = c.view""")
def named_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).withColumns({"view": F.col("user_id") % 2, "cluster": F.col("user_id") % 8})
    return C.named_clusters(rows, "cluster", "view", "angle", "arm", "leg")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The whole embeddings as columns, as many as the longest has values, and the columns' names."""
    rows = read(spark, sf_dir, "embeddings")
    names = [f"e{i}" for i in range(rows.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    return rows.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(name) for i, name in enumerate(names)]), names


@query()
def cluster_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _vectors(spark, sf_dir)
    return C.kmeans(rows, names, 6).select("vec_id", "cluster")


@query()
def pca2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _vectors(spark, sf_dir)
    return C.principal_components(rows, names).select("vec_id", "pc1", "pc2")


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), d AS (
  SELECT a.vec_id, a.label, b.label AS other, avg(list_distance(a.v, b.v)) AS m FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL
), s AS (SELECT e.vec_id, e.label, max(m) FILTER (WHERE other = e.label) AS a, min(m) FILTER (WHERE other <> e.label) AS b FROM e LEFT JOIN d ON d.vec_id = e.vec_id GROUP BY ALL)
SELECT vec_id, label, round_even(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM s""")
def silhouette_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.silhouette(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding").withColumn("silhouette", r("silhouette"))


_CENTRES = """e AS (SELECT label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS d FROM e),
b AS (SELECT label, d, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS w FROM x GROUP BY ALL), c AS (SELECT label, list(m ORDER BY d) AS m FROM b GROUP BY label)"""


@query(f"""WITH {_CENTRES}, s AS (SELECT e.label, avg(list_distance(v, m)) AS s, any_value(m) AS m FROM e JOIN c USING (label) GROUP BY e.label)
SELECT round_even(avg(w), 6) AS davies_bouldin FROM (SELECT a.label, max((a.s + b.s) / list_distance(a.m, b.m)) AS w FROM s a JOIN s b ON a.label <> b.label GROUP BY a.label)""")
def davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.davies_bouldin(read(spark, sf_dir, "embeddings"), "label", "embedding").select(r("davies_bouldin").alias("davies_bouldin"))


@query(f"""WITH {_CENTRES}, g AS (SELECT d, sum(m * n) / sum(n) AS g FROM b GROUP BY d), p AS (SELECT label, any_value(n) AS n, sum(w) AS w, sum(n * (m - g) ** 2) AS q FROM b JOIN g USING (d) GROUP BY label)
SELECT round_even((sum(q) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 4) AS calinski_harabasz FROM p""")
def calinski_harabasz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.calinski_harabasz(read(spark, sf_dir, "embeddings"), "label", "embedding").select(r("calinski_harabasz", 4).alias("calinski_harabasz"))


@query(r"""WITH f AS (SELECT '/data/' || source || '/' || CASE doc_id % 4 WHEN 0 THEN 'P' || doc_id || '_T' || doc_id % 7 || '_side_front' WHEN 1 THEN doc_id || ' Side top' WHEN 2 THEN 'p0' || doc_id || ' rear T' || doc_id % 13 ELSE 'x side front' END || '.mp4' AS path, *,
  CASE WHEN lang <> 'en' THEN 25 + doc_id % 10 / 7 ELSE 0 END AS rate, CASE WHEN lang IS NOT NULL THEN n_chars ELSE 0 END AS frame_count FROM documents),
s AS (SELECT *, regexp_replace(regexp_extract(path, '[^/]*$'), '\.mp4$', '') AS stem FROM f),
p AS (SELECT *, CASE WHEN regexp_matches(stem, '[Pp]\d') THEN printf('P%02d', CAST(regexp_extract(stem, '[Pp](\d+)', 1) AS BIGINT)) WHEN regexp_matches(stem, '^\s*\d') THEN printf('V%02d', CAST(regexp_extract(stem, '^\s*(\d+)', 1) AS BIGINT)) ELSE 'P??' END AS pid,
  CASE WHEN regexp_matches(stem, '[Tt]\d{1,2}([^A-Za-z0-9]|$)') THEN printf('T%02d', CAST(regexp_extract(stem, '[Tt](\d{1,2})([^A-Za-z0-9]|$)', 1) AS BIGINT)) ELSE 'T01' END AS trial,
  CASE WHEN contains(lower(stem), 'top') THEN 'top' WHEN contains(lower(stem), 'side') AND contains(lower(stem), 'rear') THEN 'side_rear' WHEN contains(lower(stem), 'side') AND contains(lower(stem), 'front') THEN 'side_front'
    WHEN contains(lower(stem), 'front') THEN 'front' WHEN contains(lower(stem), 'rear') THEN 'side_rear' ELSE 'unknown' END AS view,
  CASE WHEN rate > 0 THEN round_even(frame_count / rate, 1) ELSE 0 END AS secs FROM s)
SELECT pid || '_' || trial || '_' || view AS video_id, pid AS participant_id, trial AS trial_id, view, regexp_extract(path, '[^/]*$') AS filename, round_even(coalesce(rate, 0), 2) AS fps, coalesce(secs, 0)::DOUBLE AS duration_s,
  640 AS width, 480 AS height, coalesce(frame_count, 0)::INT AS frames, 'back_float' AS exercise, coalesce(frame_count > 0 AND secs > 0, false) AS readable, sha256(text) AS sha256 FROM p""")
def manifest_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    name = (F.when(k % 4 == 0, F.concat(F.lit("P"), k, F.lit("_T"), k % 7, F.lit("_side_front"))).when(k % 4 == 1, F.concat(k, F.lit(" Side top")))
            .when(k % 4 == 2, F.concat(F.lit("p0"), k, F.lit(" rear T"), k % 13)).otherwise("x side front"))
    docs = read(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("/data/"), "source", F.lit("/"), name, F.lit(".mp4")))
    # Names may repeat, so each row brings its probe along.
    rows = docs.select("path", "text", F.when(F.col("lang") != "en", 25 + k % 10 / 7).otherwise(0.0).alias("fps"), F.lit(640).alias("width"), F.lit(480).alias("height"),
                       F.when(F.col("lang").isNotNull(), F.col("n_chars")).otherwise(0).alias("frames"))
    return readers.manifest(rows, "path", "text", ["fps", "width", "height", "frames"], rounded=scaled)


@query("""SELECT sha256(text) AS sha256, count(*) AS n, string_agg('d' || doc_id, ',' ORDER BY 'd' || doc_id) AS names FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.concat(F.lit("d"), "doc_id").alias("name"))
    return readers.duplicate_ids(docs, "sha256", "name")


@query(r"""WITH p AS (SELECT c_name, CASE c_custkey % 4 WHEN 0 THEN 'a/b/P' || c_custkey || '_x.csv' WHEN 1 THEN c_custkey || ' side.csv' WHEN 2 THEN 'P2024010112345' || c_custkey || '_y.csv' ELSE 'Cust' || chr((97 + c_custkey % 26)::INT) || 'xyzw.v1.csv' END AS path FROM customer),
s AS (SELECT *, regexp_extract(path, '[^/]*$') AS base, regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '') AS stem FROM p)
SELECT c_name, CASE WHEN regexp_matches(stem, '[Pp]\d') THEN printf('P%02d', CAST(regexp_extract(stem, '[Pp](\d+)', 1) AS HUGEINT)) WHEN regexp_matches(stem, '^\s*\d') THEN printf('V%02d', CAST(regexp_extract(stem, '^\s*(\d+)', 1) AS HUGEINT)) ELSE left(stem, 8) END AS pid,
CASE WHEN regexp_matches(base, '^[Pp]\d') THEN 'P' || CAST(regexp_extract(base, '^[Pp](\d+)', 1) AS HUGEINT) ELSE base END AS short FROM s""")
def participant_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = (F.when(k % 4 == 0, F.concat(F.lit("a/b/P"), k, F.lit("_x.csv"))).when(k % 4 == 1, F.concat(k, F.lit(" side.csv"))).when(k % 4 == 2, F.concat(F.lit("P2024010112345"), k, F.lit("_y.csv")))
            .otherwise(F.concat(F.lit("Cust"), F.char(97 + k % 26), F.lit("xyzw.v1.csv"))))
    rows = read(spark, sf_dir, "customer").withColumn("path", name)
    return rows.select("c_name", X.participant_id(F.col("path")).alias("pid"), X.participant_id(F.col("path"), "short").alias("short"))


@query(r"""SELECT c_custkey, CAST(regexp_extract(c_name, '(\d+)') AS BIGINT) AS number, c_name FROM customer ORDER BY number DESC, c_name LIMIT 20""")
def natural_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select("c_custkey", X.natural_key(F.col("c_name")).alias("number"), "c_name")
    return rows.orderBy(F.desc("number"), "c_name").limit(20)


@query("""SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k, round_even(avg(value), 6) AS mean FROM events GROUP BY event_type""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_type", "value", F.from_json("props", "k long")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"), r(F.avg("value")).alias("mean"))


@query("""SELECT c_mktsegment, '{"segment":"' || c_mktsegment || '","customers":' || count(*) || '}' AS document FROM customer GROUP BY c_mktsegment""")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"))
    return counts.select("c_mktsegment", F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), "customers")).alias("document"))


@query("""WITH u AS (SELECT doc_id AS id, lang, source, NULL AS url FROM documents UNION ALL SELECT page_id, NULL, NULL, url FROM pages)
SELECT lang, count(*) AS n, count(url) AS urls, count(DISTINCT source) AS sources, count(DISTINCT id) FILTER (WHERE id NOT IN (SELECT doc_id FROM labels)) AS unlabelled FROM u GROUP BY lang""")
def multi_source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    both = nan_to_null(docs.unionByName(pages, allowMissingColumns=True))
    marks = both.select("id").subtract(read(spark, sf_dir, "labels").select("doc_id")).withColumn("free", F.lit(1))
    return both.join(marks, "id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("url").alias("urls"), F.countDistinct("source").alias("sources"), F.countDistinct(F.when(F.col("free") == 1, F.col("id"))).alias("unlabelled"))


@query("""SELECT least(floor(value / 25) + 1, 20)::INT AS bin, count(*) AS n FROM events WHERE value >= 0 AND value <= 500 GROUP BY 1""")
def histogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.histogram(read(spark, sf_dir, "events"), "value", 0.0, 500.0)


@query(f"""WITH {FEATURES} SELECT printf('P%02d__%04d.mp4', user_id, trunc(round_even(greatest(0, start_s + 1.5 - 4), 1))::INT) AS clip, round_even(greatest(0, start_s + 1.5 - 4), 1) AS clip_start, round_even(greatest(0, start_s + 1.5 - 4), 1) + 8 AS clip_end FROM features""")
def clip_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = X.clip_window(F.col("start_s"))
    rows = features(spark, sf_dir).withColumns(bounds)
    return rows.select(X.clip_file(F.format_string("P%02d", "user_id"), F.col("clip_start")).alias("clip"), "clip_start", "clip_end")


@query("""SELECT o_orderkey, CASE WHEN a IN (0, 1) THEN a WHEN a = 2 THEN CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 2 END END AS outcome, CASE WHEN a IN (0, 1) THEN a WHEN a IN (2, 3) THEN 2 END AS cumulative,
CASE WHEN o_orderkey % 5 < 3 THEN a + (o_orderkey % 5)::INT END AS total, '"' || replace(o_orderpriority, '"', '""') || '"' AS quoted, regexp_replace(o_orderpriority, '[^A-Za-z0-9._-]', '_', 'g') AS safe
FROM (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS a FROM orders)""")
def recode_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").withColumn("a", F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    a, k = F.col("a"), F.col("o_orderkey")
    return rows.select("o_orderkey", X.floating_outcome(a, F.when(k % 3 == 0, 0).otherwise(1)).alias("outcome"), X.cumulative_class(a).alias("cumulative"),
                       X.score_total(a, F.when(k % 5 < 3, (k % 5).cast("int"))).cast("int").alias("total"), X.csv_quoted(F.col("o_orderpriority")).alias("quoted"), X.sanitized(F.col("o_orderpriority")).alias("safe"))


def _classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Three ordered classes of vectors, in groups of participants, and the names of the features."""
    rows, names = _vectors(spark, sf_dir)
    return rows.select("vec_id", (F.col("label") % 3).cast("int").alias("y"), (F.col("vec_id") % 10).alias("participant"), *names), names


@query()
def grouped_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _classes(spark, sf_dir)
    out = learn.out_of_fold(rows, learn.grouped_folds(rows, "participant", 5), "participant", "y", names, learn.challengers()["tree"])
    return out.select("vec_id", "fold", "y", "pred", "confidence")


@query()
def ordinal_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _classes(spark, sf_dir)
    out = learn.out_of_fold(rows, learn.leave_group_out(rows, "participant"), "participant", "y", names, learn.challengers()["ordinal"])
    return out.select("vec_id", "fold", "y", "pred", r("confidence").alias("confidence"))


@query("""SELECT c_name, min(p_name || '/' || p_brand || '.mp4') AS path FROM (SELECT DISTINCT left(p_name, 1 + (p_partkey % 10)::INT) AS c_name FROM part) s JOIN part ON starts_with(p_name, c_name) GROUP BY c_name""")
def prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    stems = part.select(F.expr("left(p_name, 1 + int(p_partkey % 10))").alias("c_name")).distinct()
    paths = part.select(F.concat("p_name", F.lit("/"), "p_brand", F.lit(".mp4")).alias("path")).distinct()
    return joins.prefix_match(stems, paths, "c_name", "path")


@query("""SELECT l_returnflag, l_linestatus, l_shipdate::DATE::VARCHAR AS day, round_even(median(v), 6) AS pooled, round_even(max(rng), 6) AS rng, round_even(max(level), 6) AS level, bool_or(sd < 0.06 * 500) AS confident
FROM (SELECT l_returnflag, l_linestatus, l_shipdate, unnest([l_quantity, l_tax * 100]) AS v FROM lineitem) JOIN (
  SELECT l_returnflag, l_linestatus, l_shipdate, quantile_cont(l_quantity, 0.9) - quantile_cont(l_quantity, 0.1) AS rng, median(l_quantity) AS level, stddev_pop(l_quantity) AS sd FROM lineitem GROUP BY ALL) USING (l_returnflag, l_linestatus, l_shipdate)
GROUP BY ALL""")
def pooled_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumns({"tax": F.col("l_tax") * 100, "day": F.date_format("l_shipdate", "yyyy-MM-dd")})
    out = rows.groupBy("l_returnflag", "l_linestatus", "day").agg(stats.pooled_median("l_quantity", "tax").alias("pooled"), stats.percentile_range("l_quantity").alias("rng"), *stats.level_vote("l_quantity", F.lit(500.0)))
    return out.withColumns({c: r(c) for c in ("pooled", "rng", "level")})


@query(f"""WITH {FEATURES}, j AS (SELECT user_id, start_s, start_s < 240 AND start_s + 72 > 120 AS hit FROM features)
SELECT user_id, start_s FROM (SELECT *, bool_or(hit) OVER (PARTITION BY user_id) AS any_hit FROM j) WHERE hit OR NOT any_hit""")
def overlap_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).select("user_id", "start_s")
    return joins.inside_or_all(rows, ["user_id"], joins.overlapping(F.col("start_s"), F.col("start_s") + 72, 120, 240))


@query("""SELECT c_custkey, unnest([0, 1, 2]) AS part, unnest([a, a + 10, a + 20]) AS start, unnest([a + 10, a + 20, b]) AS end FROM (SELECT c_custkey, (c_custkey % 40)::DOUBLE AS a, (c_custkey % 40)::DOUBLE + 30 + c_nationkey AS b FROM customer)""")
def expert_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("c_custkey") % 40).cast("double")
    return read(spark, sf_dir, "customer").select("c_custkey", F.inline(joins.thirds(start, start + 30 + F.col("c_nationkey"))))


_EVEN = "list_transform(range(least(3, n)), lambda j: CASE WHEN least(3, n) > 1 THEN round_even(j * (n - 1)::DOUBLE / (least(3, n) - 1), 0)::BIGINT ELSE 0 END)"


@query(f"""WITH {FEATURES}, r AS (SELECT user_id, start_s, slope AS score FROM features), reviewed AS (SELECT r.* FROM r WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')),
a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, start_s) = 1),
b AS (SELECT r.* FROM r JOIN a USING (user_id) WHERE abs(r.start_s - a.start_s) >= 72 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY r.score DESC, r.start_s) = 1),
c AS (SELECT r.* FROM r JOIN a USING (user_id) JOIN b USING (user_id) WHERE abs(r.start_s - a.start_s) >= 72 AND abs(r.start_s - b.start_s) >= 72 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY r.score DESC, r.start_s) = 1),
minority AS (SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) ORDER BY score DESC, user_id, start_s LIMIT 40),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_s) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM r WHERE user_id NOT IN (SELECT user_id FROM reviewed)),
placed AS (SELECT user_id, list([start_s] ORDER BY start_s) AS s FROM o WHERE list_contains({_EVEN}, i) GROUP BY user_id),
near AS (SELECT s.user_id, s.s, coalesce(list(m.start_s) FILTER (WHERE m.start_s IS NOT NULL), []) AS taken FROM placed s LEFT JOIN minority m ON m.user_id = s.user_id GROUP BY s.user_id, s.s),
grown AS (SELECT user_id, len(taken) AS k, list_reduce(list_concat([taken], s), lambda acc, v: CASE WHEN len(list_filter(acc, lambda p: abs(p - v[1]) < 72)) > 0 THEN acc ELSE list_concat(acc, v) END) AS all_places FROM near),
fresh AS (SELECT user_id, unnest(all_places[k + 1:]) AS start_s FROM grown),
unlabeled AS (SELECT r.* FROM fresh JOIN r USING (user_id, start_s) ORDER BY user_id, start_s LIMIT 30),
every AS (SELECT *, 'minority' AS reason FROM minority UNION ALL SELECT *, 'unlabeled' FROM unlabeled UNION ALL SELECT *, 'rereview' FROM reviewed)
SELECT user_id, start_s, score, reason, start_s::INT AS seg_id FROM every""")
def second_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows scored by slope; users of one segment are reviewed already."""
    rows = features(spark, sf_dir).select("user_id", "start_s", F.col("slope").alias("score"))
    known = read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return sampling.second_round(rows, joins.members(rows, known, "user_id"), "user_id", "start_s", "score", 40, 30, 3, 72.0)


@query("""WITH a AS (SELECT o_custkey || '__' || o_orderkey % 7 AS clip, substr(o_orderpriority, 1, 1)::INT AS a FROM orders WHERE o_orderstatus <> 'F'),
b AS (SELECT o_custkey || '__' || o_orderkey % 7 AS clip, least(floor(o_totalprice / 100000) + 1, 5)::INT AS b FROM orders WHERE o_totalprice > 20000)
SELECT a, b, count(*) AS n, count(DISTINCT clip) AS clips FROM a JOIN b USING (clip) GROUP BY a, b""")
def double_rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters of the clips of customers; one excludes some, the other leaves some without a rating."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 7).alias("seg_id"), "o_orderstatus", "o_totalprice", "o_orderpriority")
    first = rows.withColumns({"y": F.substring("o_orderpriority", 1, 1).cast("int"), "exclude": F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "0")})
    second = rows.withColumn("y", F.when(F.col("o_totalprice") > 20000, F.least(F.floor(F.col("o_totalprice") / 100000) + 1, F.lit(5))))
    return A.double_rated(first, second, "y").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("clip").alias("clips"))


@query("""WITH e AS (SELECT printf('P%02d', c_custkey) AS participant, unnest(['activity', 'airway']) AS criterion, unnest([c_nationkey % 3, CASE WHEN c_acctbal > 0 THEN c_nationkey % 5 END])::INT AS expert FROM customer),
l AS (SELECT printf('P%02d', o_custkey) AS participant, round_even(avg(substr(o_orderpriority, 1, 1)::INT - 1), 0)::INT AS activity, round_even(avg(CASE WHEN o_totalprice < 300000 THEN o_orderkey % 5 END), 0)::INT AS airway FROM orders GROUP BY o_custkey),
m AS (SELECT participant, unnest(['activity', 'airway']) AS criterion, unnest([activity, airway]) AS labeller FROM l)
SELECT participant, criterion, expert, labeller FROM e JOIN m USING (participant, criterion) WHERE expert IS NOT NULL AND labeller IS NOT NULL""")
def expert_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expert's ratings of customers beside the mean of a labeller's clips, whose ids are written otherwise."""
    expert = read(spark, sf_dir, "customer").select(F.concat(F.lit("P"), "c_custkey").alias("participant"), (F.col("c_nationkey") % 3).alias("activity"), F.when(F.col("c_acctbal") > 0, F.col("c_nationkey") % 5).alias("airway"))
    clips = read(spark, sf_dir, "orders").select(F.concat(F.lit("clip of p00"), "o_custkey").alias("participant"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("activity"),
                                                 F.when(F.col("o_totalprice") < 300000, (F.col("o_orderkey") % 5).cast("string")).otherwise("U").alias("airway"))
    return A.expert_pairs(expert, clips, ["activity", "airway"])


@query(f"""WITH {RULES}, given AS (SELECT c_custkey AS user_id, unnest(['outcome', 'trunk']) AS criterion, unnest([c_nationkey % 3, CASE WHEN c_acctbal > 0 THEN c_nationkey % 3 END])::INT AS expert FROM customer),
told AS (SELECT user_id, start_s, unnest(['outcome', 'trunk', 'outcome', 'trunk']) AS criterion, unnest(['rules', 'rules', 'bands', 'bands']) AS model,
  unnest([float_pred, CASE alignment WHEN 'horizontal' THEN 2 WHEN 'angled' THEN 1 ELSE 0 END, CASE effort_level WHEN 'low' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END, CASE WHEN angle < 40 THEN 2 ELSE 0 END])::INT AS pred FROM ruled),
j AS (SELECT told.*, expert, start_s < 240 AND start_s + 72 > 120 AS hit FROM told JOIN given USING (user_id, criterion) WHERE expert IS NOT NULL),
c AS (SELECT * FROM (SELECT *, bool_or(hit) OVER (PARTITION BY user_id) AS any_hit FROM j) WHERE hit OR NOT any_hit),
v AS (SELECT user_id, criterion, model, expert, pred FROM c GROUP BY user_id, criterion, model, expert, pred QUALIFY row_number() OVER (PARTITION BY user_id, criterion, model ORDER BY count(*) DESC, pred) = 1)
SELECT criterion, model, count(*) FILTER (WHERE pred = expert) AS exact, count(*) AS n, round_even(avg(abs(pred - expert)), 6) AS mae FROM v GROUP BY criterion, model""")
def expert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' votes over the rated stretch beside an expert's ratings, by criterion."""
    rows = ruled(spark, sf_dir)
    grade = lambda c, two, one: F.when(F.col(c) == two, 2).when(F.col(c) == one, 1).otherwise(0)
    said = F.array(*[F.struct(F.lit(c).alias("criterion"), F.lit(m).alias("model"), p.cast("int").alias("pred")) for c, m, p in (
        ("outcome", "rules", F.col("float_pred")), ("trunk", "rules", grade("alignment", "horizontal", "angled")), ("outcome", "bands", grade("effort_level", "low", "moderate")),
        ("trunk", "bands", F.when(F.col("angle") < 40, 2).otherwise(0)))])
    predictions = rows.select(F.col("user_id").alias("participant"), "start_s", (F.col("start_s") + 72).alias("end_s"), F.inline(said))
    ratings = F.array(F.struct(F.lit("outcome").alias("criterion"), (F.col("c_nationkey") % 3).alias("rating")), F.struct(F.lit("trunk").alias("criterion"), F.when(F.col("c_acctbal") > 0, F.col("c_nationkey") % 3).alias("rating")))
    expert = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("participant"), F.inline(ratings))
    return learn.expert_summary(learn.expert_table(expert, predictions, 120.0, 240.0)).withColumn("mae", r("mae"))
