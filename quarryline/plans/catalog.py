"""Queries over the driver's tables, one or more for each operator, with their DuckDB SQL.

The roles: ``events`` are flights (user_id the aircraft, event_type the carrier, value the delay),
lineitem links suppliers to parts, conversations and documents are the text, nation by year of
orders is the panel, events per type and day are the series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import columns as C
from quarryline.operators import fits, graph, models, relational as R, segments, series as Y, text as T
from quarryline.plans import solve
from quarryline.sources import files

#: name: (function of (spark, sf_dir), DuckDB SQL or None)
CATALOG: dict[str, tuple] = {}


def t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        CATALOG[name] = (f, sql)
        return f

    return add


def rows(s: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return s.createDataFrame(values, schema)


# ---- sources and sinks
@query("s1_lines", "SELECT count(*) AS n, sum(length(r_name))::BIGINT AS chars FROM customer, region WHERE c_nationkey % 5 = r_regionkey")
def _(s, d):
    c = t(s, d, "customer").join(F.broadcast(t(s, d, "region")), F.expr("c_nationkey % 5 = r_regionkey")).select("r_name")
    path = files.shared_path(s, "lines")
    c.write.text(path)
    return files.read_lines(s, path).agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


@query("s2_labelled_docs", "SELECT c_mktsegment AS subject, count(*) AS n, sum((c_nationkey % 2))::BIGINT AS ones FROM customer GROUP BY 1")
def _(s, d):
    path = files.shared_path(s, "labelled")
    files.write_tsv(t(s, d, "customer").select(F.col("c_custkey").cast("string"), (F.col("c_nationkey") % 2).cast("int"), "c_mktsegment", "c_name"), path)
    return files.read_labelled_docs(s, path).groupBy("subject").agg(F.count("*").alias("n"), F.sum("label").alias("ones"))


@query("s3_ngrams", "SELECT p_brand AS ngram, sum(p_size)::BIGINT AS cnt FROM part GROUP BY 1")
def _(s, d):
    path = files.shared_path(s, "ngrams")
    files.write_tsv(t(s, d, "part").select("p_brand", "p_size", F.lit(1), F.lit(1)), path)
    return files.read_ngrams(s, path).groupBy("ngram").agg(F.sum("cnt").alias("cnt"))


def edges(s, d) -> DataFrame:
    """Supplier to part links in one id space, with counts; parts without links on are dangling."""
    return t(s, d, "lineitem").groupBy((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + F.when(F.col("l_partkey") % 3 == 0, 0).otherwise(1)).alias("dst")).agg(F.count("*").alias("weight"))


E = "SELECT l_suppkey * 2 AS src, l_partkey * 2 + CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 1 END AS dst, count(*) AS weight FROM lineitem GROUP BY 1, 2"
NODES = "SELECT src AS id FROM e UNION SELECT dst FROM e"


@query("s4_adjacency", f"SELECT * FROM ({E})")
def _(s, d):
    lines = edges(s, d).groupBy("src").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(F.lit("'"), "dst", F.lit("': "), "weight")), ", "), F.lit("}")).alias("links"))
    path = files.shared_path(s, "adjacency")
    lines.select(F.concat_ws("\t", "src", "links").alias("value")).write.text(path)
    return files.read_adjacency(s, path)


@query("s5_tagged_csvs", "SELECT CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS flag, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY 1")
def _(s, d):
    paths = {files.shared_path(s, "csv"): 1, files.shared_path(s, "csv"): 0}
    for p, k in paths.items():
        t(s, d, "supplier").where((F.col("s_acctbal") > 0) == F.lit(bool(k))).write.csv(p, sep=";", header=True)
    return files.read_tagged_csvs(s, paths, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").groupBy("flag").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))


@query("s6_read_table", "SELECT r_regionkey, r_name FROM region")
def _(s, d):
    return files.read_table(s, f"{d}/region.parquet")


@query("s7_write_parquet", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    return files.write_parquet(t(s, d, "orders"), files.shared_path(s, "orders"), ["o_orderstatus"]).groupBy(F.col("o_orderstatus").cast("string").alias("o_orderstatus")).agg(F.count("*").alias("n"))


@query("s8_write_tsv", "SELECT n_nationkey, n_name FROM nation")
def _(s, d):
    path = files.shared_path(s, "tsv")
    files.write_tsv(t(s, d, "nation").select("n_nationkey", "n_name"), path)
    return files.read_tsv(s, path, "n_nationkey int, n_name string")


# ---- cleaning
query("p1_select_drop", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")(lambda s, d: t(s, d, "orders").drop("o_orderdate", "o_orderpriority").select("o_orderkey", "o_custkey", "o_orderstatus"))
query("p2_filter_rows", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 25 AND l_returnflag IN ('R', 'A') AND l_discount IS NOT NULL")(lambda s, d: t(s, d, "lineitem").where("l_quantity >= 10 AND l_quantity < 25 AND l_returnflag IN ('R', 'A') AND l_discount IS NOT NULL").select("l_orderkey", "l_linenumber"))
query("p3_derived", "SELECT o_orderkey, o_orderstatus || '-' || o_orderpriority AS pair, round(coalesce(CASE WHEN o_totalprice > 0 THEN ln(o_totalprice) END, 0), 6) AS log_price, round(o_totalprice * o_totalprice, 2) AS squared FROM orders")(lambda s, d: t(s, d, "orders").select("o_orderkey", F.concat_ws("-", "o_orderstatus", "o_orderpriority").alias("pair"), F.round(F.coalesce(C.safe_log(F.col("o_totalprice")), F.lit(0.0)), 6).alias("log_price"), F.round(F.col("o_totalprice") * F.col("o_totalprice"), 2).alias("squared")))
query("p4_categories", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS l_discount_flag, CASE WHEN l_quantity > 40 THEN 2 WHEN l_quantity > 20 THEN 1 ELSE 0 END AS size_class FROM lineitem")(lambda s, d: R.case_category(R.binarize(t(s, d, "lineitem"), {"l_discount": 0.05}), "size_class", [(F.col("l_quantity") > 40, 2), (F.col("l_quantity") > 20, 1)], 0).select("l_orderkey", "l_linenumber", "l_discount_flag", "size_class"))
SPARSE = lambda s, d: R.null_sentinels(t(s, d, "part"), {"p_size": 1, "p_brand": "Brand#11"})
SPARSE_SQL = "SELECT p_partkey, p_name, nullif(p_brand, 'Brand#11') AS p_brand, p_type, nullif(p_size, 1) AS p_size, p_retailprice FROM part"
query("p5_null_sentinels", SPARSE_SQL)(SPARSE)
query("p6_drop_null_rows", f"SELECT * FROM ({SPARSE_SQL}) WHERE (p_brand IS NOT NULL OR p_size IS NOT NULL) AND p_size IS NOT NULL")(lambda s, d: SPARSE(s, d).dropna("all", subset=["p_brand", "p_size"]).dropna("any", subset=["p_size"]))
query("p7_null_counts", f"SELECT * FROM (SELECT 'p_size' AS \"column\", count(*) - count(p_size) AS nulls FROM ({SPARSE_SQL}) UNION ALL SELECT 'p_brand', count(*) - count(p_brand) FROM ({SPARSE_SQL})) ")(lambda s, d: R.null_counts(SPARSE(s, d).select("p_size", "p_brand")))
query("p8_drop_sparse_columns", "SELECT p_partkey, p_name, p_type, p_retailprice FROM part")(lambda s, d: R.drop_sparse_columns(R.null_sentinels(t(s, d, "part").withColumns({"p_size": F.lit(None).cast("int"), "p_brand": F.lit(None).cast("string")}), {}), 0))
query("p9_impute", f"WITH p AS ({SPARSE_SQL}), m AS (SELECT avg(p_size) AS a FROM p), b AS (SELECT p_brand AS b FROM p WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT p_partkey, round(coalesce(p_size, a), 6) AS p_size, coalesce(p_brand, b) AS p_brand FROM p, m, b")(lambda s, d: R.impute(SPARSE(s, d), ["p_size"], ["p_brand"]).select("p_partkey", F.round("p_size", 6).alias("p_size"), "p_brand"))
query("p10_dedupe", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")(lambda s, d: R.dedupe(t(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type"))


@query("p11_feature_columns", "SELECT count(DISTINCT l_returnflag || l_linestatus) AS text_values, round(sum(l_extendedprice), 2) AS price FROM lineitem")
def _(s, d):
    li = t(s, d, "lineitem")
    text, number = R.feature_columns(li, ["l_orderkey", "l_partkey", "l_suppkey"])
    assert "l_extendedprice" in number
    return li.agg(F.countDistinct(F.concat(*text)).alias("text_values"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


query("p12_incomplete_rows", f"SELECT p_partkey FROM ({SPARSE_SQL}) WHERE p_brand IS NULL OR p_size IS NULL")(lambda s, d: R.incomplete_rows(SPARSE(s, d)).select("p_partkey"))
query("p13_rescale01", "SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 9) AS scaled FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")(lambda s, d: R.rescale01(t(s, d, "customer"), ["c_acctbal"]).select("c_custkey", F.round("c_acctbal", 9).alias("scaled")))
query("p14_stray_headers", "SELECT count(*) FILTER (c_name = 'c_name') AS stray_rows FROM customer")(lambda s, d: R.stray_header_rows(t(s, d, "customer"), "c_name"))

# ---- joins
query("j1_lookup", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")(lambda s, d: R.lookup(t(s, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), t(s, d, "nation"), "n_nationkey").select("c_custkey", "n_name"))


@query("j2_two_key_twice", "SELECT o_orderkey, a.r_name AS origin_region, b.r_name AS dest_region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation n ON n.n_nationkey = c_nationkey JOIN region a ON a.r_regionkey = n.n_regionkey AND length(a.r_name) > 0 JOIN region b ON b.r_regionkey = o_orderkey % 5")
def _(s, d):
    n = t(s, d, "nation").join(F.broadcast(t(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("origin_region"))
    o = t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = R.lookup(o.withColumnRenamed("c_nationkey", "n_nationkey"), n, "n_nationkey").withColumn("r_regionkey", (F.col("o_orderkey") % 5).cast("int"))
    return R.lookup(o, t(s, d, "region").withColumnRenamed("r_name", "dest_region"), "r_regionkey").select("o_orderkey", "origin_region", "dest_region")


HOURLY = "SELECT event_type, date_trunc('hour', ts) AS hour, max(value) AS value FROM events GROUP BY 1, 2"
query("j3_hourly_join", f"SELECT event_id, e.event_type, o.value AS value_origin FROM events e JOIN ({HOURLY}) o ON e.event_type = o.event_type AND date_trunc('hour', e.ts) = o.hour")(lambda s, d: R.join_hourly(t(s, d, "events").select("event_id", "event_type", "ts"), R.collapse_hourly_max(t(s, d, "events"), ["event_type"], "ts", ["value"]), ["event_type"], "ts", "_origin").select("event_id", "event_type", "value_origin"))
LEGS = "SELECT l_orderkey, l_linenumber, l_suppkey % 50 AS o, l_partkey % 50 AS dd, l_linestatus AS st FROM lineitem"
legs = lambda s, d: t(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 50).alias("o"), (F.col("l_partkey") % 50).alias("dd"), F.col("l_linestatus").alias("st"))
query("j4_inbound_count", f"WITH l AS ({LEGS}) SELECT l_orderkey, l_linenumber, n AS inbound FROM l JOIN (SELECT dd, st, count(*) AS n FROM l GROUP BY 1, 2) a ON l.o = a.dd AND l.st = a.st")(lambda s, d: R.inbound_count(legs(s, d), "o", "dd", ["st"], "inbound").select("l_orderkey", "l_linenumber", "inbound"))
query("j5_rank_twice", f"WITH l AS ({LEGS}), r AS (SELECT o AS k, count(*) AS rnk FROM l GROUP BY 1) SELECT l_orderkey, l_linenumber, a.rnk AS o_rank, b.rnk AS d_rank FROM l JOIN r a ON l.o = a.k JOIN r b ON l.dd = b.k")(lambda s, d: R.lookup(R.lookup(legs(s, d), legs(s, d).groupBy("o").agg(F.count("*").alias("o_rank")), "o"), legs(s, d).groupBy(F.col("o").alias("dd")).agg(F.count("*").alias("d_rank")), "dd").select("l_orderkey", "l_linenumber", "o_rank", "d_rank"))
query("j6_top_with_names", "SELECT l_suppkey, n, s_name FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 20) JOIN supplier ON l_suppkey = s_suppkey")(lambda s, d: R.top_with_names(t(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")), t(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey", "n", 20))
query("j7_entity_name", "SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")(lambda s, d: R.lookup(t(s, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), t(s, d, "nation"), "n_nationkey").groupBy("n_name").agg(F.count("*").alias("suppliers")))
query("j9_stopwords_vocab", "SELECT count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations) WHERE word NOT IN ('the', 'of', 'and')")(lambda s, d: R.lookup(t(s, d, "conversations").select(F.explode(C.tokens(F.col("text"))).alias("word")), rows(s, [("the",), ("of",), ("and",)], "word string"), "word", "left_anti").agg(F.count("*").alias("n")))

# ---- aggregates
query("a1_group_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL")(lambda s, d: R.attach_group_count(t(s, d, "events"), ["user_id", "event_type"], "n").select("event_id", "n"))
query("a2_hourly_max", HOURLY.replace("AS hour", "::TIMESTAMP AS hour"))(lambda s, d: R.collapse_hourly_max(t(s, d, "events"), ["event_type"], "ts", ["value"]).withColumn("hour", F.col("hour").cast("timestamp_ntz")))
query("a3_delay_summary", "SELECT count(*) FILTER (value <= 15) AS on_time, count(*) FILTER (value > 15) AS delayed, round(avg(value), 6) AS mean_delay, max(value) AS longest FROM events")(lambda s, d: R.delay_summary(t(s, d, "events"), "value"))
query("a4_top_routes", "SELECT l_suppkey, l_partkey, count(l_quantity) AS trips FROM (SELECT DISTINCT l_suppkey, l_partkey, l_quantity FROM lineitem) GROUP BY 1, 2 ORDER BY trips DESC, 1, 2 LIMIT 20")(lambda s, d: t(s, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity").distinct().groupBy("l_suppkey", "l_partkey").agg(F.count("l_quantity").alias("trips")).orderBy(F.desc("trips"), "l_suppkey", "l_partkey").limit(20))
LATE = "SELECT l_suppkey, l_shipdate, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS late FROM lineitem"
late = lambda s, d: t(s, d, "lineitem").select("l_suppkey", "l_shipdate", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("late"))
query("a5_rate_by", f"SELECT month(l_shipdate)::INTEGER AS mon, round(avg(late), 9) AS rate, count(*) AS n FROM ({LATE}) GROUP BY 1")(lambda s, d: R.rate_by(late(s, d).withColumn("mon", F.month("l_shipdate")), "mon", "late"))
query("a6_rate_top", f"SELECT l_suppkey, round(avg(late), 9) AS rate, count(*) AS n FROM ({LATE}) GROUP BY 1 HAVING count(*) > 15 ORDER BY rate DESC, l_suppkey LIMIT 20")(lambda s, d: R.rate_by(late(s, d), "l_suppkey", "late", 15, 20))
query("a7_count_by", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2")(lambda s, d: t(s, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n")))
query("a8_prop_table", "SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM orders GROUP BY 1")(lambda s, d: R.prop_table(t(s, d, "orders"), ["o_orderpriority"]))
query("a9_mean_by", "SELECT year(o_orderdate)::INTEGER AS yr, round(avg(o_totalprice), 4) AS price FROM orders GROUP BY 1")(lambda s, d: t(s, d, "orders").groupBy(F.year("o_orderdate").alias("yr")).agg(F.round(F.avg("o_totalprice"), 4).alias("price")))
query("a10_sum_by", "SELECT year(l_shipdate)::INTEGER AS yr, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS returned, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS open, round(avg(l_discount), 9) AS discount FROM lineitem GROUP BY 1")(lambda s, d: t(s, d, "lineitem").groupBy(F.year("l_shipdate").alias("yr")).agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open"), F.round(F.avg("l_discount"), 9).alias("discount")))
for _policy, _sql in (("ignore", "avg(v)"), ("propagate", "CASE WHEN count(v) = count(*) THEN avg(v) END")):
    query(f"a11_resample_{_policy}", f"SELECT date_trunc('month', o_orderdate)::DATE AS period, round({_sql}, 6) AS mean_value FROM (SELECT o_orderdate, CASE WHEN o_orderkey % 97 <> 0 THEN o_totalprice END AS v FROM orders) GROUP BY 1")(lambda s, d, p=_policy: R.resample_mean(t(s, d, "orders").withColumn("v", F.when(F.col("o_orderkey") % 97 != 0, F.col("o_totalprice"))), "o_orderdate", "v", "month", p))
query("a12_describe", "SELECT 'c_acctbal' AS \"column\", count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean_value, round(stddev_samp(c_acctbal), 6) AS sd, min(c_acctbal) AS lo, round(quantile_cont(c_acctbal, 0.25), 6) AS q1, round(quantile_cont(c_acctbal, 0.5), 6) AS median, round(quantile_cont(c_acctbal, 0.75), 6) AS q3, max(c_acctbal) AS hi FROM customer")(lambda s, d: R.describe(t(s, d, "customer"), ["c_acctbal"]))
query("a13_distinct_count", "SELECT count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem")(lambda s, d: t(s, d, "lineitem").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts")))


@query("a13_distinct_sketch", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS sketch_near FROM lineitem GROUP BY 1")
def _(s, d):
    li = t(s, d, "lineitem")
    merged = fits.merged_distinct(fits.distinct_sketch(li, ["l_returnflag", "l_linenumber"], "l_partkey"), ["l_returnflag"])
    exact = li.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"))
    return exact.join(merged, "l_returnflag").select("l_returnflag", "parts", (F.abs(F.col("approx") - F.col("parts")) <= 0.08 * F.col("parts")).alias("sketch_near"))


query("a14_class_balance", f"SELECT count(*) FILTER (late = 1) AS positives, round(100 * avg(late), 6) AS percent_positive, round(1 - avg(late), 9) AS balancing_ratio FROM ({LATE})")(lambda s, d: R.class_balance(late(s, d), "late"))
query("a16_merge_counts", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1")(lambda s, d: t(s, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).groupBy("l_partkey").agg(F.sum("n").alias("n")))
query("a17_mean_variance", "SELECT round(avg(l_quantity), 6) AS mean_value, round(var_pop(l_quantity), 6) AS variance FROM lineitem")(lambda s, d: t(s, d, "lineitem").agg(F.round(F.avg("l_quantity"), 6).alias("mean_value"), F.round(F.var_pop("l_quantity"), 6).alias("variance")))
_cor = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
query("a18_correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in _cor for b in _cor))(lambda s, d: R.correlation_matrix(t(s, d, "lineitem"), _cor))
query("a19_select_by_correlation", "SELECT 'l_quantity' AS feature, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem HAVING abs(corr(l_quantity, l_extendedprice)) > 0.5")(lambda s, d: R.select_by_correlation(t(s, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]))
query("a21_histogram", "SELECT least(floor((c_acctbal - lo) / w), 9)::BIGINT AS bin, count(*) AS n FROM customer, (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 10 AS w FROM customer) GROUP BY 1")(lambda s, d: R.histogram(t(s, d, "customer"), "c_acctbal", 10))
query("a22_box_stats", "SELECT c_mktsegment, min(c_acctbal) AS lo, round(quantile_cont(c_acctbal, 0.25), 6) AS q1, round(quantile_cont(c_acctbal, 0.5), 6) AS median, round(quantile_cont(c_acctbal, 0.75), 6) AS q3, max(c_acctbal) AS hi FROM customer GROUP BY 1")(lambda s, d: R.box_stats(t(s, d, "customer"), "c_mktsegment", "c_acctbal"))

# ---- windows
_carry = "w AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts, rank() OVER (PARTITION BY user_id ORDER BY ts) AS rnk FROM events WHERE user_id IS NOT NULL)"
query("w1_next_event", f"WITH {_carry} SELECT event_id, next_ts FROM w")(lambda s, d: R.carry_over_delay(t(s, d, "events"), "user_id", "ts", "event_id", "value").select("event_id", "next_ts"))
query("w2_rank_within", f"WITH {_carry} SELECT event_id, rnk::INTEGER AS rnk FROM w")(lambda s, d: R.carry_over_delay(t(s, d, "events"), "user_id", "ts", "event_id", "value").select("event_id", "rnk"))
query("w3_carry_over", f"WITH {_carry}, o AS (SELECT *, CASE WHEN (epoch(next_ts)::BIGINT - epoch(ts)::BIGINT) / 60 <= 5000 THEN value ELSE 0 END AS own FROM w) SELECT event_id, CASE WHEN rnk <= 2 THEN 0 ELSE coalesce(lag(own, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) END::DOUBLE AS carried FROM o")(lambda s, d: R.carry_over_delay(t(s, d, "events"), "user_id", "ts", "event_id", "value", 5000).select("event_id", "carried"))
query("w4_forward_fill", "SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 250 PRECEDING AND CURRENT ROW) AS v FROM (SELECT *, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events)")(lambda s, d: R.forward_fill(t(s, d, "events").withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("value"))), ["user_id"], ["ts", "event_id"], ["v"]).select("event_id", "v"))
query("w5_top_by_rank", "SELECT n_name, bal, rnk::INTEGER AS rnk FROM (SELECT n_name, bal, rank() OVER (ORDER BY bal DESC) AS rnk FROM (SELECT n_name, round(sum(s_acctbal), 2) AS bal FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)) WHERE rnk <= 3")(lambda s, d: _top_by_rank(s, d))


def _top_by_rank(s, d):
    from pyspark.sql import Window

    b = t(s, d, "supplier").join(F.broadcast(t(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("s_acctbal"), 2).alias("bal"))
    return b.withColumn("rnk", F.rank().over(Window.orderBy(F.desc("bal")))).where("rnk <= 3")


query("w6_top_n_per_group", "SELECT o_orderpriority, o_orderkey, rn::INTEGER AS rn FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 10")(lambda s, d: R.top_n_per_group(t(s, d, "orders"), "o_orderpriority", [F.desc("o_totalprice"), "o_orderkey"], 10).select("o_orderpriority", "o_orderkey", "rn"))
query("w7_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS rn FROM orders")(lambda s, d: segments.number_rows(t(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "i").select("o_orderkey", (F.col("i") + 1).cast("int").alias("rn")))
DAILY = "SELECT event_type AS key, day, value, row_number() OVER (PARTITION BY event_type ORDER BY day)::INTEGER AS t FROM (SELECT event_type, date_trunc('day', ts)::DATE AS day, avg(value) AS value FROM events GROUP BY 1, 2)"
daily = lambda s, d: Y.hourly(t(s, d, "events"), "event_type", "ts", "value")
query("w8_difference", f"WITH s AS ({DAILY}), a AS (SELECT *, value - lag(value, 7) OVER (PARTITION BY key ORDER BY t) AS x FROM s) SELECT key, t, round(x - lag(x, 1) OVER (PARTITION BY key ORDER BY t), 6) AS diff FROM a")(lambda s, d: R.difference(daily(s, d), "key", ["t"], "value", (7, 1)).select("key", "t", F.round("diff", 6).alias("diff")))

# ---- order, sets, samples
WORDS = "SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents"
query("o1_sorted_counts", f"SELECT word, count(*) AS n FROM ({WORDS}) GROUP BY 1")(lambda s, d: T.word_count(t(s, d, "documents"), "text").orderBy("word"))
query("o2_secondary_sort", "SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2")(lambda s, d: t(s, d, "orders").groupBy("o_orderstatus", "o_custkey").agg(F.count("*").alias("n")).orderBy("o_orderstatus", F.desc("n"), "o_custkey"))
query("o3_partition_sort", "SELECT o_orderkey, o_orderpriority FROM orders")(lambda s, d: t(s, d, "orders").select("o_orderkey", "o_orderpriority").repartition("o_orderpriority").sortWithinPartitions("o_orderpriority", "o_orderkey"))
query("o4_top_bottom", f"WITH c AS (SELECT word, count(*) AS n FROM ({WORDS}) GROUP BY 1) SELECT * FROM (SELECT word, n, 'top' AS side FROM c ORDER BY n DESC, word LIMIT 10) UNION ALL SELECT * FROM (SELECT word, n, 'bottom' AS side FROM c ORDER BY n, word LIMIT 10)")(lambda s, d: R.top_bottom(T.word_count(t(s, d, "documents"), "text"), "n", "word", 10))
query("u1_union", "SELECT c_nationkey AS k, 'c' AS side FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")(lambda s, d: t(s, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("side")).unionByName(t(s, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("side"))))
query("u2_distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")(lambda s, d: t(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct())
query("u3_percent_overlap", "SELECT common, round(100.0 * common / n, 6)::DOUBLE AS percent FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O')) AS common, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F') AS n)")(lambda s, d: R.percent_overlap(t(s, d, "orders").where("o_orderstatus = 'F'"), t(s, d, "orders").where("o_orderstatus = 'O'"), "o_custkey").withColumn("percent", F.col("percent").cast("double")))
_bucket = lambda k, n: f"(('0x' || substr(md5('s' || {k}::VARCHAR), 1, 8))::BIGINT % {n})"
query("x1_sample_fraction", f"SELECT o_orderkey FROM orders WHERE {_bucket('o_orderkey', 10000)} < 2000")(lambda s, d: R.sample_fraction(t(s, d, "orders"), "o_orderkey", 0.2).select("o_orderkey"))
query("x1_sample_n", "SELECT o_orderkey FROM orders ORDER BY md5('s' || o_orderkey::VARCHAR), o_orderkey LIMIT 100")(lambda s, d: R.sample_n(t(s, d, "orders"), "o_orderkey", 100).select("o_orderkey"))
query("x2_hash_split", f"SELECT o_orderkey, CASE WHEN {_bucket('o_orderkey', 10000)} >= 8000 THEN 1 ELSE 0 END AS split FROM orders")(lambda s, d: R.hash_split(t(s, d, "orders"), "o_orderkey", [0.8, 0.2]).select("o_orderkey", "split"))
query("x3_split_by_time", "SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1997 THEN 'train' WHEN year(o_orderdate) = 1997 THEN 'test' END AS part FROM orders WHERE year(o_orderdate) <= 1997")(lambda s, d: t(s, d, "orders").where(F.year("o_orderdate") <= 1997).select("o_orderkey", F.when(F.year("o_orderdate") < 1997, "train").otherwise("test").alias("part")))

# ---- scalar functions
query("f1_tokens", "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z]+'))::INTEGER AS n FROM documents")(lambda s, d: t(s, d, "documents").select("doc_id", F.size(C.tokens(F.col("text"))).alias("n")))
query("f2_tokens_case", "SELECT doc_id, len(regexp_extract_all(text, '[a-z]+'))::INTEGER AS n FROM documents")(lambda s, d: t(s, d, "documents").select("doc_id", F.size(C.tokens(F.col("text"), lower=False)).alias("n")))
query("f3_tokens_ws", "SELECT conv_id, turn, len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''))::INTEGER AS n FROM conversations")(lambda s, d: t(s, d, "conversations").select("conv_id", "turn", F.size(C.tokens_ws(F.col("text"))).alias("n")))
query("f4_local_to_utc", "SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y-%m-%d') || ' ' || lpad((o_orderkey % 24 * 100 + o_orderkey % 60)::VARCHAR, 4, '0'), '%Y-%m-%d %H%M') + INTERVAL 5 HOURS AS utc FROM orders")(lambda s, d: t(s, d, "orders").select("o_orderkey", C.local_hhmm_to_utc(F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 24 * 100 + F.col("o_orderkey") % 60, F.lit("GMT-05:00")).cast("timestamp_ntz").alias("utc")))
query("f5_time_parts", "SELECT event_id, hour(ts)::INTEGER AS h, date_trunc('hour', ts)::TIMESTAMP AS hour_ts, ts - INTERVAL 2 HOURS AS earlier, ts::DATE AS day FROM events")(lambda s, d: t(s, d, "events").select("event_id", F.hour("ts").alias("h"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_ts"), (F.col("ts") - F.expr("INTERVAL 2 HOURS")).cast("timestamp_ntz").alias("earlier"), F.to_date("ts").alias("day")))
query("f6_unpack", "SELECT p_partkey, try_cast(split_part(v, ',', 1) AS INTEGER) AS a, try_cast(split_part(v, ',', 3) AS INTEGER) AS c FROM (SELECT p_partkey, p_size || ',x,' || p_partkey AS v FROM part)")(lambda s, d: t(s, d, "part").select("p_partkey", F.concat_ws(",", "p_size", F.lit("x"), "p_partkey").alias("v")).select("p_partkey", C.unpack(F.col("v"), 0).alias("a"), C.unpack(F.col("v"), 2).alias("c")))
query("f7_cyclical", "SELECT p_partkey, round(cos(radians(p_size * 7)), 9) AS c, round(sin(radians(p_size * 7)), 9) AS s FROM part")(lambda s, d: t(s, d, "part").select("p_partkey", *[F.round(x, 9).alias(n) for x, n in zip(C.cyclical(F.col("p_size") * 7), "cs")]))
query("f8_station_keys", "SELECT s_suppkey, right(trim(s_name), 3) AS last3, s_name || s_nationkey::VARCHAR AS station FROM supplier")(lambda s, d: t(s, d, "supplier").select("s_suppkey", C.last_three(F.col("s_name")).alias("last3"), F.concat("s_name", F.col("s_nationkey").cast("string")).alias("station")))
query("f9_safe_log", "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 9) AS l FROM customer")(lambda s, d: t(s, d, "customer").select("c_custkey", F.round(C.safe_log(F.col("c_acctbal")), 9).alias("l")))
query("f10_period_index", "SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS mon, date_trunc('week', o_orderdate)::DATE AS wk FROM orders")(lambda s, d: t(s, d, "orders").select("o_orderkey", C.month_of(F.col("o_orderdate")).alias("mon"), C.week_of(F.col("o_orderdate")).alias("wk")))
query("f11_contains", "SELECT p_partkey FROM part WHERE contains(p_type, 'A')")(lambda s, d: t(s, d, "part").where(F.col("p_type").contains("A")).select("p_partkey"))

# ---- text
query("t1_word_count", f"SELECT word, count(*) AS n FROM ({WORDS}) GROUP BY 1")(lambda s, d: T.word_count(t(s, d, "documents"), "text"))
GRAMS = "SELECT array_to_string(w[i:i + 4], ' ') AS ngram, count(*) AS cnt FROM (SELECT w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents) WHERE len(w) >= 5) GROUP BY 1"
grams = lambda s, d: T.ngrams(t(s, d, "documents"), "text")
GW = f"SELECT word, sum(cnt)::BIGINT AS n FROM (SELECT unnest(string_split(ngram, ' ')) AS word, cnt FROM ({GRAMS})) GROUP BY 1"
PAIRS = f"SELECT DISTINCT w1, w2 FROM (SELECT w1, unnest(w) AS w2 FROM (SELECT w, unnest(w) AS w1 FROM (SELECT list_distinct(string_split(ngram, ' ')) AS w FROM ({GRAMS})))) WHERE w1 <> w2"
query("t2_ngram_word_count", GW)(lambda s, d: T.ngram_word_count(grams(s, d)))
query("t3_vocabulary_summary", f"WITH c AS ({GW}), v AS (SELECT count(*) AS vocabulary FROM c) SELECT word, n, side, vocabulary FROM (SELECT * FROM (SELECT word, n, 'top' AS side FROM c ORDER BY n DESC, word LIMIT 10) UNION ALL SELECT * FROM (SELECT word, n, 'bottom' AS side FROM c ORDER BY n, word LIMIT 10)), v")(lambda s, d: T.vocabulary_summary(grams(s, d)))
query("t4_neighbor_counts", f"SELECT w1 AS word, count(*) AS n FROM ({PAIRS}) GROUP BY 1")(lambda s, d: T.text_neighbor_counts(t(s, d, "documents"), "text"))
_TOP = "SELECT word FROM ({0}) ORDER BY n DESC, word LIMIT 1000"
query("t5_ranking_overlap", f"WITH a AS ({_TOP.format(GW)}), b AS ({_TOP.format(f'SELECT w1 AS word, count(*) AS n FROM ({PAIRS}) GROUP BY 1')}) SELECT common, round(100.0 * common / (SELECT count(*) FROM a), 6) AS percent FROM (SELECT count(*) AS common FROM a WHERE word IN (SELECT word FROM b))")(lambda s, d: T.ranking_overlap(T.text_word_count(t(s, d, "documents"), "text"), T.text_neighbor_counts(t(s, d, "documents"), "text"), 1000))
VOCAB = f"SELECT word, n, (row_number() OVER (ORDER BY n DESC, word) - 1)::INTEGER AS rnk, row_number() OVER (ORDER BY n DESC, word) > 200 AS basis FROM (SELECT * FROM ({GW}) WHERE word NOT IN ('the', 'of', 'and') ORDER BY n DESC, word LIMIT 300)"
vocab = lambda s, d: T.get_vocab(T.text_word_count(t(s, d, "documents"), "text"), 300, 100, rows(s, [("the",), ("of",), ("and",)], "word string"))
query("t6_vocab", VOCAB)(vocab)
STRIPES = f"SELECT w1 AS item, w2 AS feature FROM ({PAIRS}) WHERE w1 IN (SELECT word FROM ({VOCAB})) AND w2 IN (SELECT word FROM ({VOCAB}) WHERE basis)"


def stripes(s, d) -> DataFrame:
    words = files.saved(vocab(s, d), "vocabulary")
    return files.saved(T.build_stripes(T.text_pairs(t(s, d, "documents"), "text", words), words), "stripes")  # what follows reads them several times


query("t7_stripes", STRIPES)(stripes)
SIM = "z AS (SELECT item, count(*) AS n FROM i GROUP BY 1), p AS (SELECT x.item AS a, y.item AS b, count(*) AS c FROM i x JOIN i y ON x.feature = y.feature AND x.item < y.item GROUP BY 1, 2), q AS (SELECT a, b, c, u.n AS n1, v.n AS n2 FROM p JOIN z u ON u.item = a JOIN z v ON v.item = b) SELECT a, b, c AS common, round(c / sqrt(n1 * n2), 9) AS cosine, round(c / (n1 + n2 - c), 9) AS jaccard, round(c / least(n1, n2), 9) AS \"overlap\", round(2 * c / (n1 + n2), 9) AS dice, round((c / sqrt(n1 * n2) + c / (n1 + n2 - c) + c / least(n1, n2) + 2 * c / (n1 + n2)) / 4, 9) AS mean_score FROM q"
query("t8_similarity", f"WITH i AS ({STRIPES}), {SIM}")(lambda s, d: T.similarity(stripes(s, d)))
query("t8_similarity_extremes", f"WITH i AS ({STRIPES}), s AS (WITH {SIM}) SELECT a, b, cosine, side, rn::INTEGER AS rn FROM (SELECT a, b, cosine, 'top' AS side, row_number() OVER (ORDER BY cosine DESC, a, b) AS rn FROM s UNION ALL SELECT a, b, cosine, 'bottom' AS side, row_number() OVER (ORDER BY cosine, a, b) AS rn FROM s) WHERE rn <= 20")(lambda s, d: T.similarity_extremes(stripes(s, d), 20))
query("t9_document_jaccard", f"WITH i AS (SELECT DISTINCT item_id AS item, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS feature FROM benchmark), {SIM}")(lambda s, d: T.similarity(T.document_items(t(s, d, "benchmark"), "item_id", "text")))
query("t11_term_cosine", f"WITH i AS ({STRIPES}), s AS (WITH {SIM}) SELECT x.item AS a, y.item AS b, coalesce(s.cosine, 0) AS cosine FROM (SELECT DISTINCT item FROM i) x JOIN (SELECT DISTINCT item FROM i) y ON x.item < y.item LEFT JOIN s ON s.a = x.item AND s.b = y.item")(lambda s, d: T.term_cosine_all_pairs(stripes(s, d)))
_nations = [str(k) for k in range(25)]
query("t10_cooccurrence", f"SELECT c_mktsegment AS item, {', '.join(f'count(DISTINCT CASE WHEN c_nationkey = {k} THEN 1 END) AS {chr(34)}{k}{chr(34)}' for k in _nations)} FROM customer GROUP BY 1")(lambda s, d: T.cooccurrence_matrix(t(s, d, "customer").select(F.col("c_mktsegment").alias("item"), F.col("c_nationkey").cast("string").alias("feature")).distinct(), _nations))
query("t10_cooccurrence_long", "SELECT DISTINCT c_mktsegment AS item, c_nationkey::VARCHAR AS feature, 1 AS one FROM customer")(lambda s, d: t(s, d, "customer").select(F.col("c_mktsegment").alias("item"), F.col("c_nationkey").cast("string").alias("feature")).distinct().withColumn("one", F.lit(1)))
LABELLED = "(SELECT doc_id, text, toxic FROM documents JOIN labels USING (doc_id))"
labelled = lambda s, d: t(s, d, "documents").select("doc_id", "text").join(t(s, d, "labels"), "doc_id")
query("t12_word_class_counts", f"SELECT word, c::INTEGER AS class, count(*) FILTER (toxic = c) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS word, toxic FROM {LABELLED}), (VALUES (0), (1)) v(c) GROUP BY 1, 2")(lambda s, d: T.word_class_counts(labelled(s, d), "text", "toxic"))

# ---- Naive Bayes
NBC = f"c AS (SELECT word, count(*) FILTER (toxic = 0) AS n0, count(*) FILTER (toxic = 1) AS n1 FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word, toxic FROM {LABELLED}) GROUP BY 1), tt AS (SELECT sum(n0) AS t0, sum(n1) AS t1, count(*) AS v FROM c)"
for _name, _k in (("n1_nb_train", 0), ("n2_nb_laplace", 1)):
    query(_name, f"WITH {NBC} SELECT word, n0, n1, round((n0 + {_k}) / (t0 + {_k} * v), 12) AS p0, round((n1 + {_k}) / (t1 + {_k} * v), 12) AS p1 FROM c, tt")(lambda s, d, k=_k: T.nb_train(labelled(s, d), "text", "toxic", float(k) or None).select("word", "n0", "n1", F.round("p0", 12).alias("p0"), F.round("p1", 12).alias("p1")))
NBS = f"WITH {NBC}, m AS (SELECT word, ln((n0 + 1) / (t0 + v)) AS l0, ln((n1 + 1) / (t1 + v)) AS l1 FROM c, tt), pr AS (SELECT ln(avg(1 - toxic)) AS q0, ln(avg(toxic)) AS q1 FROM {LABELLED}), s AS (SELECT doc_id, toxic, q0 + coalesce(sum(l0), 0) AS a, q1 + coalesce(sum(l1), 0) AS b FROM (SELECT doc_id, toxic, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS word FROM (SELECT doc_id, toxic, regexp_extract_all(lower(text), '[a-z]+') AS w FROM {LABELLED})) LEFT JOIN m USING (word), pr GROUP BY doc_id, toxic, q0, q1), pd AS (SELECT doc_id, toxic, a, b, CASE WHEN a >= b THEN 0 ELSE 1 END AS pred FROM s)"


def classified(s, d):
    docs = labelled(s, d)
    return T.nb_classify(docs, "doc_id", "text", T.nb_train(docs, "text", "toxic", 1.0), T.nb_priors(docs, "toxic"))


query("n3_nb_classify", f"{NBS} SELECT doc_id, round(a, 3) AS log0, round(b, 3) AS log1, pred FROM pd")(lambda s, d: classified(s, d).select("doc_id", F.round("log0", 3).alias("log0"), F.round("log1", 3).alias("log1"), "pred"))
query("n4_metrics", f"{NBS}, k AS (SELECT count(*) FILTER (toxic = 1 AND pred = 1) AS tp, count(*) FILTER (toxic = 0 AND pred = 0) AS tn, count(*) FILTER (toxic = 0 AND pred = 1) AS fp, count(*) FILTER (toxic = 1 AND pred = 0) AS fn FROM pd) SELECT tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS prec, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM k")(lambda s, d: T.binary_metrics(classified(s, d).join(t(s, d, "labels"), "doc_id"), "toxic", "pred"))
query("n5_top_words", f"WITH {NBC}, m AS (SELECT word, (n0 + 1) / (t0 + v) AS p0, (n1 + 1) / (t1 + v) AS p1 FROM c, tt), k AS (SELECT CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS class, word, greatest(p0, p1) AS p FROM m) SELECT class, word, round(p, 9) AS p, rn::INTEGER AS rn FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY p DESC, word) AS rn FROM k) WHERE rn <= 10")(lambda s, d: T.nb_top_words(T.nb_train(labelled(s, d), "text", "toxic", 1.0), 10))
query("n6_head_tail", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) <= 80 AS head FROM orders")(lambda s, d: segments.number_rows(t(s, d, "orders").select("o_orderkey"), [], ["o_orderkey"], "i").select("o_orderkey", (F.col("i") < 80).alias("head")))

# ---- graphs
query("g1_adjacency_list", f"WITH e AS ({E}), v AS ({NODES}) SELECT id, array_to_string(list_sort(coalesce(list(dst) FILTER (dst IS NOT NULL), [])), ',') AS neighbors FROM v LEFT JOIN e ON id = src GROUP BY id")(lambda s, d: graph.adjacency_list(graph.nodes_of(edges(s, d)), edges(s, d)).select("id", F.array_join("neighbors", ",").alias("neighbors")))
query("g2_adjacency_long", f"WITH e AS ({E}) SELECT DISTINCT src, dst, 1 AS one FROM e")(lambda s, d: edges(s, d).select("src", "dst").distinct().withColumn("one", F.lit(1)))
query("g3_transitions", f"WITH e AS ({E}) SELECT src, dst, round(weight / sum(weight) OVER (PARTITION BY src), 12) AS p FROM e")(lambda s, d: graph.transition_probabilities(edges(s, d)).select("src", "dst", F.round("p", 12).alias("p")))


def _ranks_sql(n: int, start: str, step: str, e: str = E) -> str:
    ctes = [f"e AS ({e})", "p AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM e)", f"v AS ({NODES})", "dang AS (SELECT id FROM v WHERE id NOT IN (SELECT src FROM e))", f"r0 AS (SELECT id, {start} AS rank FROM v)"]
    for i in range(n):
        ctes.append(f"g{i} AS (SELECT dst, sum(rank * p) AS got FROM p JOIN r{i} ON src = id GROUP BY dst)")
        ctes.append(f"m{i} AS (SELECT coalesce(sum(rank), 0) AS m FROM r{i} WHERE id IN (SELECT id FROM dang))")
        ctes.append(f"r{i + 1} AS (SELECT id, {step} AS rank FROM v LEFT JOIN g{i} ON dst = id, m{i})")
    return f"WITH {', '.join(ctes)} SELECT id, round(rank, 12) AS rank FROM r{n}"


_N = "(SELECT count(*) FROM v)"
_rounded = lambda df: df.select("id", F.round("rank", 12).alias("rank"))
query("g4_power_iteration", _ranks_sql(3, f"1.0::DOUBLE / {_N}", "coalesce(got, 0)"))(lambda s, d: _rounded(graph.power_iteration(edges(s, d), 3)))
query("g5_count_nodes", f"WITH e AS ({E}), v AS ({NODES}) SELECT count(*) AS nodes, count(*) FILTER (id NOT IN (SELECT src FROM e)) AS dangling FROM v")(lambda s, d: graph.count_nodes(edges(s, d)))
query("g6_degree_summary", f"WITH e AS ({E}), k AS (SELECT src, sum(weight)::BIGINT AS out_degree FROM e GROUP BY 1) SELECT src, out_degree, mean_degree FROM (SELECT * FROM k ORDER BY out_degree DESC, src LIMIT 10), (SELECT round(avg(out_degree), 9) AS mean_degree FROM k)")(lambda s, d: graph.degree_summary(edges(s, d)))
query("g6_degree_sample", f"WITH e AS ({E}) SELECT src, sum(weight)::BIGINT AS out_degree FROM e GROUP BY 1 ORDER BY md5('s' || src::VARCHAR), src LIMIT 20")(lambda s, d: graph.degree_sample(edges(s, d), 20))
query("g7_init_graph", f"WITH e AS ({E}), v AS ({NODES}) SELECT id, round(1.0::DOUBLE / {_N}, 12) AS rank FROM v")(lambda s, d: _rounded(graph.init_graph(edges(s, d))))
query("g8_pagerank", _ranks_sql(10, f"1.0::DOUBLE / {_N}", f"0.15::DOUBLE / {_N} + 0.85::DOUBLE * (m / {_N} + coalesce(got, 0))"))(lambda s, d: _rounded(graph.pagerank(edges(s, d))))
query("g9_pagerank_plain", _ranks_sql(5, "1.0::DOUBLE", "0.15::DOUBLE + 0.85::DOUBLE * coalesce(got, 0)"))(lambda s, d: _rounded(graph.pagerank(edges(s, d), max_iter=5, mode="unnormalized")))
_routes = f"SELECT o AS src, dd AS dst, count(*) AS weight FROM (SELECT DISTINCT o, dd, l_linenumber FROM ({LEGS})) GROUP BY 1, 2"
query("g10_airport_pagerank", _ranks_sql(5, "1.0::DOUBLE", "0.15::DOUBLE + 0.85::DOUBLE * coalesce(got, 0)", _routes))(lambda s, d: _rounded(graph.airport_pagerank(legs(s, d).withColumn("delay", F.col("l_linenumber")), "o", "dd", "delay")))


@query("g11_mass_log")
def _(s, d):
    log: list = []
    graph.pagerank(edges(s, d), max_iter=3, log=log)
    return rows(s, [(i, float(m), float(total)) for i, m, total in log], "iteration int, missing double, total double")


# ---- regression by Gram matrices
_x, _y = ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"


def scaled(s, d):
    li = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", *_x, _y)
    return models.apply_scaler(li, models.fit_scaler(li, [*_x, _y]))


query("r1_scaler", "SELECT l_orderkey, l_linenumber, round((l_quantity - m) / sd, 9) AS z FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd FROM lineitem)")(lambda s, d: scaled(s, d).select("l_orderkey", "l_linenumber", F.round("l_quantity", 9).alias("z")))
query("r2_ols_loss", "SELECT round(avg(pow(1 + 2 * l_quantity + 3 * l_discount - l_tax - l_extendedprice, 2)), 1) AS loss FROM lineitem")(lambda s, d: models.ols_loss(t(s, d, "lineitem"), _x, _y, [1, 2, 3, -1]).select(F.round("loss", 1).alias("loss")))
query("r3_baseline", "SELECT round(avg(l_extendedprice), 6) AS mean_value FROM lineitem")(lambda s, d: t(s, d, "lineitem").agg(F.round(F.avg(_y), 6).alias("mean_value")))
query("r4_gd_step", "SELECT round(-0.1 * 2 * avg(0 - l_extendedprice), 4) AS w0, round(-0.1 * 2 * avg(-l_extendedprice * l_quantity), 3) AS w1 FROM lineitem")(lambda s, d: rows(s, [tuple(round(float(v), k) for v, k in zip(models.descend(models.gram(t(s, d, "lineitem"), ["l_quantity"], _y)[()], [0, 0], 1, 0.1)[0], (4, 3)))], "w0 double, w1 double"))


def _descent(s, d, reg):
    g = models.gram(scaled(s, d), _x, _y)[()]
    return rows(s, [(i, float(a), float(b)) for i, a, b in models.descend(g, [0.0] * 4, 50, 0.1, reg, 0.1, g)[1]], "step int, train double, test double")


for _reg in (None, "ridge", "lasso"):
    query(f"r{5 if _reg is None else 7}_descent_{_reg or 'plain'}")(lambda s, d, reg=_reg: _descent(s, d, reg))
query("r6_cv")(lambda s, d: rows(s, models.cv_descent(scaled(s, d).withColumn("fold", C.hash_bucket(F.col("l_orderkey"), 5)), _x, _y, "fold", 50, 0.1), "fold int, train double, test double"))
query("r8_residuals", "SELECT l_orderkey, l_linenumber, round(l_extendedprice - (100 + 1000 * l_quantity), 2) AS residual FROM lineitem")(lambda s, d: t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col(_y) - models.predict(["l_quantity"], [100, 1000]), 2).alias("residual")))
query("r9_sgd")(lambda s, d: rows(s, [(i, float(v)) for i, v in enumerate(models.sgd(scaled(s, d).withColumn("block", C.hash_bucket(F.col("l_orderkey"), 16)), _x, _y, "block", 64, 0.05))], "term int, weight double"))
query("r10_mape", "SELECT round(avg(abs((l_extendedprice - (100 + 1000 * l_quantity)) / l_extendedprice)) * 100, 6) AS mape FROM lineitem")(lambda s, d: models.mape(t(s, d, "lineitem").withColumn("pred", models.predict(["l_quantity"], [100, 1000])), _y, "pred"))

# ---- panel and categorical statistics
PANEL = "SELECT c_nationkey AS entity, year(o_orderdate)::INTEGER AS yr, avg(o_totalprice) / 1000 AS price, avg(c_acctbal) / 1000 AS bal, count(*)::DOUBLE AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"
panel = lambda s, d: t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("entity"), F.year("o_orderdate").alias("yr")).agg((F.avg("o_totalprice") / 1000).alias("price"), (F.avg("c_acctbal") / 1000).alias("bal"), F.count("*").cast("double").alias("n"))
terms = lambda s, r: rows(s, [tuple(x) for x in r], "term string, estimate double, se double" + (", t double, p double" if len(r[0]) == 5 else ""))
ORDERS2 = "SELECT (o_orderstatus = 'F')::INTEGER AS y, o_totalprice / 1e5 AS p, pow(o_totalprice / 1e5, 2) AS p2 FROM orders"
STEPS = "SELECT floor(o_totalprice / 20000) AS p, avg((o_orderstatus = 'F')::INTEGER) AS y, count(*) AS w FROM orders GROUP BY 1"
fitted = lambda df: df.select(*[c for c in df.columns if c not in ("estimate", "se")], F.round("estimate", 6).alias("estimate"), F.round("se", 6).alias("se"))


def terms_sql(clauses: str, x: list[str], group: str = "") -> str:
    """Rows (group, term, estimate, se) of ``fit``."""
    named = [("intercept", "b0", "sqrt(v0)"), *[(c, f"b{i + 1}", f"sqrt(v{i + 1})") for i, c in enumerate(x)], ("deviance", "dev", "NULL")]
    return f"WITH {clauses} " + " UNION ALL ".join(f"SELECT {f'g AS {group}, ' if group else ''}'{n}' AS term, round({b}, 6)::DOUBLE AS estimate, round({v}, 6)::DOUBLE AS se FROM fit" for n, b, v in named)


query("e1_panel_balance", f"SELECT entity, count(*) AS periods FROM ({PANEL}) GROUP BY 1")(lambda s, d: panel(s, d).groupBy("entity").agg(F.count("*").alias("periods")))


@query("e2_pooled_ols")
def _(s, d):
    p = panel(s, d)
    years = sorted(r["yr"] for r in p.select("yr").distinct().collect())[1:]
    p = p.withColumns({f"y{v}": (F.col("yr") == v).cast("double") for v in years})
    x = ["bal", "n", *[f"y{v}" for v in years]]
    return terms(s, models.ols(models.gram(p, x, "price")[()], ["intercept", *x]))


query("e3_fixed_effects", f"WITH p AS ({PANEL}), w AS (SELECT price - avg(price) OVER (PARTITION BY entity) AS y, bal - avg(bal) OVER (PARTITION BY entity) AS x FROM p) SELECT round(sum(x * y) / sum(x * x), 6) AS slope FROM w")(lambda s, d: rows(s, [(round(models.fixed_effects(panel(s, d), "entity", "price", ["bal"])[0][1], 6),)], "slope double"))


@query("e4_random_effects")
def _(s, d):
    r, h = models.random_effects(panel(s, d), "entity", "price", ["bal", "n"])
    return terms(s, [*r, ("hausman", h, None)])


query("e5_compare_periods", f"SELECT entity, round(max(CASE WHEN yr = 1996 THEN price END), 6) AS a, round(max(CASE WHEN yr = 1997 THEN price END), 6) AS b FROM ({PANEL}) GROUP BY 1")(lambda s, d: panel(s, d).groupBy("entity").agg(*[F.round(F.max(F.when(F.col("yr") == y, F.col("price"))), 6).alias(c) for y, c in ((1996, "a"), (1997, "b"))]))
binary = lambda s, d: t(s, d, "orders").select((F.col("o_orderstatus") == "F").cast("double").alias("y"), (F.col("o_totalprice") / 1e5).alias("p"), (F.pow(F.col("o_totalprice") / 1e5, 2)).alias("p2"))
query("e6_binomial_glm", terms_sql(solve.glm(STEPS, "y", ["p"], "binomial", weight="w"), ["p"]))(lambda s, d: fitted(terms(s, models.glm(t(s, d, "orders").groupBy(F.floor(F.col("o_totalprice") / 20000).cast("double").alias("p")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("y"), F.count("*").cast("double").alias("w")), "y", ["p"], "binomial", "w"))))
query("e7_logistic_glm", terms_sql(solve.glm(ORDERS2, "y", ["p", "p2"], "binomial"), ["p", "p2"]))(lambda s, d: fitted(terms(s, models.glm(binary(s, d), "y", ["p", "p2"], "binomial"))))
query("e7_logistic_by_group", terms_sql(solve.glm("SELECT o_orderpriority, (o_orderstatus = 'F')::INTEGER AS y, o_totalprice / 1e5 AS p FROM orders", "y", ["p"], "binomial", by="o_orderpriority"), ["p"], "o_orderpriority"))(lambda s, d: fitted(fits.fit_glm(t(s, d, "orders").select("o_orderpriority", (F.col("o_orderstatus") == "F").cast("double").alias("y"), (F.col("o_totalprice") / 1e5).alias("p")), "y", ["p"], "binomial", ["o_orderpriority"])))
query("e8_odds_ratios", f"WITH {solve.glm(ORDERS2, 'y', ['p'], 'binomial')}, o AS (SELECT 'intercept' AS term, b0 AS b, sqrt(v0) AS se FROM fit UNION ALL SELECT 'p', b1, sqrt(v1) FROM fit) SELECT term, round(exp(0.5 * b), 6) AS ratio, round(exp(0.5 * (b - 1.959963984540054 * se)), 6) AS lo, round(exp(0.5 * (b + 1.959963984540054 * se)), 6) AS hi FROM o")(lambda s, d: rows(s, models.odds_ratios(models.glm(binary(s, d), "y", ["p"], "binomial"), 0.5), "term string, ratio double, lo double, hi double").select("term", *[F.round(c, 6).alias(c) for c in ("ratio", "lo", "hi")]))


@query("e9_multinomial")
def _(s, d):
    li = t(s, d, "lineitem").select(*_x, F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0).alias("label"))
    li = models.feature.VectorAssembler(inputCols=_x, outputCol="features").transform(li)
    m = models.classification.LogisticRegression(family="multinomial", maxIter=20).fit(li)
    return rows(s, [(k, *map(float, m.coefficientMatrix.toArray()[k]), float(m.interceptVector[k])) for k in range(m.numClasses)], "class int, b1 double, b2 double, b3 double, intercept double")


query("e10_poisson_glm", terms_sql(solve.glm(PANEL, "n", ["price", "bal"], "poisson"), ["price", "bal"]))(lambda s, d: fitted(terms(s, models.glm(panel(s, d), "n", ["price", "bal"], "poisson"))))
COUNTS = "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1"
query("e11_poisson_fit_all", f"WITH c AS ({COUNTS}), m AS (SELECT avg(n) AS m, count(*) AS total FROM c) SELECT n AS x, count(*) AS n, round(count(*) / any_value(total), 9) AS observed, round(exp(n * ln(any_value(m)) - any_value(m) - lgamma(n + 1)), 9) AS expected FROM c, m GROUP BY c.n")(lambda s, d: models.poisson_fit_check(t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("c")), "c"))
query("e12_proportion_ci", f"WITH k AS (SELECT l_suppkey, sum(late) AS w, count(*) AS n, 1.959963984540054 AS z FROM ({LATE}) GROUP BY 1), q AS (SELECT *, w / n AS r FROM k) SELECT l_suppkey, n, round(r, 9) AS rate, round(r - z * sqrt(r * (1 - r) / n), 9) AS wald_lo, round(r + z * sqrt(r * (1 - r) / n), 9) AS wald_hi, round((w + z * z / 2) / (n + z * z) - z * sqrt(n) / (n + z * z) * sqrt(r * (1 - r) + z * z / (4 * n)), 9) AS wilson_lo, round((w + z * z / 2) / (n + z * z) + z * sqrt(n) / (n + z * z) * sqrt(r * (1 - r) + z * z / (4 * n)), 9) AS wilson_hi FROM q")(lambda s, d: models.proportion_ci(late(s, d), ["l_suppkey"], "late"))
query("e13_simple_ols", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2 FROM lineitem GROUP BY 1")(lambda s, d: t(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope(_y, "l_quantity"), 6).alias("slope"), F.round(F.regr_intercept(_y, "l_quantity"), 4).alias("intercept"), F.round(F.regr_r2(_y, "l_quantity"), 9).alias("r2")))


@query("x4_bootstrap")
def _(s, d):
    b = t(s, d, "orders").groupBy(F.floor(F.col("o_totalprice") / 50000).alias("p")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k")).orderBy("p").collect()  # a row for each price step
    np = models.np
    x, n, k = (np.array([float(r[c]) for r in b]) for c in ("p", "n", "k"))
    beta = models.irls(np.column_stack([np.ones(len(x)), x]), k, n)
    return models.parametric_bootstrap(s, x.tolist(), n.tolist(), beta.tolist(), 1000, [1.0, 5.0])


# ---- series
query("y1_filter_index", f"SELECT key, day FROM ({DAILY}) WHERE day >= '2024-01-05' AND day < '2024-02-01'")(lambda s, d: Y.filter_index(daily(s, d), "day", "2024-01-05", "2024-02-01").select("key", "day"))
query("y2_trend_fit", f"WITH s AS ({DAILY}), f AS (SELECT key, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM s GROUP BY 1) SELECT key, round(any_value(b), 6) AS slope, round(any_value(a), 6) AS intercept, round(sqrt(avg(pow(value - a - b * t, 2))), 6) AS rmse FROM s JOIN f USING (key) GROUP BY key")(lambda s, d: Y.trend_fit(daily(s, d)))
query("y3_seasonal_profile", "SELECT event_type, hour(ts)::INTEGER AS h, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")(lambda s, d: t(s, d, "events").groupBy("event_type", F.hour("ts").alias("h")).agg(F.round(F.avg("value"), 6).alias("mean_value")))
ACF = f"WITH s AS ({DAILY}), z AS (SELECT key, t, value - avg(value) OVER (PARTITION BY key) AS z FROM s), c AS (SELECT key, sum(z * z) AS c0, count(*) AS n FROM z GROUP BY 1), r AS (SELECT a.key, c.n, l.lag::INTEGER AS lag, round(sum(a.z * b.z) / any_value(c0), 6) AS r FROM z a JOIN (SELECT unnest(range(1, 6)) AS lag) l ON true LEFT JOIN z b ON a.key = b.key AND b.t = a.t - l.lag JOIN c ON c.key = a.key GROUP BY a.key, c.n, l.lag)"
query("y4_acf", f"{ACF} SELECT key, n, lag, r FROM r")(lambda s, d: Y.acf(daily(s, d), 5))
query("y5_ljung_box", f"{ACF} SELECT key, round(any_value(n) * (any_value(n) + 2) * sum(r * r / (n - lag)), 4) AS q FROM r GROUP BY 1")(lambda s, d: Y.ljung_box(daily(s, d), 5))
query("y6_baselines", f"WITH s AS ({DAILY}), e AS (SELECT key, avg(value) AS m, arg_max(value, t) AS l, arg_min(value, t) AS f, count(*) AS n FROM s GROUP BY 1) SELECT key, step::INTEGER AS step, round(m, 6) AS mean_fc, round(l, 6) AS naive_fc, round(l + step * coalesce((l - f) / nullif(n - 1, 0), 0), 6) AS drift_fc FROM e, (SELECT unnest(range(1, 6)) AS step)")(lambda s, d: Y.baseline_forecast(daily(s, d), 5))
query("y7_forecast_cv", f"WITH s AS ({DAILY}), o AS (SELECT a.key, a.t, a.value, (SELECT avg(value) FROM s b WHERE b.key = a.key AND b.t <= a.t) AS m, (SELECT value FROM s b WHERE b.key = a.key AND b.t = 1) AS f FROM s a WHERE a.t >= 3) SELECT h::INTEGER AS step, round(sqrt(avg(pow(y.value - m, 2))), 6) AS mean_rmse, round(sqrt(avg(pow(y.value - o.value, 2))), 6) AS naive_rmse, round(sqrt(avg(pow(y.value - (o.value + h * (o.value - f) / (o.t - 1)), 2))), 6) AS drift_rmse FROM o, (SELECT unnest(range(1, 9)) AS h) hh JOIN s y ON y.key = o.key AND y.t = o.t + h GROUP BY 1")(lambda s, d: Y.forecast_cv(daily(s, d)))
query("y8_accuracy", "SELECT l_returnflag, round(avg(e), 6) AS me, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(100 * avg(e / l_extendedprice), 6) AS mpe, round(100 * avg(abs(e / l_extendedprice)), 6) AS mape FROM (SELECT *, l_extendedprice - (100 + 1000 * l_quantity) AS e FROM lineitem) GROUP BY 1")(lambda s, d: Y.forecast_accuracy(t(s, d, "lineitem").withColumn("pred", models.predict(["l_quantity"], [100, 1000])), _y, "pred", ["l_returnflag"]))
query("y9_split_tail", f"WITH s AS ({DAILY}) SELECT key, t, row_number() OVER (PARTITION BY key ORDER BY t DESC) <= 5 AS held_out FROM s")(lambda s, d: Y.split_tail(daily(s, d), 5).select("key", "t", "held_out"))
query("y10_long_wide", "SELECT c_custkey, c_acctbal AS a, c_nationkey::DOUBLE AS b FROM customer")(lambda s, d: Y.to_wide(Y.to_long(t(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("a"), F.col("c_nationkey").cast("double").alias("b")), "c_custkey", ["a", "b"]), "c_custkey", ["a", "b"]))

# ---- MLlib
_num, _cat = ["l_quantity", "l_extendedprice", "l_discount"], ["l_linestatus", "l_linenumber_s"]
flights = lambda s, d: R.hash_split(t(s, d, "lineitem").withColumns({"label": (F.col("l_returnflag") == "R").cast("double"), "l_linenumber_s": F.col("l_linenumber").cast("string")}), "l_orderkey", [0.8, 0.2])


@query("m1_features")
def _(s, d):
    from pyspark.ml.functions import vector_to_array

    f = flights(s, d)
    return models.feature_pipeline(_num, _cat, 2).fit(f).transform(f).select("l_orderkey", "l_linenumber", vector_to_array("features").alias("features"))


query("m3_class_weights", f"SELECT late, round(any_value(CASE WHEN late = 1 THEN r ELSE 1 - r END), 9) AS w, count(*) AS n FROM ({LATE}), (SELECT 1 - avg(late) AS r FROM ({LATE})) GROUP BY 1")(lambda s, d: models.class_weights(late(s, d), "late").groupBy("late").agg(F.round(F.first("class_weight"), 9).alias("w"), F.count("*").alias("n")))
for _id, _kind in (("m4", "forest"), ("m5", "logistic"), ("m7", "tree")):
    def _scored(s, d, kind=_kind):
        f = flights(s, d)
        return models.train_and_score(f.where("split = 0"), f.where("split = 1"), "label", kind, models.tree_pipeline(_num, _cat))

    query(f"{_id}_{_kind}")(lambda s, d, g=_scored: T.binary_metrics(g(s, d), "label", "prediction"))


def _cells_scored(s, d, kind):
    f = flights(s, d)
    return T.binary_metrics(models.score_cells(f.where("split = 0"), f.where("split = 1"), "label", kind, models.tree_pipeline(_num, _cat)), "label", "prediction", "n")


query("m8_boosted")(lambda s, d: _cells_scored(s, d, "boosted"))


@query("m6_linear")
def _(s, d):
    li = models.feature.VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(t(s, d, "lineitem"))
    m = models.regression.LinearRegression(labelCol=_y, regParam=0.2, elasticNetParam=1.0).fit(li)
    return rows(s, [(float(m.summary.r2), *map(float, m.coefficients))], "r2 double, b1 double, b2 double, b3 double")


@query("m9_roc_auc")
def _(s, d):
    f = flights(s, d)
    return rows(s, [(models.roc_auc(models.train_and_score(f.where("split = 0"), f.where("split = 1"), "label", "logistic", models.tree_pipeline(_num, _cat)), "label"),)], "auc double")


@query("m11_pca_variance")
def _(s, d):
    from pyspark.ml.functions import array_to_vector

    e = t(s, d, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    v = models.feature.PCA(k=5, inputCol="v", outputCol="p").fit(e).explainedVariance.toArray().cumsum()
    return rows(s, [(k + 1, float(x)) for k, x in enumerate(v)], "k int, cumulative double")


_hot = ["l_returnflag", "l_linestatus", "l_linenumber"]
_pairs = " UNION ALL ".join(f"SELECT '{a}' AS a_column, {a}::VARCHAR AS a, '{b}' AS b_column, {b}::VARCHAR AS b, count(*) AS n FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}" for i, a in enumerate(_hot) for b in _hot[i:])
query("m11_one_hot_counts", _pairs)(lambda s, d: fits.one_hot_counts(t(s, d, "lineitem"), _hot))
query("m11_one_hot_variance")(lambda s, d: rows(s, fits.one_hot_variance(t(s, d, "lineitem"), _hot), "k int, cumulative double"))


@query("m12_grid_search")
def _(s, d):
    g = models.gram(flights(s, d), _x, _y, ["split"])
    train, dev, out = g[(0,)], g[(1,)], []
    for kind, alpha in (("lasso", 0.1), ("lasso", 1.0), ("ridge", 1.0), ("ridge", 10.0)):
        w = fits.elastic_net(train, alpha / (train[0, 0] if kind == "ridge" else 1), float(kind == "lasso"))
        out.append((kind, alpha, *fits.held_out(dev, w)))
    return rows(s, out, "model string, alpha double, mse double, r2 double")


@query("m13_tree_regressor")
def _(s, d):
    f = models.feature.VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(flights(s, d))
    m = models.regression.DecisionTreeRegressor(labelCol=_y, maxDepth=10, minInstancesPerNode=22).fit(f.where("split = 0"))
    return models.regression_metrics(m.transform(f.where("split = 1")), _y, "prediction")


_near = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE embedding IS NOT NULL), r AS (SELECT a.vec_id AS q, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(abs(list_inner_product(a.v, a.v) - 2 * list_inner_product(a.v, b.v) + list_inner_product(b.v, b.v)), 9), b.vec_id) AS rn FROM e a JOIN e b ON a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0), knn AS (SELECT q, k::INTEGER AS k, avg(label) AS pred FROM r, (SELECT unnest(range(1, 11)) AS k) WHERE rn <= k GROUP BY 1, 2)"
query("m14_knn", f"{_near} SELECT q, k, round(pred, 9) AS pred FROM knn")(lambda s, d: fits.knn_regress(t(s, d, "embeddings").where("vec_id % 20 != 0"), t(s, d, "embeddings").where("vec_id % 20 = 0"), "vec_id", "embedding", "label", list(range(1, 11))).select("q", "k", F.round("pred", 9).alias("pred")))
query("m15_regression_metrics", "SELECT round(avg(pow(l_extendedprice - (100 + 1000 * l_quantity), 2)), 6) AS mse, round(avg(abs(l_extendedprice - (100 + 1000 * l_quantity))), 6) AS mae, round(1 - sum(pow(l_extendedprice - (100 + 1000 * l_quantity), 2)) / (var_pop(l_extendedprice) * count(*)), 9) AS r2 FROM lineitem")(lambda s, d: models.regression_metrics(t(s, d, "lineitem").withColumn("pred", models.predict(["l_quantity"], [100, 1000])), _y, "pred"))

# ---- wider forms of the operators above
query("j2_add_station", "SELECT o_orderkey, l_linenumber, a.n_name AS origin_n_name, b.n_name AS dest_n_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation a ON a.n_nationkey = s_nationkey AND a.n_regionkey = s_nationkey % 5 JOIN nation b ON b.n_nationkey = c_nationkey AND b.n_regionkey = c_nationkey % 5")(lambda s, d: R.add_station(R.add_station(R.lookup(t(s, d, "lineitem").join(t(s, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey")), t(s, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select("o_orderkey", "l_linenumber", "s_nationkey", "c_nationkey", (F.col("s_nationkey") % 5).alias("s_state"), (F.col("c_nationkey") % 5).alias("c_state")), t(s, d, "nation"), {"s_nationkey": "n_nationkey", "s_state": "n_regionkey"}, "origin"), t(s, d, "nation"), {"c_nationkey": "n_nationkey", "c_state": "n_regionkey"}, "dest").select("o_orderkey", "l_linenumber", "origin_n_name", "dest_n_name"))
query("w3_carry_over_arrival", "WITH w AS (SELECT *, ts + INTERVAL 30 MINUTES AS arr, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts, rank() OVER (PARTITION BY user_id ORDER BY ts) AS rnk FROM events WHERE user_id IS NOT NULL), o AS (SELECT *, CASE WHEN (epoch(next_ts)::BIGINT - epoch(arr)::BIGINT) / 60 <= 5000 THEN value ELSE 0 END AS own FROM w) SELECT event_id, CASE WHEN rnk <= 2 THEN 0 ELSE coalesce(lag(own, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) END::DOUBLE AS carried FROM o")(lambda s, d: R.carry_over_delay(t(s, d, "events").withColumn("arr", F.col("ts") + F.expr("INTERVAL 30 MINUTES")), "user_id", "ts", "event_id", "value", 5000, arrival="arr").select("event_id", "carried"))
_models = {"steep": [100.0, 1000.0], "flat": [20000.0, 10.0]}
query("r8_compare_models", "SELECT model, round(avg(pow(l_extendedprice - (a + b * l_quantity), 2)), 2) AS mse, round(avg(abs(l_extendedprice - (a + b * l_quantity))), 4) AS mae FROM lineitem, (VALUES ('steep', 100, 1000), ('flat', 20000, 10)) m(model, a, b) GROUP BY 1")(lambda s, d: models.compare_models(t(s, d, "lineitem"), ["l_quantity"], _y, _models).select("model", F.round("mse", 2).alias("mse"), F.round("mae", 4).alias("mae")))
blocked = lambda s, d, df: models.blocks(df, ["l_orderkey", "l_linenumber"], 1000)
query("r9_blocks", "SELECT block, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM (SELECT l_orderkey, ((row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1) // 1000)::BIGINT AS block FROM lineitem) GROUP BY 1")(lambda s, d: blocked(s, d, t(s, d, "lineitem").select("l_orderkey", "l_linenumber")).groupBy("block").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys")))
query("r9_sgd_blocks")(lambda s, d: rows(s, [(i, float(v)) for i, v in enumerate(models.sgd(blocked(s, d, scaled(s, d)), _x, _y, "block", None, 0.05))], "term int, weight double"))
query("e1_panel_periods", f"SELECT yr, count(*) AS entities FROM ({PANEL}) GROUP BY 1")(lambda s, d: panel(s, d).groupBy("yr").agg(F.count("*").alias("entities")))
price_steps = lambda s, d: t(s, d, "orders").groupBy(F.floor(F.col("o_totalprice") / 20000).cast("double").alias("p")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("y"), F.count("*").cast("double").alias("w")).withColumn("p2", F.col("p") * F.col("p"))
query("e6_likelihood_ratio")(lambda s, d: rows(s, [models.likelihood_ratio(*[models.glm(price_steps(s, d), "y", x, "binomial", "w") for x in (["p"], ["p", "p2"])])], "deviance_small double, deviance_large double, lr double, df int, p double"))


@query("e7_predict_ci")
def _(s, d):
    x = ["p", "q", "p_q"]
    o = t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("double").alias("y"), (F.col("o_totalprice") / 1e5).alias("p"), (F.col("c_acctbal") / 1e4).alias("q")).withColumn("p_q", F.col("p") * F.col("q"))
    fit = models.glm(o, "y", x, "binomial")
    beta = [fit[3][1], *[r[1] for r in fit[:3]]]
    return models.predict_ci(o, x, beta, models.logit_covariance(o, x, beta)).select("o_orderkey", "prob", "lo", "hi")


_coefs = [[0.1, 0.02, 1.0, 0.5], [0.5, -0.01, 0.0, 2.0], [0.0, 0.0, 0.0, 0.0]]
flags = lambda s, d: t(s, d, "lineitem").select(*_x, F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("label"))
query("e9_loglik", "WITH e AS (SELECT 0.1 + 0.02 * l_quantity + l_discount + 0.5 * l_tax AS a, 0.5 - 0.01 * l_quantity + 2 * l_tax AS b, l_returnflag AS f FROM lineitem) SELECT round(sum(CASE f WHEN 'A' THEN a WHEN 'N' THEN b ELSE 0 END - ln(exp(a) + exp(b) + 1)), 4) AS loglik FROM e")(lambda s, d: models.multinomial_loglik(flags(s, d), _x, "label", _coefs).select(F.round("loglik", 4).alias("loglik")))


@query("e9_grid_probabilities")
def _(s, d):
    li = flags(s, d)
    m = models.classification.LogisticRegression(family="multinomial", maxIter=20).fit(models.feature.VectorAssembler(inputCols=_x, outputCol="features").transform(li))
    coefs = [[float(m.interceptVector[k]), *map(float, m.coefficientMatrix.toArray()[k])] for k in range(m.numClasses)]
    means = li.agg(*[F.avg(c).alias(c) for c in _x[1:]])
    grid = li.select(_x[0]).distinct().crossJoin(F.broadcast(means))
    return grid.select(_x[0], *[c.alias(f"p{k}") for k, c in enumerate(models.multinomial_probabilities(_x, coefs))])


_trait = "CASE WHEN bal > 4.5 THEN 'High' ELSE 'Low' END"
query("e10_poisson_by_group", f"SELECT *, CASE WHEN se IS NOT NULL THEN round(100 * (exp(estimate) - 1), 4) END AS percent_change FROM ({terms_sql(solve.glm(PANEL, 'n', ['price'], 'poisson', by=_trait), ['price'], 'trait')})")(lambda s, d: fitted(fits.fit_glm(panel(s, d).withColumn("trait", F.expr(_trait)), "n", ["price"], "poisson", ["trait"])).withColumn("percent_change", F.when(F.col("se").isNotNull(), F.round(100 * F.expm1("estimate"), 4))))
query("e11_poisson_moments", f"SELECT round(avg(n), 9) AS mean_n, round(var_samp(n), 9) AS var_n, round(avg(n) - 1.959963984540054 * sqrt(avg(n) / count(*)), 9) AS lo, round(avg(n) + 1.959963984540054 * sqrt(avg(n) / count(*)), 9) AS hi FROM ({COUNTS})")(lambda s, d: models.poisson_moments(t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("c")), "c"))
query("y2_trend_season")(lambda s, d: Y.trend_season_fit(daily(s, d), 3, F.dayofweek("day"), 7, F.col("day").between("2024-01-10", "2024-01-12")))
query("y2_trend_log")(lambda s, d: Y.trend_season_fit(daily(s, d), 2, log=True))
_line = f"WITH s AS ({DAILY}), f AS (SELECT key, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM s GROUP BY 1), e AS (SELECT key, day, t, value - a - b * t AS value FROM s JOIN f USING (key))"
query("y2_residuals", f"{_line} SELECT key, day, t, round(value, 6) AS residual FROM e")(lambda s, d: Y.trend_residuals(daily(s, d)).select("key", "day", "t", F.round("value", 6).alias("residual")))
query("y5_ljung_box_residuals", f"{_line}, z AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM e), r AS (SELECT a.key, lag, any_value(a.n) AS n, sum(a.value * b.value) / (SELECT sum(value * value) FROM z c WHERE c.key = a.key) AS r FROM z a JOIN (SELECT unnest(range(1, 6)) AS lag) l ON true JOIN z b ON a.key = b.key AND b.t = a.t + lag GROUP BY 1, 2) SELECT key, round(any_value(n) * (any_value(n) + 2) * sum(r * r / (n - lag)), 4) AS q FROM r GROUP BY 1")(lambda s, d: Y.ljung_box(Y.trend_residuals(daily(s, d)), 5))
query("y4_ccf", f"WITH s AS ({DAILY}), p AS (SELECT a.day, a.value AS x, b.value AS y FROM s a JOIN s b ON a.day = b.day WHERE a.key = 'click' AND b.key = 'view'), m AS (SELECT avg(x) AS mx, avg(y) AS my, count(*) * stddev_pop(x) * stddev_pop(y) AS c FROM p) SELECT lag::INTEGER AS lag, round(sum((a.x - mx) * (b.y - my)) / any_value(c), 6) AS r FROM p a, p b, m, (SELECT unnest(range(-5, 6)) AS lag) l WHERE a.day = b.day + lag::INTEGER GROUP BY lag")(lambda s, d: Y.ccf(daily(s, d), "click", "view", 5).select("lag", F.round("r", 6).alias("r")))


@query("m2_tree_features")
def _(s, d):
    from pyspark.ml.functions import vector_to_array

    f = flights(s, d)
    return models.tree_pipeline(_num, _cat).fit(f.where("split = 0")).transform(f).select("l_orderkey", "l_linenumber", "split", vector_to_array("features").alias("features"))


query("m4_importance")(lambda s, d: rows(s, models.feature_importance(flights(s, d).where("split = 0"), "label", _num, _cat), "feature string, importance double"))


@query("m4_forest_deep")
def _(s, d):
    f = flights(s, d)
    return T.binary_metrics(models.train_and_score(f.where("split = 0"), f.where("split = 1"), "label", "forest_deep", models.tree_pipeline(_num, _cat)), "label", "prediction")


@query("m10_house_features", "SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) AS f0, round((l_discount - md) / sd, 6) AS f1, round(ln(l_extendedprice), 6) AS f2, (l_returnflag = 'A')::INTEGER::DOUBLE AS f3, (l_returnflag = 'N')::INTEGER::DOUBLE AS f4, (l_returnflag = 'R')::INTEGER::DOUBLE AS f5, (l_linestatus = 'F')::INTEGER::DOUBLE AS f6, (l_linestatus = 'O')::INTEGER::DOUBLE AS f7 FROM lineitem, (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(l_discount) AS md, stddev_samp(l_discount) AS sd FROM lineitem)")
def _(s, d):
    from pyspark.ml.functions import vector_to_array

    li = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "l_returnflag", "l_linestatus")
    made = models.house_features(li, ["l_quantity", "l_discount"], "l_extendedprice", ["l_returnflag", "l_linestatus"]).withColumn("f", vector_to_array("features"))
    return made.select("l_orderkey", "l_linenumber", *[F.round(F.col("f")[k], 6).alias(f"f{k}") for k in range(8)])


_fold = lambda k, n: f"(('0x' || substr(md5({k}::VARCHAR), 1, 8))::BIGINT % {n})::INTEGER"
folded = lambda s, d: t(s, d, "lineitem").withColumn("fold", C.hash_bucket(F.col("l_orderkey"), 3))
_by_fold = lambda s, d, mixes: rows(s, fits.grid_by_fold(folded(s, d), _x, _y, "fold", [0.1, 1.0, 10.0], mixes), "fold int, reg double, mix double, mse double, r2 double")
query("m12_cross_validated")(lambda s, d: _by_fold(s, d, [0.0, 0.5, 1.0]).groupBy("reg", "mix").agg(F.avg("r2").alias("r2")))
query("m12_ridge_folds", f"WITH {solve.ridge('SELECT * FROM lineitem', _y, _x, _fold('l_orderkey', 3), [0.1, 1.0, 10.0])} SELECT fold, reg, round(mse, 1) AS mse, round(r2, 9) AS r2 FROM scored")(lambda s, d: _by_fold(s, d, [0.0]).select("fold", "reg", F.round("mse", 1).alias("mse"), F.round("r2", 9).alias("r2")))


@query("m14_knn_scores", f"{_near} SELECT k, round(avg(pow(label - pred, 2)), 6) AS mse, round(1 - avg(pow(label - pred, 2)) / var_pop(label), 6) AS r2 FROM knn JOIN embeddings ON q = vec_id GROUP BY k")
def _(s, d):
    truth = t(s, d, "embeddings").select(F.col("vec_id").alias("q"), F.col("label").cast("double").alias("y"))
    scored = CATALOG["m14_knn"][0](s, d).join(truth, "q")
    e = F.col("y") - F.col("pred")
    return scored.groupBy("k").agg(F.round(F.avg(e * e), 6).alias("mse"), F.round(F.try_divide(F.var_pop("y") - F.avg(e * e), F.var_pop("y")), 6).alias("r2"))
