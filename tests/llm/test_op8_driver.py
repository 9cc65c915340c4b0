"""op8: urls with a hit that are too many to broadcast are not broadcast by Spark's guess of their files' size either."""

from pyspark.sql import functions as F

from quarryline.llm import urls


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_hits_are_shuffled(spark):
    pages = spark.range(2_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.example.com/en/"), F.col("id")).alias("url"))
    rules = urls.rule_table(spark)
    few, many = urls.judge(pages, rules), urls.judge(pages, rules, hit_bytes=0)
    assert "BroadcastHashJoin" in plan_of(few)
    assert "SortMergeJoin" in plan_of(many) and "Broadcast" not in plan_of(many)
    assert sorted(few.collect()) == sorted(many.collect()) and few.where("verdict = 'block'").count() == 2_000
