"""Tables whose short rows become long records are dealt over tasks by their number of rows, not by their bytes."""

from leadloom.plans import catalogue


def test_tasks_of_leads_follow_the_rows(spark, tmp_path):
    spark.range(100_000).selectExpr("id AS c_custkey", "CAST(id % 5 AS INT) AS c_nationkey", "'BUILDING' AS c_mktsegment", "CAST(id % 900 AS DOUBLE) AS c_acctbal").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(5).selectExpr("CAST(id AS INT) AS n_nationkey", "concat('N', id) AS n_name").write.parquet(f"{tmp_path}/nation.parquet")
    leads = catalogue._leads(spark, str(tmp_path), "hvac")
    sizes = [n for n in leads.select("ord").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(sizes) == 100_000 and len(sizes) >= 5 and max(sizes) <= 30_000
