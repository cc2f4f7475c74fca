"""Components take few stages a round (op11 on check_h has 211 tasks in each)."""

from leadloom.llm import linking


def test_components_take_few_stages(spark):
    sc = spark.sparkContext
    links = spark.createDataFrame([(i, i // 2 * 2 + i % 3) for i in range(60)] + [(None, 6), (70, None), (80, 81), (80, 81), (90, 90)], "a long, b long")
    sc.setJobGroup("components", "components")
    try:
        got = {r.node: r.component for r in linking.components(links).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    edges = [(r.a, r.b) for r in links.collect() if r.a is not None and r.b is not None and r.a != r.b]
    label = {x: x for edge in edges for x in edge}
    for _ in edges:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label
    told = sc.statusTracker()
    stages = {s for j in told.getJobIdsForGroup("components") for s in told.getJobInfo(j).stageIds}
    run = sum(1 for s in stages if (info := told.getStageInfo(s)) and info.numCompletedTasks)
    assert run <= 22, run  # 27 for the same links but the last four, when each round had two joins beside the aggregate
    again = linking.components(linking.stars(spark.createDataFrame(list(got.items()), "node long, component long")))
    assert {r.node: r.component for r in again.collect()} == got


def test_small_tables_take_few_tasks(spark):
    """Tables of a few documents are held in a few partitions, however many partitions the session has."""
    from leadloom.llm.metricjoin import components_of

    key = "spark.sql.shuffle.partitions"
    before, off = spark.conf.get(key), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set(key, "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tracker = spark.sparkContext.statusTracker()
    try:
        rows = [(i, " ".join(f"w{i // 4}_{j}" for j in range(60)) + f" end{i % 4}") for i in range(80)]
        spark.sparkContext.setJobGroup("few", "few")
        got = {r.doc_id: r.component_id for r in components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("few") for s in tracker.getJobInfo(j).stageIds]
        tasks = sum(s.numCompletedTasks for s in stages if s)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set(key, before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", off)
    assert got == {i: i - i % 4 for i in range(80)}
    assert tasks < 2000, tasks  # 3636 with a task for each partition in each step


def test_no_stage_outlives_its_action(spark):
    """Shuffles are dropped at an action's end, so an action must not end while one side of a join still runs because the other
    is empty: tasks on executors then waited for shuffles that were gone (op11 on check_h hung by this)."""
    from pyspark.sql import functions as F

    from leadloom.llm.common import shuffles_dropped

    key = "spark.sql.adaptive.optimizer.excludedRules"
    rules = spark.conf.get(key, None)
    with shuffles_dropped(spark):
        none, some = spark.range(1000).filter(F.xxhash64("id") % 7 > 10), spark.range(1000)
        both = none.hint("merge").join(some.hint("merge"), "id")
        assert both.collect() == []
        final = both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in final, final
    assert spark.conf.get(key, None) == rules
