import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casework.operators import reconcile
from casework.plans.flow import CaseFlow, Stage, Watch

AS_OF = dt.date(2024, 6, 30)
ITEMS = "item long, customer string, due_on date, current_level int, note string"
LEVELS = "customer string, level int, from_days int, valid_from date, valid_to date"


def brute(items, levels):
    known = {c for c, *_ in levels if c is not None}
    got = {}
    for item, customer, due, current, _ in items:
        days = (AS_OF - due).days if due else None
        mine = [x for x in levels if x[0] == (customer if customer in known else None)]
        reached = [lv for _, lv, start, a, b in mine if due and days >= start and (a is None or a <= due) and (b is None or due < b)]
        level = max([0, *reached])
        got[item] = (max(days, 0) if due else 0, level, level > (current or 0))
    return got


def random_tables(seed):
    rng = random.Random(seed)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 1800))
    names = ["hot", "a", "b", "c", "stranger", None]
    items = [(i, rng.choice(["hot"] * 4 + names), rng.choice([day(), day(), None]) if i % 7 == 0 else day(), rng.choice([0, 1, 2, None]), "n") for i in range(400)]
    levels = []
    for _ in range(40):
        a, b = sorted((day(), day()))
        levels.append((rng.choice(["hot", "a", "b", None]), rng.randint(1, 6), rng.randint(-20, 900), rng.choice([a, None]), rng.choice([b, None])))
    levels += [("c", 1, 0, dt.date(2020, 1, 1), dt.date(2020, 1, 1)), ("hot", 6, 10, dt.date(2021, 12, 31), dt.date(2022, 1, 1))]
    return items, levels


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0, "rows_per_task": 60}])
def test_levels_of_a_table_equal_looking_them_up(spark, options):
    items, levels = random_tables(3)
    aged = reconcile.age_open_items_by(spark.createDataFrame(items, ITEMS), spark.createDataFrame(levels, LEVELS), F.lit(AS_OF), **options)
    assert aged.columns == ["item", "customer", "due_on", "current_level", "note", "days_overdue", "dunning_level", "escalate"]
    rows = aged.collect()
    got = {r.item: (r.days_overdue if r.due_on else 0, r.dunning_level, r.escalate) for r in rows}
    assert got == brute(items, levels) and len(rows) == len(items)
    plan = aged._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_levels_and_no_items(spark):
    items, levels = random_tables(4)
    df, table = spark.createDataFrame(items, ITEMS), spark.createDataFrame(levels, LEVELS)
    none = reconcile.age_open_items_by(df, table.limit(0), F.lit(AS_OF))
    assert {r.dunning_level for r in none.collect()} == {0}
    assert reconcile.age_open_items_by(df.limit(0), table, F.lit(AS_OF)).count() == 0


def says(name, change=lambda df: df):
    return Stage(name, lambda df: change(df).withColumn("summary", F.lit(name)))


def test_a_watch_counts_in_the_job_of_the_run(spark):
    cases = spark.range(100).select(F.col("id").alias("case_id"), F.lit("t").alias("task"))
    swapped = says("swapped", lambda df: df.where("case_id <> 3").union(df.where("case_id = 4")))
    flow = CaseFlow([says("fine"), says("even", lambda df: df.where("case_id < 50")), swapped, says("last")])
    watch = Watch()
    df = flow.run(cases, watch)
    tracker, group = spark.sparkContext.statusTracker(), "watched"
    spark.sparkContext.setJobGroup(group, "one run")
    assert df.count() == 50
    before = len(tracker.getJobIdsForGroup(group))
    got = [tuple(r) for r in watch.report(spark).collect()]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # One more case and one less: their number is the same, their ids are not.
    assert got == [(0, "fine", 100, 100, True), (1, "even", 100, 50, False), (2, "swapped", 50, 50, False), (3, "last", 50, 50, True)]
    assert len(tracker.getJobIdsForGroup(group)) - before <= 1


def test_a_watch_over_no_cases(spark):
    cases = spark.range(0).select(F.col("id").alias("case_id"), F.lit("t").alias("task"))
    watch = Watch()
    CaseFlow([says("fine")]).run(cases, watch).write.format("noop").mode("overwrite").save()
    assert [tuple(r) for r in watch.report(spark).collect()] == [(0, "fine", 0, 0, True)]
