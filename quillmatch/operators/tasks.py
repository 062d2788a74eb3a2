"""The work queue: tasks from matches, assignment by dependents, transitions and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PENDING, ASSIGNED, COMPLETED, BLOCKED = "pending", "assigned", "completed", "blocked"
STATUSES = (PENDING, ASSIGNED, COMPLETED, BLOCKED)
#: What an event does to the task that it is about.
TRANSITIONS = {"click": ASSIGNED, "purchase": COMPLETED, "error": BLOCKED, "signup": PENDING}


def init(matches: DataFrame, missing: DataFrame) -> DataFrame:
    """key, dependents, status and order: the missing units, and the pairs below 0.85 or with marks, by dependents."""
    weak = matches.filter((F.col("similarity") < 0.85) | (F.col("todos") > 0) | (F.col("lint") > 0) | F.col("stub")).select(F.col("src").alias("key"), "dependents")
    all_ = missing.select("key", "dependents").unionByName(weak).groupBy("key").agg(F.max("dependents").alias("dependents"))
    return all_.withColumn("status", F.lit(PENDING))


def assign(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """key and agent: the pending tasks with the most dependents, one for each agent, in order of both."""
    t = tasks.filter(F.col("status") == PENDING)
    most = agents.count()
    top = t.orderBy(F.desc("dependents"), "key").limit(most)
    number = lambda d, *by: d.withColumn("n", F.row_number().over(Window.orderBy(*by)))
    # both sides are as many rows as there are agents, so the ordering on one partition is of a bounded size
    return number(top, F.desc("dependents"), "key").join(number(agents, "agent"), "n").select("key", "dependents", "agent")


def transition(status: Column, event: Column) -> Column:
    return F.coalesce(F.create_map([F.lit(x) for kv in TRANSITIONS.items() for x in kv])[event], status)


def current(events: DataFrame) -> DataFrame:
    """task and status after its last event that changes one."""
    known = events.withColumn("status", F.create_map([F.lit(x) for kv in TRANSITIONS.items() for x in kv])[F.col("event_type")]).filter("status IS NOT NULL")
    return known.groupBy("task").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("changes"))


def stats(tasks: DataFrame) -> DataFrame:
    n = tasks.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))
    return n


def may_complete(similarity: Column, todos: Column, stubs: Column) -> Column:
    return (similarity >= 0.85) & (todos == 0) & (stubs == 0)


def may_release(similarity: Column) -> Column:
    return similarity >= 0.5


def rescan(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tasks of a new scan; those that are assigned or completed keep their status, even if the scan lacks them."""
    held = F.col("old_status").isin(ASSIGNED, COMPLETED)
    j = old.select("key", F.col("status").alias("old_status"), F.col("dependents").alias("old_dependents")).join(new.select("key", "dependents"), "key", "full_outer")
    return j.filter(F.col("dependents").isNotNull() | held).select("key", F.coalesce("dependents", "old_dependents").alias("dependents"), F.when(held, F.col("old_status")).otherwise(PENDING).alias("status"))


def is_test(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)tests?(/|_|\.)|_test\.|Test\.")


def next_agent(agents: DataFrame) -> DataFrame:
    return agents.agg((F.coalesce(F.max("agent"), F.lit(0)) + 1).alias("agent"))
