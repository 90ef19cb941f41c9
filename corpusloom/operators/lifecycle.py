"""Lifecycles of runs and steps: which states reach which, how a step walks to its target, and what must be promoted before a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .counts import transitions


def reachable(legal: DataFrame) -> DataFrame:
    """(from_status, to_status, steps): every pair that a legal walk of one transition or more joins, with the length of the shortest one.

    A recursive query; a shortest walk is no longer than there are states, which bounds the recursion.
    """
    spark = legal.sparkSession
    most = legal.select("from_status").union(legal.select("to_status")).distinct().count()
    return spark.sql(
        """WITH RECURSIVE edges AS (SELECT from_status, to_status FROM {legal}),
        walks(from_status, to_status, steps) AS (SELECT from_status, to_status, 1 FROM edges UNION ALL
        SELECT w.from_status, e.to_status, w.steps + 1 FROM walks w JOIN edges e ON w.to_status = e.from_status WHERE w.steps < {most})
        SELECT from_status, to_status, min(steps) AS steps FROM walks GROUP BY from_status, to_status""",
        legal=legal, most=most,
    )


def _names(states: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, states))


def advanced(steps: DataFrame, path: tuple[str, ...] = fixed.PROMOTION_PATH) -> DataFrame:
    """Steps (any columns, with ``status`` and ``target``) walked along the path: adds ``walk`` (the states entered in their order), ``new_status`` and ``code``.

    A step already at its target stays. A target that isn't on the path, and a first transition that the table forbids, leave the step as it is and give a code. A step that
    stands beyond its target on the path has nothing left to walk.
    """
    names = _names(path)
    here, there = F.array_position(names, F.col("status")), F.array_position(names, F.col("target"))
    walk = F.when((F.col("status") == F.col("target")) | (here >= there), F.slice(names, F.lit(1), F.lit(0))).otherwise(F.slice(names, here.cast("int") + 1, (there - here).cast("int")))
    legal = F.create_map(*[x for a, b in fixed.STEP_TRANSITIONS.items() for x in (F.lit(a), _names(b) if b else F.array().cast("array<string>"))])
    walked = steps.withColumn("walk", F.when(there > 0, walk))
    # Transitions along the path are legal; the first one may not be.
    illegal = (F.size("walk") > 0) & ~F.coalesce(F.array_contains(legal[F.col("status")], F.col("walk")[0]), F.lit(False))
    same = F.col("status") == F.col("target")
    code = F.when(same, None).when(there == 0, "SCHEMA_INVALID_VALUE").when(illegal, "STATE_INVALID_TRANSITION")
    walked = walked.withColumn("code", code)
    walked = walked.withColumn("walk", F.when(F.col("code").isNotNull() | same, F.array().cast("array<string>")).otherwise(F.col("walk")))
    return walked.withColumn("new_status", F.coalesce(F.try_element_at("walk", F.lit(-1)), F.col("status")))


def illegal_steps(path: tuple[str, ...] = fixed.PROMOTION_PATH) -> list[tuple[str, str]]:
    """Neighbours of the path that the table forbids; none for a sound path."""
    return [(a, b) for a, b in zip(path, path[1:], strict=False) if b not in fixed.STEP_TRANSITIONS[a]]


def promotion_guard(steps: DataFrame, last: Column) -> DataFrame:
    """By run whether every step up to ``last`` is promoted: ``unfinished`` (in order), ``promoted_through`` (the last step of the promoted prefix, null for none), ``allowed``, ``message``."""
    open_step = F.when((F.col("step") <= last) & (F.col("status") != "promoted"), F.col("step"))
    out = steps.groupBy("run_id").agg(
        F.array_sort(F.collect_set(open_step)).alias("unfinished"), F.min(F.when(F.col("status") != "promoted", F.col("step"))).alias("first_open"),
        F.array_sort(F.collect_set(F.when(F.col("status") == "promoted", F.col("step")))).alias("done"),
    )  # a run has a handful of steps
    prefix = F.array_max(F.filter("done", lambda s: F.col("first_open").isNull() | (s < F.col("first_open"))))
    names = F.array_join(F.transform("unfinished", lambda s: s.cast("string")), ", ")
    subject = F.when(F.size("unfinished") == 1, F.concat(F.lit("step "), names, F.lit(" is"))).otherwise(F.concat(F.lit("steps "), names, F.lit(" are")))
    return out.select("run_id", "unfinished", prefix.alias("promoted_through"), (F.size("unfinished") == 0).alias("allowed"), F.when(F.size("unfinished") > 0, F.concat(subject, F.lit(" not promoted"))).alias("message"))


def legal_steps(spark) -> DataFrame:
    return transitions(spark, fixed.STEP_TRANSITIONS)


def step_targets(legal: DataFrame, steps: DataFrame) -> DataFrame:
    """(step, from_status, to_status): the legal transitions of each step; one that needs a second reader (``semantic``) isn't promoted straight from the deterministic check."""
    jump = (F.col("from_status") == "verified_deterministic") & (F.col("to_status") == "promoted")
    return legal.join(F.broadcast(steps), F.col("step").isNotNull()).where(~(jump & F.col("semantic"))).select("step", "from_status", "to_status")  # a handful of steps
