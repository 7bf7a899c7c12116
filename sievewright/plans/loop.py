"""The driver loop: choose an action from counts, run its stage, store the state, until a stop."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.features import GROWTH, TIES, outcomes, score_actions
from .availability import WORK, action_table


class NoProgress(RuntimeError):
    """A step that changed no count: nothing would ever change again."""


@dataclass
class Run:
    """Tables by name, counters that no table tells, and the trace so far."""

    spark: SparkSession
    path: str
    tables: dict[str, DataFrame]
    facts: dict = field(default_factory=dict)
    limits: dict = field(default_factory=lambda: {"max_steps": 25, "max_results": 20, "soft_target": 8, "batch": 3, "max_search_rounds": 3})
    trace: list[dict] = field(default_factory=list)
    step: int = 0
    last: dict | None = None
    where: dict[str, str] = field(default_factory=dict)  # table to the folder it was last written to
    counts: dict[str, int] = field(default_factory=dict)  # rows and digest of each table, as it was last written
    digests: dict[str, str] = field(default_factory=dict)


def few_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A handful of rows of the driver in one partition; as an Arrow table they need no Python worker."""
    shape = T.StructType.fromDDL(ddl)
    columns = zip(*rows, strict=True) if rows else [[]] * len(shape)
    held = [pa.array([list(v.items()) if isinstance(v, dict) else v for v in c], to_arrow_type(f.dataType)) for c, f in zip(columns, shape, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(held, names=shape.names), shape).coalesce(1)


def digest(rows: DataFrame) -> Column:
    """An aggregate over all rows that does not depend on their order, and tells apart tables of equal counts: the sum of the rows' hashes."""
    plain = (F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() or f.dataType.simpleString() == "variant" else F.col(f"`{f.name}`") for f in rows.schema)
    return F.coalesce(F.sum(F.xxhash64(F.lit(0), *plain).cast("decimal(38,0)")), F.lit(0)).cast("string")


def _figures(rows: DataFrame) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), digest(rows).alias("digest")]


def measured(run: Run) -> tuple[dict[str, int], dict[str, str]]:
    """(rows, digest) of each table, taken together."""
    union = None
    for n in sorted(run.tables):
        one = run.tables[n].agg(F.lit(n).alias("name"), *_figures(run.tables[n]))
        union = one if union is None else union.unionByName(one)
    told = union.collect() if union is not None else []
    return {r["name"]: r["n"] for r in told}, {r["name"]: r["digest"] for r in told}


def counted(run: Run) -> dict:
    """One count per table."""
    return measured(run)[0]


def context(run: Run, counts: dict, pending: dict[str, int]) -> dict:
    state = {c: counts.get(c, 0) for c in ("candidate_sources", "acquisition_queue", "acquired_pages", "job_detail_pages", "prepared_jobs", "understanding_records", "match_assessments", "errors")}
    state |= {f"pending_{a}": pending.get(a, 0) for a in WORK}
    defaults = {"stopped": False, "has_plan": False, "has_profile": True, "open_queries": 0, "search_rounds": 0, "last_search": "none"}
    return state | defaults | {k: v for k, v in run.facts.items() if k in defaults} | {k: run.limits[k] for k in ("max_results", "soft_target", "max_search_rounds")}


def decide(run: Run, state: dict, last: dict | None, told: dict | None = None) -> tuple[str, float, str]:
    """(action, total, why): hard stops first, then the best score among productive work and search.

    ``told``: what scheduling knows of the run beside its counts (see :func:`sievewright.plans.handlers.run_features`);
    what it does not say comes from the run's facts, or counts as nothing.
    """
    told, spark = told or {}, run.spark
    yields = {f"yield_{a}": told.get("yields", {}).get(a) for a in WORK}
    # All that differs from step to step is data, so Spark compiles the scoring once.
    seen = state | {
        "deficit": max(0, run.limits["soft_target"] - state["match_assessments"]), "batch": run.limits["batch"], "mean_priority": float(told.get("mean_priority", run.facts.get("mean_priority", 0.0)) or 0.0),
        "frontier_high": told.get("frontier_high", run.facts.get("frontier_high", 0)), "refill_left": told.get("refill_left", run.limits.get("refill", 2)), "last_action": (last or {}).get("action"), "last_status": (last or {}).get("outcome") or (last or {}).get("status"),
    } | yields
    texts, doubles = ("last_search", "last_action", "last_status"), ("mean_priority", *yields)
    schema = "state int, " + ", ".join(f"{k} {'string' if k in texts else 'double' if k in doubles else 'boolean' if isinstance(v, bool) else 'int'}" for k, v in seen.items())
    limits, used = run.limits.get("calls", {}), run.facts.get("calls", {})
    calls = few_rows(spark, [(0, a, used.get(a, 0), n) for a, n in limits.items()], "state int, action string, used int, allowed int") if limits else None
    rows = action_table(few_rows(spark, [(0, *seen.values())], schema), calls).where("available")
    pending = F.coalesce(*(F.when(F.col("action") == a, F.col(p)) for a, (_, p) in WORK.items()), F.lit(0))
    given = {
        "executable": pending, "fill": F.least(pending / F.col("batch"), F.lit(1.0)), "frontier_executable": F.col("pending_explore_followups"), "matches": F.col("match_assessments"),
        "yield_rate": F.coalesce(*(F.when(F.col("action") == a, F.col(f"yield_{a}")) for a in WORK)), "tie_rank": F.array_position(F.array(*map(F.lit, TIES)), F.col("action")),
    }
    scored = score_actions(rows.withColumns(given)).select("action", "executable", "total", "tie_rank")
    free = {r["action"]: r for r in scored.collect()}  # at most one row per action
    if state["match_assessments"] >= run.limits["max_results"] and "stop" in free:
        return "stop", 0.0, "max_results"
    soft, failed = state["match_assessments"] >= run.limits["soft_target"], "error" in ((last or {}).get("status"), (last or {}).get("outcome"))
    if soft and failed and "stop" in free:
        return "stop", 0.0, "no_progress"
    productive = {a for a, r in free.items() if r["executable"] > 0}
    rounds = state["search_rounds"] < run.limits["max_search_rounds"]
    search = {"web_search"} & set(free) if rounds and not soft else set()
    if not productive and rounds and "build_search_plan" in free:
        search.add("build_search_plan")
    candidates = productive | search
    if not candidates:
        if "stop" in free:
            return "stop", 0.0, "no_progress" if failed or not soft else "frontier_exhausted"
        raise ValueError("no available action")
    best = max((free[a] for a in candidates), key=lambda r: (r["total"], -r["tie_rank"]))
    return best["action"], best["total"], "score"


#: What is stored of a step: what was done, and the state it left, from which a run can go on.
STEP = "step int, action string, total double, why string, status string, facts string, limits string, last string, counts map<string,long>, tables map<string,string>, digests map<string,string>, outcome string, signals array<string>"


def _keep(run: Run, names: dict[str, DataFrame], step: int | str) -> None:
    """Write tables of a step below ``path``; once all of them are written the run goes on with these, so lineage stays short.

    Rows and digests are taken while tables are written, so no table is read for them.
    """
    folders = {n: f"{run.path}/tables/step={step}/{n}" for n in names}

    def write(name: str) -> dict:
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        names[name].observe(seen, *_figures(names[name])).write.mode("overwrite").parquet(folders[name])
        return seen.get

    with ThreadPoolExecutor(max_workers=max(1, len(names))) as pool:  # tables of one step do not wait for each other
        told = dict(zip(names, pool.map(write, names), strict=True))
    run.where |= folders
    run.tables |= {n: run.spark.read.schema(df.schema).parquet(folders[n]) for n, df in names.items()}
    # A table that is known to be empty before it is written tells nothing.
    run.counts |= {n: int(t.get("n") or 0) for n, t in told.items()}
    run.digests |= {n: str(t.get("digest") or "0") for n, t in told.items()}


def _record(run: Run, step: int, action: str, total: float, why: str, status: str, outcome: dict | None = None) -> None:
    told = outcome or {}
    row = (step, action, float(total), why, status, json.dumps(run.facts), json.dumps(run.limits), json.dumps(run.last), run.counts, dict(run.where), run.digests, told.get("status"), told.get("signals"))
    few_rows(run.spark, [row], STEP).write.mode("overwrite").parquet(f"{run.path}/steps/at={step}")


def outcome_of(run: Run, action: str, before: dict, after: dict) -> dict:
    """What a step came to: ``status``, ``signals`` and the growth of each table, from its counts before and after."""
    names = ["errors", *dict.fromkeys(c for pairs in GROWTH.values() for c, _ in pairs)]
    schema = "run int, step int, action string, last_search string, open_queries int, " + ", ".join(f"{n} long" for n in names)
    rows = [(0, k, action, run.facts.get("last_search"), int(run.facts.get("open_queries", 0)), *(c.get(n, 0) for n in names)) for k, c in enumerate((before, after))]
    last = outcomes(few_rows(run.spark, rows, schema), "run", "step").where("step = 1").select("status", "signals").collect()[0]
    return {"status": last["status"], "signals": list(last["signals"]), "growth": {n: max(0, after[n] - before.get(n, 0)) for n in after}}


def drive(
    run: Run,
    stages: dict[str, Callable[[Run], dict[str, DataFrame]]],
    pending: Callable[[Run], dict[str, int]],
    pause_after: bool = False,
    on_stop: Callable[[Run], None] | None = None,
    features: Callable[[Run], dict] | None = None,
) -> Run:
    """Run ``stages`` (action to a function that returns changed tables) until a stop or the step limit.

    Tables are written below ``path`` before the first step and whenever a step changes them; every step also leaves a
    row of the state after it (see STEP), from which :func:`resume` and :func:`replay` go on. With ``pause_after`` the
    run returns after one action. A step that changes no row of any table and no fact is an error, as nothing would ever
    change again. A stage that fails, or an action without a stage, is a step with status error, and the loop goes on.
    ``features`` tells scheduling more than what is ``pending``; where it is given, how the last step came out (see
    :func:`outcome_of`) counts too. Each action may run as often as ``limits["calls"]`` says. ``on_stop`` is called when
    a run stops by itself, not when it runs out of steps.
    """
    if fresh := {n: df for n, df in run.tables.items() if n not in run.where}:
        _keep(run, fresh, "start")
    if set(run.counts) != set(run.tables):
        run.counts, run.digests = measured(run)
    if run.last is None:
        _record(run, run.step - 1, "start", 0.0, "", "ok")
    while run.step < run.limits["max_steps"]:
        told = features(run) if features else None
        action, total, why = decide(run, context(run, run.counts, told["executable"] if told else pending(run)), run.last, told)
        run.trace.append({"step": run.step, "action": action, "total": total, "why": why, **{f"n_{k}": v for k, v in run.counts.items()}})
        if action == "stop":
            run.facts["stop_reason"] = why
            _record(run, run.step, action, total, why, "stopped")
            if on_stop is not None:
                on_stop(run)
            return run
        before, digests, known = dict(run.counts), dict(run.digests), json.dumps(run.facts, sort_keys=True)
        try:
            _keep(run, stages[action](run), run.step)
            status = "ok"
        except Exception as e:
            status = "error"
            run.facts.setdefault("errors", []).append(f"{type(e).__name__}: {e}"[:200])
        if status == "ok" and run.digests == digests and not run.facts.pop("progress", False) and json.dumps(run.facts, sort_keys=True) == known:
            raise NoProgress(f"{action} changed nothing")
        calls = run.facts.setdefault("calls", {})
        calls[action] = calls.get(action, 0) + 1
        outcome = outcome_of(run, action, before, run.counts) if features else None
        run.last = {"action": action, "status": status} | ({"outcome": "error" if status == "error" else outcome["status"], "growth": outcome["growth"]} if outcome else {})
        _record(run, run.step, action, total, why, status, outcome)
        run.step += 1
        if pause_after:
            return run
    run.facts["stop_reason"] = "max_steps"
    return run


def steps(spark: SparkSession, path: str) -> DataFrame:
    """The stored steps of a run."""
    return spark.read.schema(STEP).parquet(f"{path}/steps")


def detail(spark: SparkSession, path: str, step: int) -> dict:
    """All that is stored of one step."""
    row = steps(spark, path).where(F.col("step") == step).first()
    if row is None:
        raise KeyError(f"no step {step} below {path}")
    return row.asDict()


def after_step(spark: SparkSession, path: str, step: int, branch: str | None = None) -> Run:
    """A run as ``step`` left it; with ``branch`` it goes on in that folder, and what followed stays as it is."""
    d = detail(spark, path, step)
    tables = {n: spark.read.parquet(w) for n, w in d["tables"].items()}
    return Run(spark, branch or path, tables, json.loads(d["facts"]), json.loads(d["limits"]), [], step + 1, json.loads(d["last"]), dict(d["tables"]), dict(d["counts"]), dict(d["digests"]))


def resume(spark: SparkSession, path: str, stages: dict, pending: Callable[[Run], dict[str, int]], **more) -> Run:
    """Go on with a run after its last stored step; one that was cut off is done again, a stopped run stays stopped."""
    try:
        last = steps(spark, path).select("step", "action").orderBy(F.desc("step")).first()
    except AnalysisException:
        last = None
    if last is None:
        raise KeyError(f"no step below {path}")
    run = after_step(spark, path, last["step"])
    return run if last["action"] == "stop" else drive(run, stages, pending, **more)


def replay(spark: SparkSession, path: str, step: int, branch: str, stages: dict, pending: Callable[[Run], dict[str, int]], **more) -> Run:
    """Do exactly the action that follows a stored step, into a folder of its own."""
    return drive(after_step(spark, path, step, branch), stages, pending, pause_after=True, **more)


def history(spark: SparkSession, source: str | list[dict]) -> DataFrame:
    """A run's steps, newest first: from its folder (counts only, no table is opened) or from its trace."""
    if isinstance(source, str):
        return steps(spark, source).select("step", "action", "status", "total", "why", "counts").orderBy(F.desc("step"))
    return spark.createDataFrame([{k: v for k, v in t.items()} for t in source]).orderBy(F.desc("step"))


def trace_entry(trace: DataFrame, summaries: DataFrame, by: str = "search_round", order: str = "step", state: str | None = None) -> DataFrame:
    """For each of ``summaries`` its entry of ``trace``: the last one of the same ``state``, else the last with the same ``by``; null where there is none.

    ``state`` names a column of both that tells states by their content (the digests of their tables), so a state finds
    its own entry among several of a search round.
    """
    rest = F.struct(*(c for c in trace.columns if c != by))
    last = lambda key, tag: trace.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(rest, order).alias(tag))
    if state is None:
        return summaries.join(last(by, "entry"), by, "left")
    found = summaries.join(last(by, "_round"), by, "left").join(last(state, "_own"), state, "left")
    return found.withColumn("entry", F.coalesce("_own", "_round")).drop("_own", "_round")


def state_key(digests: Column) -> Column:
    """One text for the digests of a state's tables (a map by name), whatever their order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(digests))))
