"""Readiness for a change: settings, disaster recovery, meshes and cutovers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from schemaloom.functions import telemetry

# Settings that are risky, the values that make them so, severity and rule.
OFF, ZERO = ("off", "false", "0"), ("0", "0ms", "0s")
SETTING_RULES = (
    ("log_statement", ("all",), "CRITICAL", "hazardous-log-statement-all"),
    ("log_statement", ("mod",), "MEDIUM", "verbose-log-statement-mod"),
    ("full_page_writes", OFF, "CRITICAL", "hazardous-full-page-writes-off"),
    ("statement_timeout", ZERO, "HIGH", "unbounded-statement-timeout"),
    ("lock_timeout", ZERO, "HIGH", "unbounded-lock-timeout"),
    ("autovacuum", OFF, "HIGH", "hazardous-autovacuum-off"),
)


def memory_bytes(text: Column) -> Column:
    """A memory setting in bytes; bare numbers up to a million count as kilobytes."""
    number = F.regexp_extract(text, "^([0-9]+(?:[.][0-9]+)?)", 1).try_cast("double")
    unit = F.regexp_extract(text, "(gb|mb|kb)$", 1)
    factor = F.when(unit == "gb", 1024.0**3).when(unit == "mb", 1024.0**2).when(unit == "kb", 1024.0).when(number > 1_000_000, 1.0).otherwise(1024.0)
    return number * factor


def setting_risks(settings: DataFrame, *keys: str) -> DataFrame:
    """(keys, name, setting, severity, rule_id) of risky settings, from rows (keys, name, setting)."""
    said = F.lower(F.trim("setting"))
    value = F.lit(None).cast("struct<severity:string,rule_id:string>")
    for name, values, severity, rule in SETTING_RULES:
        value = F.when((F.col("name") == name) & said.isin(*values), F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule_id"))).otherwise(value)
    small = (F.col("name") == "maintenance_work_mem") & (memory_bytes(said) > 0) & (memory_bytes(said) < 64 << 20)
    value = F.when(small, F.struct(F.lit("MEDIUM").alias("severity"), F.lit("undersized-maintenance-work-mem").alias("rule_id"))).otherwise(value)
    return settings.withColumn("risk", value).filter("risk IS NOT NULL").select(*keys, "name", "setting", "risk.*")


def disaster_issues(archivers: DataFrame, slots: DataFrame, standbys: DataFrame, now: Column, max_lag: int = 100 << 20) -> DataFrame:
    """(server, kind, level, subject): blockers and warnings from archiving, slots and standbys, in long form."""
    state = telemetry.archiver_state(F.col("archived"), F.col("failed"), F.col("last_archived"), F.col("last_failed"), now)
    a = archivers.select("server", F.lit("archiver").alias("kind"), F.when(state == "FAILING_NOW", "blocker").when(state.isin("NEVER_ARCHIVED", "STALE_ARCHIVE"), "warning").alias("level"), state.alias("subject"))
    danger = telemetry.slot_danger(F.col("wal_status"), F.col("active"), F.col("retained"))
    s = slots.select("server", F.lit("slot").alias("kind"), F.when(danger.isNotNull(), "blocker").when(~F.col("active"), "warning").alias("level"), F.col("slot").alias("subject"))
    lag = standbys.groupBy("server").agg(F.max("lag_bytes").alias("lag"))
    b = lag.select("server", F.lit("standby").alias("kind"), F.when(F.col("lag") > max_lag, "blocker").alias("level"), F.col("lag").cast("string").alias("subject"))
    return a.unionByName(s).unionByName(b).filter("level IS NOT NULL")


def is_ready(servers: DataFrame, issues: DataFrame) -> DataFrame:
    n = issues.groupBy("server").agg(F.count_if(F.col("level") == "blocker").alias("blockers"), F.count_if(F.col("level") == "warning").alias("warnings"))
    rows = servers.select("server").join(n, "server", "left").fillna(0, ["blockers", "warnings"])
    return rows.withColumn("is_ready", F.col("blockers") == 0)


def mesh_preflight(tables: DataFrame) -> DataFrame:
    """Tables (table_name, replident, has_key): whether changes can be replicated."""
    name = F.create_map(*(F.lit(x) for kv in {"f": "full", "d": "default", "i": "index", "n": "nothing"}.items() for x in kv))
    identity = F.coalesce(name[F.col("replident")], F.lit("nothing"))
    safe = identity.isin("full", "index") | ((identity == "default") & F.col("has_key"))
    return tables.select("table_name", identity.alias("identity"), safe.alias("is_safe"))


def sequence_targets(sequences: DataFrame, padding: int = 1000) -> DataFrame:
    """Where sequences must start on the other side: above both the column's maximum and the last value, padded."""
    return sequences.withColumn("target", F.greatest(F.coalesce("current_max", F.lit(0)), F.coalesce("last_value", F.lit(0))) + padding)


def phase_durations(log: DataFrame) -> DataFrame:
    """(run_id, phase, started, seconds): how long each phase of a cutover took, the last one open."""
    w = W.partitionBy("run_id").orderBy("started", "phase")
    return log.withColumn("seconds", F.unix_timestamp(F.lead("started").over(w)) - F.unix_timestamp("started"))


# The phases of a cutover in order; a run ends in the last two, and FAILED may follow each of the others.
CUTOVER = ("DRAIN", "FENCE_BLUE", "CAPTURE_FENCE", "WAIT_REPLICATION", "SYNC_SEQUENCES", "PROMOTE_GREEN", "COMPLETE", "FAILED")


def cutover_steps() -> list[tuple[str, str, str]]:
    """(from, to, kind) of the steps that a cutover may take; the start is the empty phase."""
    way = ("", *CUTOVER[:-1])
    return [(a, b, "legal") for a, b in zip(way, way[1:])] + [(a, "FAILED", "failed") for a in CUTOVER[:-2]] + [("FAILED", "DRAIN", "restarted")]


def judged_steps(log: DataFrame, steps: list[tuple[str, str, str]], order: tuple[str, ...] = CUTOVER) -> DataFrame:
    """The log (run_id, started, phase) with ``before``, the phase it came from, and ``step``: the kind that ``steps`` gives, else repeated (the same phase
    again), rolled back (to an earlier one of ``order``), skipped (ahead by more than one) or illegal (another, or one out of an end). A window by run,
    so a long log is not gathered in one row; ties of ``started`` are ordered by phase."""
    w = W.partitionBy("run_id").orderBy("started", "phase")
    rows = log.withColumn("before", F.coalesce(F.lag("phase").over(w), F.lit("")))
    known = F.create_map(*(F.lit(x) for a, b, kind in steps for x in (f"{a}>{b}", kind)))
    place = F.create_map(*(F.lit(x) for i, p in enumerate(("", *order)) for x in (p, i)))
    here, there = place[F.col("before")], place[F.col("phase")]
    ended = F.col("before").isin(*order[-2:]) if len(order) > 1 else F.lit(False)
    other = F.when(F.col("before") == F.col("phase"), "repeated").when(ended | here.isNull() | there.isNull(), "illegal").when(there < here, "rolled back").otherwise("skipped")
    return rows.withColumn("step", F.coalesce(known[F.concat_ws(">", "before", "phase")], other))


def judged_runs(log: DataFrame, steps: list[tuple[str, str, str]], order: tuple[str, ...] = CUTOVER) -> DataFrame:
    """(run_id, steps, legal, failed, restarted, repeated, rolled_back, skipped, illegal, last_phase, state): each run's steps by kind, and whether it is
    complete, failed or open; ``clean`` if all its steps are legal."""
    kinds = ("legal", "failed", "restarted", "repeated", "rolled back", "skipped", "illegal")
    judged = judged_steps(log, steps, order)
    per = judged.groupBy("run_id").agg(
        F.count("*").alias("steps"), *(F.count_if(F.col("step") == k).alias(k.replace(" ", "_")) for k in kinds), F.max_by("phase", F.struct("started", "phase")).alias("last_phase"),
    )
    state = F.when(F.col("last_phase") == order[-2], "complete").when(F.col("last_phase") == order[-1], "failed").otherwise("open")
    return per.withColumns({"state": state, "clean": F.col("legal") == F.col("steps")})


def restore_checks(servers: DataFrame, indexes: DataFrame, keys: DataFrame) -> DataFrame:
    """(server, in_recovery, broken_indexes, unvalidated_keys, is_verified) of restored servers."""
    i = indexes.groupBy("server").agg(F.count_if(~F.col("is_valid")).alias("broken_indexes"))
    k = keys.groupBy("server").agg(F.count_if(~F.col("is_validated")).alias("unvalidated_keys"))
    rows = servers.join(i, "server", "left").join(k, "server", "left").fillna(0, ["broken_indexes", "unvalidated_keys"])
    return rows.withColumn("is_verified", ~F.col("in_recovery") & (F.col("broken_indexes") == 0) & (F.col("unvalidated_keys") == 0))
