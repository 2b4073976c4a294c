"""Reports over findings and over event logs, as nested rows that any writer can store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sarif(found: DataFrame) -> DataFrame:
    """(file, results): one JSON array of SARIF results per file, suppressed ones included."""
    level = F.when(F.col("severity") == "BLOCKER", "error").when(F.col("severity") == "ADVISORY", "note").otherwise("warning")
    result = F.struct("line", "col", "stmt", F.col("rule_id").alias("ruleId"), level.alias("level"), F.col("message").alias("message"))
    return found.groupBy("file").agg(F.to_json(F.sort_array(F.collect_list(result))).alias("results"))


def annotation(text: Column) -> Column:
    """A message as CI annotations take it: per cent signs and line ends escaped."""
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def annotations(found: DataFrame) -> DataFrame:
    """(file, line, text): one CI command for each finding."""
    level = F.when(F.col("severity") == "BLOCKER", "error").when(F.col("severity") == "ADVISORY", "notice").otherwise("warning")
    place = F.concat(F.lit(" file="), F.col("file").cast("string"), F.lit(",line="), F.col("line").cast("string"), F.lit(",col="), F.col("col").cast("string"), F.lit(",title="), "rule_id")
    return found.select("file", "line", F.concat(F.lit("::"), level, place, F.lit("::"), annotation(F.col("message"))).alias("text"))


def markdown(found: DataFrame) -> DataFrame:
    """(file, text): a table of each script's findings, in order, for a report or a step summary."""
    cell = lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    row = F.concat(F.lit("| "), F.col("line").cast("string"), F.lit(" | "), "severity", F.lit(" | "), "rule_id", F.lit(" | "), "lock_level", F.lit(" | "), cell(F.col("message")), F.lit(" |"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("line", "col", "rule_id", row.alias("row")))), lambda x: x["row"])
    head = F.concat(F.lit("### "), F.col("file").cast("string"), F.lit("\n\n| line | severity | rule | lock | what happens |\n|-|-|-|-|-|\n"))
    return found.groupBy("file").agg(rows.alias("rows")).select("file", F.concat(head, F.array_join("rows", "\n"), F.lit("\n")).alias("text"))


def downtime_risk(lock_level: Column) -> Column:
    return F.when(lock_level == "ACCESS EXCLUSIVE", "all reads and writes wait").when(lock_level.isin("SHARE", "SHARE ROW EXCLUSIVE", "EXCLUSIVE"), "writes wait").otherwise("none")


def fix_spans(edits: DataFrame) -> DataFrame:
    """Edits (file, low, high, text) that can be applied together: one that overlaps an edit kept before it is dropped. The
    edits of one script are walked in order, so a dropped one hides no other."""
    kind = "array<struct<low:int,high:int,text:string>>"
    rows = F.array_sort(F.collect_list(F.struct(F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high"), "text")))
    kept = F.aggregate(
        rows, F.struct(F.lit(-1).alias("end"), F.array().cast(kind).alias("kept")),
        lambda a, e: F.when(e["low"] >= a["end"], F.struct(e["high"].alias("end"), F.array_append(a["kept"], e).alias("kept"))).otherwise(a), lambda a: a["kept"],
    )
    return edits.groupBy("file").agg(kept.alias("kept")).select("file", F.inline("kept"))


def apply_fixes(scripts: DataFrame, edits: DataFrame) -> DataFrame:
    """(file, patched): each script with its edits spliced in, from the last to the first."""
    spans = F.sort_array(F.collect_list(F.struct("low", "high", F.col("text").alias("new"))), asc=False)
    grouped = fix_spans(edits).groupBy("file").agg(spans.alias("spans"))
    spliced = F.aggregate(
        F.coalesce("spans", F.array().cast("array<struct<low:int,high:int,new:string>>")), F.col("text"),
        lambda t, e: F.concat(t.substr(F.lit(1), e["low"]), e["new"], t.substr(e["high"] + 1, F.length(t))),
    )
    return scripts.join(grouped, "file", "left").select("file", spliced.alias("patched"))


def attempts(events: DataFrame) -> DataFrame:
    """(run_id, statement, tries, retried, failed) from an executor's event log (run_id, statement, kind)."""
    n = lambda k: F.count_if(F.col("kind") == k)
    return events.groupBy("run_id", "statement").agg(n("start").alias("tries"), n("retry").alias("retried"), n("error").alias("failed"))


def json_report(found: DataFrame) -> DataFrame:
    """(file, report): per file one JSON object of counts and its findings in order of line."""
    n = lambda s: F.count_if(F.col("severity") == s)
    one = F.struct("line", "col", "stmt", "rule_id", "severity", "lock_level", "snippet", "message")
    return found.groupBy("file").agg(n("BLOCKER").alias("blockers"), n("WARNING").alias("warnings"), F.sort_array(F.collect_list(one)).alias("findings")).select(
        "file", F.to_json(F.struct("file", "blockers", "warnings", "findings")).alias("report")
    )
