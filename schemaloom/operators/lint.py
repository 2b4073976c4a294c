"""Lock and rewrite hazards in migration scripts: 28 rules over statements.

Rules are Column predicates that run together in one pass; those on the state of a script say facts there, which meet by script, rule and what they are
about in one grouping. A finding has file, stmt, line, col, rule_id, severity, lock_level, snippet and message.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

AX = "ACCESS EXCLUSIVE"
_REL = r'(?:ONLY )?((?:"[^"]*"|\S+)(?: \. (?:"[^"]*"|\S+))?)'  # quoted names may hold blanks


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str | Column
    lock_level: str
    found: Callable[[], Column]  # array of snippets


def _whole(cond: Column) -> Column:
    return F.when(cond, F.array(F.col("norm"))).otherwise(F.array().cast("array<string>"))


def _clauses(keep: str, drop: str = "(?!)") -> Column:
    return F.filter("clauses", lambda c: c.rlike(keep) & ~c.rlike(drop))


_ADD = r"^ADD (?!CONSTRAINT|PRIMARY|UNIQUE|CHECK|FOREIGN|EXCLUDE)(?:COLUMN )?"
# Default expressions that are evaluated row by row.
VOLATILE = r"\b(NOW|CLOCK_TIMESTAMP|STATEMENT_TIMESTAMP|TRANSACTION_TIMESTAMP|TIMEOFDAY|RANDOM|GEN_RANDOM_UUID|UUID_GENERATE_V[14]|NEXTVAL|TXID_CURRENT) \("


def stateless() -> list[Rule]:
    return [
        Rule("require-concurrent-index", "BLOCKER", "SHARE", lambda: _whole(F.col("norm").rlike(r"^CREATE (UNIQUE )?INDEX (?!CONCURRENTLY\b).*\bON\b"))),
        Rule("add-column-not-null-without-default", "BLOCKER", AX, lambda: _clauses(_ADD + r".*\bNOT NULL\b", r"\b(DEFAULT|GENERATED)\b")),
        Rule("foreign-key-missing-not-valid", "BLOCKER", "SHARE ROW EXCLUSIVE", lambda: _clauses(r"^ADD .*\bFOREIGN KEY\b", r"\bNOT VALID\b")),
        Rule("set-not-null-full-scan", F.when(F.col("pg_version") < 12, "BLOCKER").otherwise("WARNING"), AX, lambda: _clauses(r"^ALTER (COLUMN )?\S+ SET NOT NULL")),
        Rule(
            "unbatched-dml", F.when(F.col("norm").rlike(r"\bWHERE\b"), "WARNING").otherwise("BLOCKER"), "ROW EXCLUSIVE",
            lambda: _whole(F.col("norm").rlike(r"^(UPDATE|DELETE FROM)\b") & ~F.col("norm").rlike(r"\bLIMIT\b") & ~F.exists("comments", lambda c: c.rlike("(?i)batch") & ~c.contains("schemaloom-disable"))),
        ),
        Rule("check-constraint-missing-not-valid", "BLOCKER", AX, lambda: _clauses(r"^ADD (CONSTRAINT \S+ )?CHECK\b", r"\bNOT VALID\b")),
        Rule("unique-constraint-using-index", "BLOCKER", "SHARE", lambda: _clauses(r"^ADD (CONSTRAINT \S+ )?UNIQUE\b", r"\bUNIQUE USING INDEX\b")),
        Rule("session-advisory-lock", "WARNING", "NONE", lambda: F.regexp_extract_all(F.col("norm"), F.lit(r"\b(PG_(?:TRY_)?ADVISORY_LOCK(?:_SHARED)?)\b"), F.lit(1))),
        Rule("unindexed-foreign-key", "WARNING", "NONE", lambda: _clauses(r"^ADD .*\bFOREIGN KEY\b")),
        Rule("drop-column-lock", "WARNING", AX, lambda: _clauses(r"^DROP COLUMN\b")),
        Rule("add-primary-key-missing-using-index", "BLOCKER", AX, lambda: _clauses(r"^ADD (CONSTRAINT \S+ )?PRIMARY KEY\b", r"\bUSING INDEX\b")),
        Rule("detach-partition-non-concurrent", "BLOCKER", AX, lambda: F.when(F.col("pg_version") >= 14, _clauses(r"^DETACH PARTITION\b", r"\b(CONCURRENTLY|FINALIZE)\b")).otherwise(F.array().cast("array<string>"))),
        Rule("reindex-missing-concurrently", "BLOCKER", AX, lambda: _whole(F.col("norm").rlike(r"^REINDEX\b") & ~F.col("norm").rlike(r"\bCONCURRENTLY\b"))),
        Rule("maintenance-command-detected", "BLOCKER", AX, lambda: _whole(F.col("norm").rlike(r"^(VACUUM|CLUSTER|TRUNCATE)\b"))),
        Rule("identity-sequence-start-with", "BLOCKER", AX, lambda: _clauses(r"^ALTER (COLUMN )?\S+ (ADD GENERATED|SET GENERATED|RESTART)\b.*\b(START|RESTART)( WITH)? (- [0-9]+|0|1)(?![0-9])|^ALTER (COLUMN )?\S+ RESTART( WITH)? (- [0-9]+|0|1)(?![0-9])")),
        Rule("volatile-default", "BLOCKER", AX, lambda: _clauses(_ADD + r".*\bDEFAULT\b.*(" + VOLATILE + ")")),
        Rule("non-concurrent-drop-index", "BLOCKER", AX, lambda: _whole(F.col("norm").rlike(r"^DROP INDEX (?!CONCURRENTLY\b)"))),
    ]


def prepared(stmts: DataFrame) -> DataFrame:
    """Adds the ALTER TABLE target and clauses. Optional columns pg_version and is_orm default to 16 and false."""
    for name, value in (("pg_version", F.lit(16)), ("is_orm", F.lit(False))):
        if name not in stmts.columns:
            stmts = stmts.withColumn(name, value)
    alter = rf"^ALTER TABLE (?:IF EXISTS )?{_REL} "
    return stmts.withColumn("target", F.when(F.col("norm").rlike(alter), F.regexp_extract(F.col("norm"), alter, 1))).withColumn(
        "clauses", F.when(F.col("target").isNotNull(), F.transform("items", lambda x: x["norm"])).otherwise(F.array().cast("array<string>"))
    )


_FACT = "rule_id: string, about: string, is_subject: boolean, severity: string, lock_level: string, snippet: string, said: string"


def _fact(rule_id: str, about: Column, subject: bool, severity="", lock: str = "", snippet: Column | None = None, said: Column | None = None) -> Column:
    """What a statement adds to a rule on the state of a script: it is a subject that the rule judges or what it judges it by; both meet by
    ``about``."""
    parts = (F.lit(rule_id), about, F.lit(subject), severity if isinstance(severity, Column) else F.lit(severity), F.lit(lock), F.col("norm") if snippet is None else snippet, F.lit("") if said is None else said)
    return F.struct(*(p.alias(n.split(":")[0]) for p, n in zip(parts, _FACT.split(", "))))


def _if(when: Column, *facts: Column) -> Column:
    return F.when(when, F.array(*facts)).otherwise(F.array().cast(f"array<struct<{_FACT}>>"))


def one_statement() -> list[tuple[str, Column]]:
    """(rule, facts) of the rules on one statement."""

    def told(r: Rule) -> Column:
        return F.transform(r.found(), lambda s: _fact(r.rule_id, F.lit(""), True, r.severity, r.lock_level, s))

    return [(r.rule_id, told(r)) for r in stateless()]


def transactions() -> list[tuple[str, Column]]:
    """Statements that must not run in a transaction, inside one or in a file whose tool opens one; ALTER TYPE ADD VALUE outside of one whose
    value a later statement of the script names."""
    norm, inside = F.col("norm"), F.col("in_tx") | F.col("is_orm")
    concurrent = norm.rlike(r"^(CREATE (UNIQUE )?INDEX|DROP INDEX) CONCURRENTLY\b")
    other = norm.rlike(r"^(REINDEX\b.*\bCONCURRENTLY|VACUUM\b)|^ALTER TYPE .* ADD VALUE\b")
    add_value = norm.rlike(r"^ALTER TYPE .* ADD VALUE\b")
    value = F.regexp_extract("raw", r"(?i)ADD VALUE (?:IF NOT EXISTS )?('(?:[^']|'')*')", 1)
    enum, one = "enum-add-value-in-transaction", F.lit("")
    return [
        ("concurrent-index-in-transaction", _if(concurrent & inside, _fact("concurrent-index-in-transaction", one, True, "BLOCKER", "NONE"))),
        ("non-transactional-in-transaction", _if(other & inside, _fact("non-transactional-in-transaction", one, True, "BLOCKER", "NONE"))),
        (enum, _if(add_value & inside, _fact(enum, one, True, "BLOCKER", AX))),
        (enum, _if(add_value & ~inside & (value != ""), _fact(enum, F.lit("value"), True, "BLOCKER", AX, said=value))),
        (enum, _if(F.col("raw").contains("'"), _fact(enum, F.lit("value"), False, snippet=F.lit(""), said=F.col("raw")))),  # a value has quotes
    ]


def drop_add_pairs() -> list[tuple[str, Column]]:
    """A column dropped and another added on one table of one script: a rename that loses data."""
    rule = "prisma-silent-rename-data-loss"
    drops = F.transform(_clauses(r"^DROP (COLUMN )?(?!CONSTRAINT)"), lambda c: _fact(rule, F.col("target"), True, "BLOCKER", AX, c))
    return [(rule, drops), (rule, F.transform(_clauses(_ADD), lambda c: _fact(rule, F.col("target"), False, snippet=F.lit(""), said=c)))]


def lock_accumulation() -> list[tuple[str, Column]]:
    """ALTER TABLE and later row changes in one closed transaction block, or both outside of any: pairs. The end of a block says that it is closed."""
    rule, scope = "lock-accumulation-mixed-ddl-dml", F.col("scope")
    block = F.when(F.col("in_tx"), scope.cast("string")).otherwise("free")
    within = ~F.col("begins") & ~F.col("ends")
    return [
        (rule, _if(within & F.col("norm").rlike(r"^(UPDATE|DELETE|INSERT|MERGE)\b"), _fact(rule, block, True, "BLOCKER", AX))),
        (rule, _if(within & F.col("norm").rlike(r"^ALTER TABLE\b"), _fact(rule, block, False, snippet=F.lit(""), said=F.lit("alters")))),
        (rule, _if(F.col("ends"), _fact(rule, (scope - 1).cast("string"), False, snippet=F.lit(""), said=F.lit("closed")))),
    ]


def attach_without_check() -> list[tuple[str, Column]]:
    """ATTACH PARTITION of a table that no earlier statement validated a constraint on: two findings each."""
    part = r"^ATTACH PARTITION (\S+(?: \. \S+)?)"
    out = []
    for rule in ("attach-partition-missing-check", "partition-scan-lock"):
        out.append((rule, F.transform(_clauses(part), lambda c: _fact(rule, F.regexp_extract(c, part, 1), True, "BLOCKER", AX))))  # noqa: B023
        out.append((rule, _if(F.exists("clauses", lambda c: c.rlike("^VALIDATE CONSTRAINT")), _fact(rule, F.col("target"), False, snippet=F.lit("")))))
    return out


def key_over_nullable() -> list[tuple[str, Column]]:
    """PRIMARY KEY USING INDEX on a table without an earlier SET NOT NULL."""
    rule = "primary-key-using-index-nullable-column"
    return [
        (rule, _if(F.exists("clauses", lambda c: c.rlike(r"^ADD .*PRIMARY KEY USING INDEX")), _fact(rule, F.col("target"), True, "WARNING", AX))),
        (rule, _if(F.exists("clauses", lambda c: c.rlike(r"SET NOT NULL")), _fact(rule, F.col("target"), False, snippet=F.lit("")))),
    ]


def enum_recreated() -> list[tuple[str, Column]]:
    """A column cast by text in a script that drops and creates an enum of one name."""
    rule, norm = "enum-recreate-table-rewrite", F.col("norm")
    name = lambda verb: F.regexp_extract(norm, rf"^{verb} TYPE (?:IF EXISTS )?(\S+(?: \. \S+)?)", 1)
    return [
        (rule, _if(F.exists("clauses", lambda c: c.rlike(r"^ALTER (COLUMN )?\S+ (SET DATA )?TYPE .* USING .*:: TEXT\b")), _fact(rule, F.lit(""), True, "BLOCKER", AX))),
        (rule, _if(norm.rlike("^CREATE TYPE .* AS ENUM"), _fact(rule, F.lit(""), False, snippet=F.lit("made"), said=name("CREATE")))),
        (rule, _if(norm.rlike("^DROP TYPE"), _fact(rule, F.lit(""), False, snippet=F.lit("gone"), said=name("DROP")))),
    ]


def type_rewrites() -> list[tuple[str, Column]]:
    """ALTER COLUMN TYPE: a warning if the script tells the old type and the change is only of metadata."""
    rule = "alter-column-type-rewrite"
    change = r"^ALTER (?:COLUMN )?(\S+) (?:SET DATA )?TYPE (.+?)(?: USING .*)?$"
    create = r"^CREATE TABLE (?:IF NOT EXISTS )?(\S+(?: \. \S+)?) \("
    column = r"^(\S+) (.+?)(?: (?:NOT NULL|NULL|DEFAULT|PRIMARY|UNIQUE|REFERENCES|CHECK|COLLATE|GENERATED)\b.*)?$"
    about = lambda table, name: F.concat_ws("\0", table, name)
    known = lambda table, c: _fact(rule, about(table, F.regexp_extract(c, column, 1)), False, snippet=F.lit(""), said=F.regexp_extract(c, column, 2))
    none = F.array().cast("array<string>")
    inner = F.when(F.col("norm").rlike(create), F.transform("items", lambda x: x["norm"])).otherwise(none)
    return [
        (rule, F.transform(_clauses(change), lambda c: _fact(rule, about(F.col("target"), F.regexp_extract(c, change, 1)), True, "BLOCKER", AX, c, F.regexp_extract(c, change, 2)))),
        (rule, F.transform(inner, lambda c: known(F.regexp_extract("norm", create, 1), c))),
        (rule, F.transform(_clauses(_ADD), lambda c: known(F.col("target"), F.regexp_replace(c, _ADD, "")))),
    ]


def _kept_type(old: Column, new: Column) -> Column:
    """Whether a column of type ``old`` takes ``new`` without a rewrite."""
    size = lambda t: F.regexp_extract(t, r"\( ([0-9]+)", 1).try_cast("int")
    text = r"^(VARCHAR|CHARACTER VARYING)\b"
    safe = (old.rlike(text) & (new == "TEXT")) | (old.rlike(text) & new.rlike(text) & (size(new).isNull() | (size(new) >= size(old)))) | (old == new)
    return F.coalesce(safe, F.lit(False))


def _judged(facts: DataFrame) -> DataFrame:
    """The findings among the facts of each script, rule and what they are about: subjects are held against the facts of the others."""
    fields = ("stmt", "line", "col", "severity", "lock_level", "snippet", "said")
    groups = facts.groupBy("file", "rule_id", "about").agg(
        F.collect_list(F.when(F.col("is_subject"), F.struct(*fields))).alias("subjects"), F.collect_list(F.when(~F.col("is_subject"), F.struct("stmt", "snippet", "said"))).alias("by")
    ).filter(F.size("subjects") > 0)
    by, rule, none = F.col("by"), F.col("rule_id"), F.array().cast("array<string>")
    # the findings of a subject, as their snippets
    once = lambda s, when: F.when(when, F.array(s["snippet"])).otherwise(none)
    earlier = lambda s: F.filter(by, lambda e: (e["stmt"] < s["stmt"]) & (e["said"] == "alters"))
    closed = (F.col("about") == "free") | F.exists(by, lambda e: e["said"] == "closed")
    names = lambda what: F.transform(F.filter(by, lambda e: e["snippet"] == what), lambda e: e["said"])
    recreated = F.arrays_overlap(names("made"), names("gone"))

    def snippets(s: Column) -> Column:
        return (
            F.when(rule == "prisma-silent-rename-data-loss", F.transform(by, lambda e: F.concat_ws(" / ", s["snippet"], e["said"])))
            .when(rule == "lock-accumulation-mixed-ddl-dml", F.when(closed, F.transform(earlier(s), lambda e: s["snippet"])).otherwise(none))
            .when((rule == "enum-add-value-in-transaction") & (F.col("about") == "value"), once(s, F.exists(by, lambda e: (e["stmt"] > s["stmt"]) & F.contains(e["said"], s["said"]))))
            .when(rule.isin("attach-partition-missing-check", "partition-scan-lock", "primary-key-using-index-nullable-column"), once(s, ~F.exists(by, lambda e: e["stmt"] <= s["stmt"])))
            .when(rule == "enum-recreate-table-rewrite", once(s, recreated))
            .otherwise(F.array(s["snippet"]))
        )

    old = F.array_max(by)["said"]  # of the last statement that tells it
    rows = groups.select("file", "rule_id", F.when(rule == "alter-column-type-rewrite", old).alias("old"), F.explode(F.transform("subjects", lambda s: F.struct(s.alias("s"), snippets(s).alias("found")))).alias("x"))
    rows = rows.select("file", "rule_id", "old", "x.s", F.explode("x.found").alias("snippet"))
    severity = F.when(F.col("old").isNotNull() & _kept_type(F.col("old"), F.col("s.said")), "WARNING").otherwise(F.col("s.severity"))
    return rows.select("file", "s.stmt", "s.line", "s.col", "rule_id", severity.alias("severity"), "s.lock_level", "snippet")


#: What happens, by rule.
MESSAGES = {
    "require-concurrent-index": "the index is built under a lock that stops all writes", "concurrent-index-in-transaction": "a concurrent build fails inside a transaction",
    "add-column-not-null-without-default": "rows that are there already have no value for the new column", "foreign-key-missing-not-valid": "both tables are locked while all rows are checked",
    "prisma-silent-rename-data-loss": "one column goes and another comes: a rename would lose its data", "set-not-null-full-scan": "the whole table is read under an exclusive lock",
    "unbatched-dml": "all rows change in one transaction", "check-constraint-missing-not-valid": "all rows are checked under an exclusive lock", "check-constraint-not-valid": "all rows are checked under an exclusive lock",
    "unique-constraint-using-index": "the constraint builds its index while writes wait", "session-advisory-lock": "a session lock outlives its transaction, and poolers leak it",
    "alter-column-type-rewrite": "the new type can rewrite the table and its indexes", "unindexed-foreign-key": "without an index each delete of a referenced row reads the table",
    "drop-column-lock": "the drop waits for, and then stops, all readers", "add-primary-key-missing-using-index": "the key builds its index while reads and writes wait",
    "detach-partition-non-concurrent": "the parent is locked for all while the partition goes", "reindex-missing-concurrently": "reads and writes wait until the index is rebuilt",
    "enum-add-value-in-transaction": "the new value can't be used before its transaction commits", "maintenance-command-detected": "the command locks the table for as long as it runs",
    "identity-sequence-start-with": "the sequence hands out values that rows have already", "attach-partition-missing-check": "without a validated check the new partition is read under a lock",
    "partition-scan-lock": "the scan of the new partition holds up the parent", "enum-recreate-table-rewrite": "a cast to the new type rewrites the table", "non-transactional-in-transaction": "the command fails inside a transaction",
    "lock-accumulation-mixed-ddl-dml": "locks of the schema change are held while rows change", "volatile-default": "the default is computed row by row, which rewrites the table",
    "non-concurrent-drop-index": "the drop stops reads and writes of the table", "primary-key-using-index-nullable-column": "the key has to check its column for nulls first",
}


#: What to do instead, by rule.
REMEDIES = {
    "require-concurrent-index": "build it with CREATE INDEX CONCURRENTLY, outside a transaction", "concurrent-index-in-transaction": "move it out of the transaction",
    "add-column-not-null-without-default": "give a constant DEFAULT, or add the column nullable, fill it, then SET NOT NULL", "foreign-key-missing-not-valid": "add it NOT VALID, then VALIDATE CONSTRAINT",
    "prisma-silent-rename-data-loss": "use RENAME COLUMN, or expand and contract", "set-not-null-full-scan": "add CHECK (c IS NOT NULL) NOT VALID, validate it, then SET NOT NULL",
    "unbatched-dml": "change rows in batches by key", "check-constraint-missing-not-valid": "add it NOT VALID, then VALIDATE CONSTRAINT", "check-constraint-not-valid": "add it NOT VALID, then VALIDATE CONSTRAINT",
    "unique-constraint-using-index": "build a unique index CONCURRENTLY, then ADD CONSTRAINT USING INDEX", "session-advisory-lock": "use pg_advisory_xact_lock", "alter-column-type-rewrite": "add a new column, copy, then swap",
    "unindexed-foreign-key": "index the referencing columns first", "drop-column-lock": "set a lock_timeout and retry", "add-primary-key-missing-using-index": "build a unique index CONCURRENTLY, then ADD PRIMARY KEY USING INDEX",
    "detach-partition-non-concurrent": "use DETACH PARTITION CONCURRENTLY", "reindex-missing-concurrently": "use REINDEX CONCURRENTLY", "enum-add-value-in-transaction": "commit the new value on its own first",
    "maintenance-command-detected": "run it in a maintenance window", "identity-sequence-start-with": "start above the highest value in use", "attach-partition-missing-check": "add and validate a CHECK for the bounds first",
    "partition-scan-lock": "add and validate a CHECK for the bounds first", "enum-recreate-table-rewrite": "add values to the type in place", "non-transactional-in-transaction": "run it on its own",
    "lock-accumulation-mixed-ddl-dml": "split schema changes and row changes", "volatile-default": "add the column without it, then set the default and fill in batches", "non-concurrent-drop-index": "use DROP INDEX CONCURRENTLY",
    "primary-key-using-index-nullable-column": "SET NOT NULL first, by a validated CHECK",
}


def remedied(found: DataFrame) -> DataFrame:
    """Findings with a remedy; one that is there already stays."""
    remedy = F.create_map(*(F.lit(x) for kv in REMEDIES.items() for x in kv))[F.col("rule_id")]
    return found.withColumn("remedy", F.coalesce(F.col("remedy"), remedy) if "remedy" in found.columns else remedy)


#: What the statements hold that a rule on one statement can speak of, for ``statements.statements``.
_CONCERNS = {
    "require-concurrent-index": "^CREATE (UNIQUE )?INDEX ", "non-concurrent-drop-index": "^DROP INDEX ", "reindex-missing-concurrently": "^REINDEX", "unbatched-dml": "^(UPDATE|DELETE FROM)",
    "maintenance-command-detected": "^(VACUUM|CLUSTER|TRUNCATE)", "session-advisory-lock": "PG_(TRY_)?ADVISORY_LOCK", "check-constraint-missing-not-valid": "^ALTER TABLE .*CHECK",
    "foreign-key-missing-not-valid": "^ALTER TABLE .*FOREIGN KEY", "unindexed-foreign-key": "^ALTER TABLE .*FOREIGN KEY", "drop-column-lock": "^ALTER TABLE .*DROP COLUMN",
    "detach-partition-non-concurrent": "^ALTER TABLE .*DETACH PARTITION", "unique-constraint-using-index": "^ALTER TABLE .*UNIQUE", "add-primary-key-missing-using-index": "^ALTER TABLE .*PRIMARY KEY",
}
_TWIN, _FIRST = "check-constraint-not-valid", "check-constraint-missing-not-valid"


def _asked(rules: set[str]) -> set[str]:
    return (rules - {_TWIN}) | ({_FIRST} if _TWIN in rules else set())


def concerns(rules: set[str]) -> str | None:
    """What a statement must match for any of these rules to speak; none if a rule asks for the state of the script."""
    asked = _asked(rules)
    return "|".join(sorted({_CONCERNS[r] for r in asked})) if asked and asked <= _CONCERNS.keys() else None


def _alone(rules: set[str] | None) -> bool:
    """Whether these rules look at one statement each."""
    return rules is not None and _asked(rules) <= {r.rule_id for r in stateless()}


def _renamed(out: DataFrame, rules: set[str]) -> DataFrame:
    if _TWIN in rules and _FIRST not in rules:
        out = out.withColumn("rule_id", F.when(F.col("rule_id") == _FIRST, _TWIN).otherwise(F.col("rule_id")))
    return out


def _told(stmts: DataFrame, rules: set[str], *more: Column) -> DataFrame:
    """The findings of rules on one statement each, beside columns of the prepared statement: nothing is shuffled."""
    facts = [fact for rule, fact in one_statement() if rule in _asked(rules)]
    facts = F.concat(*facts) if facts else _if(F.lit(False), _fact("", F.lit(""), True))
    rows = prepared(stmts).select("file", "stmt", "line", "col", *more, F.explode(facts).alias("f"))
    kept = rows.columns[4:-1]
    return _worded(_renamed(rows.select("file", "stmt", "line", "col", "f.rule_id", "f.severity", "f.lock_level", "f.snippet", *kept), rules))


def _worded(out: DataFrame) -> DataFrame:
    said = F.create_map(*(F.lit(x) for kv in MESSAGES.items() for x in kv))[F.col("rule_id")]
    return out.withColumn("message", F.concat(said, F.lit(": "), F.col("snippet")))


def findings(stmts: DataFrame, rules: set[str] | None = None) -> DataFrame:
    """The findings of all rules, or of some. ``check-constraint-not-valid`` is a twin of ``check-constraint-missing-not-valid``
    and speaks only where that one is left out. Statements say facts in one pass; those of a script that are about one thing meet in one shuffle, of
    which rules on one statement each have no need."""
    if _alone(rules):
        return _told(stmts, rules)
    asked = None if rules is None else _asked(rules)
    said = [fact for part in (one_statement, transactions, drop_add_pairs, lock_accumulation, attach_without_check, key_over_nullable, enum_recreated, type_rewrites) for rule, fact in part() if asked is None or rule in asked]
    said = F.concat(*said) if said else _if(F.lit(False), _fact("", F.lit(""), True))
    out = _judged(prepared(stmts).select("file", "stmt", "line", "col", F.explode(said).alias("f")).select("file", "stmt", "line", "col", "f.*"))
    return _worded(out if rules is None else _renamed(out, rules).filter(F.col("rule_id").isin(*rules)))


def fixes(stmts: DataFrame, rules: set[str]) -> DataFrame:
    """The findings of some rules with ``fix_sql`` as ``remedy_sql`` gives it. For rules on one statement each the statement goes along with its finding, so
    scripts are cut once and nothing is joined."""
    if not _alone(rules):
        return remedy_sql(findings(stmts, rules), stmts)
    rows = _told(stmts, rules, F.col("raw"), F.col("target"), F.col("clauses"), F.transform("items", lambda x: x["raw"]).alias("written"))
    return _fixed(rows, [c for c in rows.columns if c not in ("raw", "target", "clauses", "written")])


def remedy_sql(found: DataFrame, stmts: DataFrame) -> DataFrame:
    """Findings with ``fix_sql``: statements that do the same without the hazard, where they follow from the statement; else null.
    New names end in a hash of the clause, so they are the same in every run."""
    rows = found.join(prepared(stmts).select("file", "stmt", "raw", "target", "clauses", F.transform("items", lambda x: x["raw"]).alias("written")), ["file", "stmt"], "left")
    return _fixed(rows, found.columns)


def _fixed(rows: DataFrame, columns: list[str]) -> DataFrame:
    at = F.array_position("clauses", F.col("snippet"))
    clause = F.when((at > 0) & (F.size("clauses") == F.size("written")), F.element_at("written", F.when(at > 0, at.cast("int")).otherwise(1)))
    table = F.regexp_extract("raw", rf"(?i)^ALTER TABLE (?:IF EXISTS )?{_REL} ", 1)
    alter = F.concat(F.lit("ALTER TABLE "), table, F.lit(" "))
    raw, mark = F.col("raw"), F.substring(F.md5(F.concat_ws(" ", table, clause)), 1, 8)
    name = F.regexp_extract(clause, r"(?i)^ADD (?:COLUMN )?(?:IF NOT EXISTS )?(\S+)", 1)
    given = F.regexp_extract(clause, r"(?i)^ADD CONSTRAINT (\S+)", 1)
    called = F.when(given != "", given).otherwise(F.concat(F.lit("c_"), mark))
    body = F.regexp_replace(clause, r"(?i)^ADD (?:CONSTRAINT \S+ )?", "")
    keys = F.regexp_extract(clause, r"\( ([^)]*) \)", 1)
    altered = F.regexp_extract(clause, r"(?i)^ALTER (?:COLUMN )?(\S+)", 1)
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))

    def checked(column: Column) -> Column:
        rule = text("n_", mark)
        return text(alter, "ADD CONSTRAINT ", rule, " CHECK (", column, " IS NOT NULL) NOT VALID;\n", alter, "VALIDATE CONSTRAINT ", rule, ";\n", alter, "ALTER COLUMN ", column, " SET NOT NULL;\n", alter, "DROP CONSTRAINT ", rule, ";")

    deferred = text(alter, "ADD CONSTRAINT ", called, " ", body, " NOT VALID;\n", alter, "VALIDATE CONSTRAINT ", called, ";")
    by_index = lambda kind: text("CREATE UNIQUE INDEX CONCURRENTLY i_", mark, " ON ", table, " (", keys, ");\n", alter, "ADD CONSTRAINT ", called, f" {kind} USING INDEX i_", mark, ";")
    rows_of = F.regexp_extract(raw, r"(?i)^(?:UPDATE|DELETE FROM) ((?:ONLY )?\S+(?: \. \S+)?)", 1)
    where = F.regexp_extract(raw, r"(?i)\bWHERE (.*)$", 1)
    change = F.regexp_replace(raw, r"(?i) WHERE .*$", "")
    batch = text(change, " WHERE ctid = ANY (ARRAY(SELECT ctid FROM ", rows_of, F.when(where != "", text(" WHERE ", where)).otherwise(""), " LIMIT 5000));")
    part = F.regexp_extract(raw, r"(?i) ATTACH PARTITION (\S+(?: \. \S+)?)", 1)
    check = text("ALTER TABLE ", part, " ADD CONSTRAINT b_", F.substring(F.md5(raw), 1, 8), " CHECK (/* the bounds: */ ", F.regexp_extract(raw, r"(?i) (FOR VALUES .*|DEFAULT)$", 1), ") NOT VALID;\n")
    rule = text("b_", F.substring(F.md5(raw), 1, 8), ";")
    attached = text(check, "ALTER TABLE ", part, " VALIDATE CONSTRAINT ", rule, "\n", raw, ";\nALTER TABLE ", part, " DROP CONSTRAINT ", rule)
    made = {
        "require-concurrent-index": text(F.regexp_replace(raw, r"(?i)^CREATE (UNIQUE )?INDEX ", "CREATE $1INDEX CONCURRENTLY "), ";"),
        "non-concurrent-drop-index": text(F.regexp_replace(raw, r"(?i)^DROP INDEX ", "DROP INDEX CONCURRENTLY "), ";"),
        "reindex-missing-concurrently": text(F.regexp_replace(raw, r"(?i)\b(TABLE|INDEX|SCHEMA|DATABASE|SYSTEM) ", "$1 CONCURRENTLY "), ";"),
        "session-advisory-lock": text(F.regexp_replace(raw, r"(?i)\bpg_(try_)?advisory_lock", "pg_$1advisory_xact_lock"), ";"),
        "unbatched-dml": batch,
        "add-column-not-null-without-default": text(alter, F.regexp_replace(clause, r"(?i) NOT NULL\b", ""), ";\n", checked(name)),
        "set-not-null-full-scan": checked(altered),
        "foreign-key-missing-not-valid": deferred, "check-constraint-missing-not-valid": deferred, "check-constraint-not-valid": deferred,
        "unique-constraint-using-index": by_index("UNIQUE"), "add-primary-key-missing-using-index": by_index("PRIMARY KEY"),
        "unindexed-foreign-key": text("CREATE INDEX CONCURRENTLY i_", mark, " ON ", table, " (", keys, ");"),
        "drop-column-lock": text("SET lock_timeout = '2s';\n", alter, clause, ";"),
        "detach-partition-non-concurrent": text(alter, clause, " CONCURRENTLY;"), "attach-partition-missing-check": attached, "partition-scan-lock": attached,
        "volatile-default": text(alter, F.regexp_replace(clause, r"(?i) DEFAULT .*$", ""), ";\n", alter, "ALTER COLUMN ", name, " SET DEFAULT", F.regexp_extract(clause, r"(?i)\bDEFAULT( .*)$", 1), ";"),
    }
    fix = F.lit(None).cast("string")
    for rule_id, sql in made.items():
        fix = F.when(F.col("rule_id") == rule_id, sql).otherwise(fix)
    return rows.select(*columns, fix.alias("fix_sql"))


def edits(found: DataFrame, stmts: DataFrame, scripts: DataFrame) -> DataFrame:
    """(file, low, high, text): edits of the scripts' texts that take a hazard away in place. Concurrent forms only outside of
    transactions; NOT VALID only where the statement has one clause."""
    rows = found.join(prepared(stmts).select("file", "stmt", "low", "high", "in_tx", "is_orm", F.size("clauses").alias("n")), ["file", "stmt"])
    # a script meets the list of its findings once; its text is not shuffled for each of them
    listed = rows.groupBy("file").agg(F.collect_list(F.struct("rule_id", "low", "high", "in_tx", "is_orm", "n")).alias("f"))
    texts = scripts.select("file", F.regexp_replace("text", "^\ufeff", "").alias("whole"), F.length(F.regexp_extract("text", "^\ufeff", 0)).alias("mark"))
    rows = texts.join(listed, "file").select("file", "whole", "mark", F.explode("f").alias("f")).select("file", "whole", "mark", "f.*")
    own = F.col("whole").substr(F.col("low") + 1, F.col("high") - F.col("low"))
    free = ~F.col("in_tx") & ~F.col("is_orm")
    after = lambda pattern: F.length(F.regexp_extract(own, pattern, 0))
    here, put, none = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("int")
    upto = none
    gap = r"(?:\s+|/\*[\s\S]*?\*/)+"
    for rule_id, pattern in (
        ("require-concurrent-index", rf"(?i)^CREATE{gap}(?:UNIQUE{gap})?INDEX"), ("non-concurrent-drop-index", rf"(?i)^DROP{gap}INDEX"),
        ("reindex-missing-concurrently", rf"(?i)^REINDEX{gap}(?:\([^)]*\)\s*)?(?:TABLE|INDEX|SCHEMA|DATABASE|SYSTEM)"),
    ):
        hit = (F.col("rule_id") == rule_id) & free & (after(pattern) > 0)
        here, put, upto = F.when(hit, after(pattern)).otherwise(here), F.when(hit, " CONCURRENTLY").otherwise(put), F.when(hit, after(pattern)).otherwise(upto)
    size = F.col("high") - F.col("low")
    for rule_ids, word, ok in ((("foreign-key-missing-not-valid", "check-constraint-missing-not-valid"), " NOT VALID", F.lit(True)), (("detach-partition-non-concurrent",), " CONCURRENTLY", free)):
        hit = F.col("rule_id").isin(*rule_ids) & (F.col("n") == 1) & ok
        here, put, upto = F.when(hit, size).otherwise(here), F.when(hit, word).otherwise(put), F.when(hit, size).otherwise(upto)
    lock = F.instr(F.lower(own), "advisory_lock")
    hit = (F.col("rule_id") == "session-advisory-lock") & (lock > 0)
    here, put, upto = F.when(hit, lock - 1).otherwise(here), F.when(hit, "advisory_xact_lock").otherwise(put), F.when(hit, lock + 12).otherwise(upto)
    low = F.col("mark") + F.col("low")
    return rows.select("file", (low + here).cast("int").alias("low"), (low + upto).cast("int").alias("high"), put.alias("text")).filter("low IS NOT NULL").distinct()


# Findings: overrides, waivers, counts

# Other names of rules, as settings and waivers may say them.
ALIASES = {
    "non-concurrent-index": ("require-concurrent-index",), "require-concurrent-index": ("non-concurrent-index",),
    "unvalidated-foreign-key": ("foreign-key-missing-not-valid", "foreign-key-not-valid"), "foreign-key-missing-not-valid": ("unvalidated-foreign-key", "foreign-key-not-valid"),
    "foreign-key-not-valid": ("unvalidated-foreign-key", "foreign-key-missing-not-valid"),
    "add-column-not-null": ("add-column-not-null-without-default",), "add-column-not-null-without-default": ("add-column-not-null",),
    "check-constraint-not-valid": ("check-constraint-missing-not-valid",), "check-constraint-missing-not-valid": ("check-constraint-not-valid",),
    "concurrent-in-transaction": ("concurrent-index-in-transaction",), "concurrent-index-in-transaction": ("concurrent-in-transaction",),
    "partition-scan-lock": ("attach-partition-missing-check",), "attach-partition-missing-check": ("partition-scan-lock",),
}
_LOCKS = ("lock-access-exclusive", "access-exclusive", "access exclusive")
_SHORT = {"concurrent-index": "require-concurrent-index", "not-valid": "foreign-key-missing-not-valid", "batching": "unbatched-dml", "rename": "prisma-silent-rename-data-loss"}


def _names_of(rule_id: Column, lock_level: Column) -> Column:
    """All names by which a waiver can mean a finding: everything, its rule, the rule's other names, its lock level."""
    other = F.create_map(*(x for name in sorted({a for names in ALIASES.values() for a in names}) for x in (F.lit(name), F.array(*(F.lit(k) for k, names in ALIASES.items() if name in names)))))
    rule = F.lower(rule_id)
    lock = F.when(lock_level == AX, F.array(*(F.lit(x) for x in _LOCKS))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lit("*"), F.lit("all"), rule, F.lower(lock_level)), F.coalesce(other[rule], F.array().cast("array<string>")), lock))


def ignored(found: DataFrame, stmts: DataFrame) -> DataFrame:
    """Findings without those that a comment of their statement ignores: ``schemaloom-ignore`` or ``schemaloom-disable`` alone means all rules, and
    with names behind it those rules. The next-line waiver is another thing (``waived``)."""
    c = F.lower("comment")
    directive = c.contains("schemaloom-ignore") | (c.contains("schemaloom-disable") & ~c.contains("schemaloom-disable-next-line"))
    said = stmts.select("file", "stmt", F.explode("comments").alias("comment")).filter(directive).select("file", "stmt", c.alias("comment"))
    bare = F.trim(F.regexp_replace(F.regexp_extract("comment", r"schemaloom-(?:ignore|disable)([\s\S]*)$", 1), r"\*/\s*$", "")) == ""
    said = said.groupBy("file", "stmt").agg(F.max(bare).alias("everything"), F.collect_list("comment").alias("directives"))
    hit = F.col("everything") | F.exists("directives", lambda d: F.contains(d, F.lower("rule_id")))
    return found.join(said, ["file", "stmt"], "left").filter(~F.coalesce(hit, F.lit(False))).select(*found.columns)


def placed(found: DataFrame, spans: DataFrame) -> DataFrame:
    """Findings from elsewhere (file, line, col, ...) with ``stmt``, the first statement that contains the place; null if none does.
    ``spans``: file, stmt, line, col, end_line, end_col (behind the last character). They may overlap.

    Among spans in order only those that reach further than all before them can be the first to contain a place, and the first of these that ends
    behind the place is it, if it has begun by then. So both go into one list by place, and a window looks ahead for the next end: one shuffle by
    file, no pairs.
    """
    at = lambda line, col: F.struct(F.col(line).cast("long").alias("line"), F.col(col).cast("long").alias("col"))
    names = found.columns
    order = W.partitionBy("file").orderBy("begin", "end_at", "stmt").rowsBetween(W.unboundedPreceding, -1)
    s = spans.select("file", "stmt", at("line", "col").alias("begin"), at("end_line", "end_col").alias("end_at"))
    reach = s.withColumn("before", F.max("end_at").over(order)).filter("before IS NULL OR end_at > before")
    ends = reach.select("file", F.col("end_at").alias("place"), F.lit(1).alias("is_end"), F.struct("stmt", "begin").alias("span"), *(F.lit(None).cast(found.schema[c].dataType).alias(f"f_{i}") for i, c in enumerate(names)))
    rows = found.select("file", at("line", "col").alias("place"), F.lit(2).alias("is_end"), F.lit(None).cast(ends.schema["span"].dataType).alias("span"), *(F.col(c).alias(f"f_{i}") for i, c in enumerate(names)))
    # an end sorts before a place at the same spot, which it does not contain
    ahead = W.partitionBy("file").orderBy("place", "is_end").rowsBetween(W.currentRow, W.unboundedFollowing)
    both = ends.union(rows).withColumn("span", F.first("span", ignorenulls=True).over(ahead)).filter("is_end = 2")
    return both.select(*(F.col(f"f_{i}").alias(c) for i, c in enumerate(names)), F.when(F.col("span.begin") <= F.col("place"), F.col("span.stmt")).alias("stmt"))


def override(found: DataFrame, settings: dict[str, str]) -> DataFrame:
    """Settings by rule id, one of its other names or lock level, in this order: off, false and 0 drop a finding, a severity replaces its own."""
    if not settings:
        return found
    lower = {k.lower(): v for k, v in settings.items()}
    lower = {_SHORT[k]: v for k, v in lower.items() if k in _SHORT} | lower
    other = {a: lower[k] for k, names in ALIASES.items() if k in lower for a in names}
    lock = next((lower[k] for k in _LOCKS if k in lower), None)
    by_name = lambda values: F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.lower("rule_id")] if values else F.lit(None).cast("string")
    value = F.coalesce(by_name(lower), by_name(other), F.when(F.col("lock_level") == AX, F.lit(lock)))
    said = F.upper(value)
    return found.withColumn("set", said).filter("set IS NULL OR set NOT IN ('OFF', 'FALSE', '0')").withColumn(
        "severity", F.when(F.col("set").isin("BLOCKER", "WARNING", "ADVISORY"), F.col("set")).otherwise(F.col("severity"))
    ).drop("set")


WAIVER = r"schemaloom-disable-next-line\s*((?:(?!reason=|expires=)[A-Za-z*-]+ ?)*)"


def waivers(stmts: DataFrame) -> DataFrame:
    """(file, stmt, line, col, waives, reason, expires) from comments such as
    ``-- schemaloom-disable-next-line rule reason="..." expires="YYYY-MM-DD"``."""
    c = F.col("comment")
    return stmts.select("file", "stmt", "line", "col", F.explode("comments").alias("comment")).filter(c.contains("schemaloom-disable-next-line")).select(
        "file", "stmt", "line", "col",
        F.coalesce(F.nullif(F.trim(F.regexp_extract(c, WAIVER, 1)), F.lit("")), F.lit("*")).alias("waives"),
        F.regexp_extract(c, r'reason="([^"]*)"', 1).alias("reason"), F.regexp_extract(c, r'expires="([^"]*)"', 1).alias("expires"),
    )


def waived(found: DataFrame, said: DataFrame, today: str) -> DataFrame:
    """Findings with ``suppressed``; waivers without a reason of eight characters, or expired, are findings themselves."""
    bad = F.when(F.length("reason") < 8, "invalid-waiver").when((F.col("expires") != "") & (F.lit(today) > F.col("expires")), "expired-waiver")
    said = said.withColumn("bad", bad)
    good = said.filter("bad IS NULL").select("file", "stmt", F.lower("waives").alias("waives")).groupBy("file", "stmt").agg(F.collect_set("waives").alias("waives"))
    hit = F.arrays_overlap("waives", _names_of(F.col("rule_id"), F.col("lock_level")))
    rows = found.join(good, ["file", "stmt"], "left").withColumn("suppressed", F.coalesce(hit, F.lit(False))).drop("waives")
    errors = said.filter("bad IS NOT NULL").select("file", "stmt", "line", "col", F.col("bad").alias("rule_id"), F.lit("BLOCKER").alias("severity"), F.lit("NONE").alias("lock_level"), F.col("waives").alias("snippet"), F.concat(F.lit("the waiver does not hold: "), "waives").alias("message"), F.lit(False).alias("suppressed"))
    return rows.unionByName(errors)


def report(found: DataFrame) -> DataFrame:
    """Per file: counts by severity and whether it fails."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return found.groupBy("file").agg(n("BLOCKER").alias("blockers"), n("WARNING").alias("warnings"), n("ADVISORY").alias("advisories")).withColumn("failed", F.col("blockers") > 0)


def sarif_level(severity: Column) -> Column:
    return F.when(severity == "BLOCKER", "error").when(severity == "ADVISORY", "note").otherwise("warning")


