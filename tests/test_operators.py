"""Operators on small fixed inputs."""

import datetime as dt
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from schemaloom.functions import masking, numbers, telemetry
from schemaloom.operators import drift, indexes, ledger, lint, locks, objects, partitions, readiness, reports, statements
from schemaloom.sources import backups, catalog, config, logs, scripts
from schemaloom.streaming import locks as streams


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lit(x):
    return F.lit(x)


# Statements and rules


def stmts(spark, text, **extra):
    df = statements.statements(spark.createDataFrame([("f", text)], "file string, text string"))
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def rules(spark, text, **extra):
    return sorted((r.rule_id, r.line, r.severity) for r in lint.findings(stmts(spark, text, **extra)).collect())


def test_statements_keep_quotes_comments_and_dollars(spark):
    text = "﻿-- a; b\nSELECT 'x;''y\\'; z', \"q;r\" /* ; */ FROM t;\n\n;CREATE FUNCTION f() AS $$ BEGIN; END $$; DO $tag$ a; $$ ; b $tag$;\nSELECT a.b::int >= 1.5"
    got = [(r.line, r.raw, r.comments) for r in stmts(spark, text).orderBy("stmt").collect()]
    assert got == [
        (2, "SELECT 'x;''y\\'; z' , \"q;r\" FROM t", ["-- a; b", "/* ; */"]),
        (4, "CREATE FUNCTION f ( ) AS $$ BEGIN; END $$", []),
        (4, "DO $tag$ a; $$ ; b $tag$", []),
        (5, "SELECT a . b :: int >= 1.5", []),
    ]


def test_odd_scripts(spark):
    texts = [None, "", "   \n", ";;;", "-- only a comment", "'unterminated ; ", "/* open ;", "$$ open ;", '"open ;', "$1 + $2", "'" + "x" * 200_000 + "'", "(" * 50_000, "a;" * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file int, text string")
    got = {r.file: r.n for r in statements.statements(df).groupBy("file").agg(F.count("*").alias("n")).collect()}
    assert got == {5: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1, 12: 20_000}
    assert lint.findings(statements.statements(df)).count() == 0


def test_places_and_transactions_of_statements(spark):
    text = "\ufeff  SELECT 1; /* x\n */ BEGIN;\n  UPDATE t\nSET a = 1 ;COMMIT; SELECT 2"
    rows = stmts(spark, text).orderBy("stmt").collect()
    assert [(r.line, r.col, r.in_tx, r.scope) for r in rows] == [(1, 3, False, 0), (2, 5, False, 1), (3, 3, True, 1), (4, 12, True, 2), (4, 20, False, 2)]
    assert [text[1:][r.low : r.high] for r in rows] == ["SELECT 1", "BEGIN", "UPDATE t\nSET a = 1", "COMMIT", "SELECT 2"]


def test_edits_take_hazards_away(spark):
    text = "\ufeffCREATE  UNIQUE INDEX i ON t (a);\ndrop /* old */ index j;\nREINDEX (VERBOSE) TABLE t;\nALTER TABLE t ADD CHECK (a > 0);\nALTER TABLE t ADD CHECK (a > 0), ADD b int;\nSELECT pg_try_advisory_lock(1);\nBEGIN;\nCREATE INDEX k ON t (a);\nCOMMIT"
    df = spark.createDataFrame([("f", text)], "file string, text string")
    s = statements.statements(df)
    patched = reports.apply_fixes(df, lint.edits(lint.findings(s), s, df)).first().patched
    assert patched == text.replace("INDEX i", "INDEX CONCURRENTLY i").replace("index j", "index CONCURRENTLY j").replace("TABLE t;", "TABLE CONCURRENTLY t;", 1).replace("(a > 0);", "(a > 0) NOT VALID;", 1).replace("advisory_lock", "advisory_xact_lock")


def test_remedies_keep_names_as_written(spark):
    s = stmts(spark, 'ALTER TABLE "My Table" ADD COLUMN "Role" text NOT NULL; ALTER TABLE t ADD UNIQUE (a, b), DROP COLUMN c; ALTER TABLE t ADD COLUMN d timestamp DEFAULT now()')
    got = {r.rule_id: r.fix_sql for r in lint.remedy_sql(lint.findings(s), s).collect()}
    first = got["add-column-not-null-without-default"]
    assert first.startswith('ALTER TABLE "My Table" ADD COLUMN "Role" text;\n') and 'ALTER COLUMN "Role" SET NOT NULL' in first
    assert "CREATE UNIQUE INDEX CONCURRENTLY" in got["unique-constraint-using-index"] and "(a , b)" in got["unique-constraint-using-index"]
    assert got["volatile-default"].endswith("ALTER COLUMN d SET DEFAULT now ( );") and got["drop-column-lock"].endswith("DROP COLUMN c;")


def test_objects_that_scripts_leave(spark):
    s = stmts(spark, "CREATE UNIQUE INDEX \"Ix\" ON ONLY s.t USING btree (lower(a), b) WHERE a > 0; CREATE INDEX j ON t (a); DROP INDEX IF EXISTS J, k; CREATE TABLE T (a int, CONSTRAINT C CHECK (a > 0));"
              "ALTER TABLE t ADD CONSTRAINT d UNIQUE (a) NOT VALID, ADD CONSTRAINT e CHECK (b > 1); ALTER TABLE t DROP CONSTRAINT e; ALTER TABLE t VALIDATE CONSTRAINT d; CREATE TYPE m AS ENUM ('x', 'it''s'); ALTER TYPE m ADD VALUE 'z'")
    assert [tuple(r)[1:] for r in objects.ddl_indexes(s).collect()] == [("Ix", "s.t", True, False, ["lower ( a )", "b"], "a > 0")]
    assert {tuple(r)[1:] for r in objects.ddl_constraints(s).collect()} == {("t", "c", "c", True, "CHECK ( a > 0 )"), ("t", "d", "u", True, "UNIQUE ( a )")}
    assert [tuple(r)[1:] for r in objects.ddl_enums(s).collect()] == [("m", ["x", "it's", "z"])]


def test_tokens_cover_the_text(spark):
    text = "SELECT 'a' -- c\n, $$x$$, \"é\" <> 1;\tUPDATE t SET ü = 2;"
    rows = statements.tokens(spark.createDataFrame([("f", text)], "file string, text string")).collect()
    assert all(text[r["at"] : r["at"] + len(r.token)] == r.token for r in rows)


CASES = [
    ("CREATE INDEX i ON t (a);\nCREATE UNIQUE INDEX j ON t (b);", [("require-concurrent-index", 1, "BLOCKER"), ("require-concurrent-index", 2, "BLOCKER")]),
    ("CREATE INDEX CONCURRENTLY i ON t (a)", []),
    ("BEGIN;\nCREATE INDEX CONCURRENTLY i ON t (a);\nCOMMIT;\nCREATE INDEX CONCURRENTLY j ON t (a)", [("concurrent-index-in-transaction", 2, "BLOCKER")]),
    ("ALTER TABLE users ADD COLUMN role VARCHAR(50) NOT NULL, ADD x numeric(10, 2) NOT NULL DEFAULT 0", [("add-column-not-null-without-default", 1, "BLOCKER")]),
    ("ALTER TABLE o ADD CONSTRAINT f FOREIGN KEY (a) REFERENCES u (id)", [("foreign-key-missing-not-valid", 1, "BLOCKER"), ("unindexed-foreign-key", 1, "WARNING")]),
    ("ALTER TABLE o ADD CONSTRAINT c CHECK (a IN (1, 2)) NOT VALID; ALTER TABLE o VALIDATE CONSTRAINT c", []),
    ("ALTER TABLE o ALTER COLUMN a SET NOT NULL", [("set-not-null-full-scan", 1, "WARNING")]),
    ("UPDATE t SET a = 1;\nDELETE FROM t WHERE a = 1;\n-- in batches\nUPDATE t SET a = 2", [("unbatched-dml", 1, "BLOCKER"), ("unbatched-dml", 2, "WARNING")]),
    ("ALTER TABLE t ADD CONSTRAINT u UNIQUE USING INDEX i", []),
    ("SELECT pg_advisory_lock(1), pg_try_advisory_lock(2)", [("session-advisory-lock", 1, "WARNING")] * 2),
    ("ALTER TABLE t ADD COLUMN a timestamp DEFAULT now()", [("volatile-default", 1, "BLOCKER")]),
    ("ALTER TABLE t ALTER COLUMN id ADD GENERATED ALWAYS AS IDENTITY (START WITH 1)", [("identity-sequence-start-with", 1, "BLOCKER")]),
    ("ALTER TABLE t ALTER COLUMN id ADD GENERATED ALWAYS AS IDENTITY (START WITH 1000)", []),
    ("ALTER TABLE p ATTACH PARTITION q FOR VALUES IN (1)", [("attach-partition-missing-check", 1, "BLOCKER"), ("partition-scan-lock", 1, "BLOCKER")]),
    ("ALTER TABLE q VALIDATE CONSTRAINT c; ALTER TABLE p ATTACH PARTITION q FOR VALUES IN (1)", []),
    ("ALTER TABLE t ADD PRIMARY KEY USING INDEX i", [("primary-key-using-index-nullable-column", 1, "WARNING")]),
    ("DROP TYPE e; CREATE TYPE e AS ENUM ('a'); ALTER TABLE t ALTER c TYPE e USING c::text::e", [("alter-column-type-rewrite", 1, "BLOCKER"), ("enum-recreate-table-rewrite", 1, "BLOCKER")]),
    ("CREATE TABLE t (a varchar(10), b int);\nALTER TABLE t ALTER COLUMN a TYPE varchar(20);\nALTER TABLE t ALTER COLUMN b TYPE bigint", [("alter-column-type-rewrite", 2, "WARNING"), ("alter-column-type-rewrite", 3, "BLOCKER")]),
    ("ALTER TABLE u DROP COLUMN a, ADD COLUMN b text", [("drop-column-lock", 1, "WARNING"), ("prisma-silent-rename-data-loss", 1, "BLOCKER")]),
    ("BEGIN; ALTER TABLE t RENAME a TO b;\nUPDATE t SET a = 1 LIMIT 1; COMMIT", [("lock-accumulation-mixed-ddl-dml", 2, "BLOCKER")]),
    ("BEGIN; ALTER TABLE t RENAME a TO b; UPDATE t SET a = 1 LIMIT 1", []),
    ("BEGIN; ALTER TYPE e ADD VALUE 'x'; END", [("enum-add-value-in-transaction", 1, "BLOCKER"), ("non-transactional-in-transaction", 1, "BLOCKER")]),
    ("REINDEX TABLE t; VACUUM t; DROP INDEX i; ALTER TABLE p DETACH PARTITION q", [("detach-partition-non-concurrent", 1, "BLOCKER"), ("maintenance-command-detected", 1, "BLOCKER"), ("non-concurrent-drop-index", 1, "BLOCKER"), ("reindex-missing-concurrently", 1, "BLOCKER")]),
    ("SELECT 'CREATE INDEX i ON t (a)'", []),
]


def test_rules(spark):
    df = spark.createDataFrame([(str(i), text) for i, (text, _) in enumerate(CASES)], "file string, text string")
    got = {}
    for r in lint.findings(statements.statements(df)).collect():
        got.setdefault(int(r.file), []).append((r.rule_id, r.line, r.severity))
        assert r.message.endswith(r.snippet) and r.col >= 1
    for i, (text, want) in enumerate(CASES):
        assert sorted(got.get(i, [])) == sorted(want), text


def test_rules_follow_version_and_tool(spark):
    assert rules(spark, "ALTER TABLE o ALTER COLUMN a SET NOT NULL", pg_version=11) == [("set-not-null-full-scan", 1, "BLOCKER")]
    assert rules(spark, "ALTER TABLE p DETACH PARTITION q", pg_version=13) == []
    assert rules(spark, "CREATE INDEX CONCURRENTLY i ON t (a)", is_orm=True) == [("concurrent-index-in-transaction", 1, "BLOCKER")]


def test_waivers_and_overrides(spark):
    s = stmts(spark, '-- schemaloom-disable-next-line require-concurrent-index reason="small table, agreed" expires="2999-01-01"\nCREATE INDEX i ON t (a);\n-- schemaloom-disable-next-line\nDROP INDEX j')
    out = {(r.rule_id, r.suppressed) for r in lint.waived(lint.findings(s), lint.waivers(s), "2024-01-01").collect()}
    assert out == {("require-concurrent-index", True), ("non-concurrent-drop-index", False), ("invalid-waiver", False)}
    assert {r.rule_id for r in lint.waived(lint.findings(s), lint.waivers(s), "3000-01-01").collect()} >= {"expired-waiver"}
    got = {(r.rule_id, r.severity) for r in lint.override(lint.findings(s), {"ACCESS EXCLUSIVE": "warning", "require-concurrent-index": "0"}).collect()}
    assert got == {("non-concurrent-drop-index", "WARNING")}


def test_slices_and_fixes(spark):
    s = stmts(spark, "CREATE TABLE a (b int); CREATE INDEX CONCURRENTLY i ON a (b); ALTER TYPE e ADD VALUE 'x'; SELECT 1")
    got = {r.phase: (r.n, r.text) for r in statements.slices(s).collect()}
    assert got["phase1_tx"] == (2, "CREATE TABLE a ( b int );\n\nSELECT 1;") and got["phase2_autocommit"][0] == 2
    edits = spark.createDataFrame([("f", 0, 3, "XY"), ("f", 2, 5, "no"), ("f", 4, 5, "E"), ("f", 6, 6, "+")], "file string, low int, high int, text string")
    assert reports.apply_fixes(spark.createDataFrame([("f", "abcdefgh"), ("g", "same")], "file string, text string"), edits).orderBy("file").collect() == [("f", "XYdEf+gh"), ("g", "same")]


def test_scripts_from_folders(spark, tmp_path):
    for name in ("20240101_a.sql", "x/migration.sql", "node_modules/b.sql", "skip/c.sql", "d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text("SELECT 1;")
    rows = scripts.migration_names(scripts.read_scripts(spark, str(tmp_path), ignore=("skip/*",)))
    assert {(r.name, r.layout) for r in rows.collect()} == {("20240101_a", "flat"), ("x", "folders")}


def test_columns_that_scripts_leave(spark):
    text = "CREATE TABLE t (id bigint PRIMARY KEY, a numeric(10, 2) DEFAULT 0, CONSTRAINT c CHECK (a > 0)); ALTER TABLE t ADD COLUMN b text NOT NULL, DROP COLUMN a; CREATE TABLE u (x int); DROP TABLE u; ALTER TABLE t ADD IF NOT EXISTS a int"
    got = {tuple(r)[1:] for r in objects.ddl_columns(stmts(spark, text)).collect()}
    assert got == {("t", "id", "bigint", True, None), ("t", "b", "text", True, None), ("t", "a", "integer", False, None)}


def test_rule_selection_and_twins(spark):
    s = stmts(spark, "ALTER TABLE t ADD CHECK (a > 0); CREATE INDEX i ON t (a); ALTER TYPE e ADD VALUE 'x'; INSERT INTO t VALUES ('x')")
    ids = lambda rules: sorted(r.rule_id for r in lint.findings(s, rules).collect())
    assert ids({"check-constraint-not-valid"}) == ["check-constraint-not-valid"]
    assert ids({"check-constraint-not-valid", "check-constraint-missing-not-valid"}) == ["check-constraint-missing-not-valid"]
    assert ids({"enum-add-value-in-transaction"}) == ["enum-add-value-in-transaction"]


def test_reports_and_logs(spark, tmp_path):
    import json

    s = lint.findings(stmts(spark, "DROP INDEX i;\nCREATE INDEX i ON t (a)"))
    report = json.loads(reports.json_report(s).first().report)
    assert (report["blockers"], [f["line"] for f in report["findings"]]) == (2, [1, 2])
    assert [r["level"] for r in json.loads(reports.sarif(s).first().results)] == ["error", "error"]
    assert one(spark, reports.annotation(lit("a%\r\nb"))) == ("a%25%0D%0Ab",)
    for i in range(3):
        logs.append(spark.createDataFrame([(dt.datetime(2024, 1, 1 + i), "run" if i else "stop", "{}")], "at timestamp, kind string, details string"), f"{tmp_path}/log")
    assert [r.at.day for r in logs.newest(spark, f"{tmp_path}/log", n=2).collect()] == [3, 2]
    assert logs.newest(spark, f"{tmp_path}/log", "stop").count() == 1


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"rules": {"unbatched-dml": "off"}, "ignore": ["x/**"], "other": 1}')
    assert config.read_config(spark, str(tmp_path / "c.json")) == {"rules": {"unbatched-dml": "off"}, "ignore": ("x/**",), "pg_version": 16}


def test_catalog(spark):
    names = spark.createDataFrame([("Tenant_a",), ("tenant_b",), ("public",), ("pg_catalog",)], "nspname string")
    assert sorted(r.tenant for r in catalog.tenants(names, "tenant*", ("*_B",)).collect()) == ["Tenant_a"]
    n = spark.createDataFrame([(1, "s")], "oid int, nspname string")
    r = spark.createDataFrame([(7, 1, "t", "r")], "oid int, relnamespace int, relname string, relkind string")
    a = spark.createDataFrame([(7, 1, "x"), (7, 2, "y")], "attrelid int, attnum int, attname string")
    i = spark.createDataFrame([(7, 70, [2, 1])], "indrelid int, indexrelid int, indkey array<int>")
    assert [r.key_columns for r in catalog.index_columns(n, r, i, a).collect()] == [["y", "x"]]


# Functions


def test_small_texts(spark):
    assert one(spark, numbers.merged_json(lit('{"a":"1","b":"2"}'), lit('{"b":"3"}')), numbers.merged_json(lit(None).cast("string"), lit("{}"))) == ('{"a":"1","b":"3"}', "{}")
    assert one(spark, *(numbers.type_name(lit(x)) for x in ("VARCHAR( 5 )", "int8", "text []"))) == ("character varying(5)", "bigint", "text []")
    lo, hi = spark.range(1000).select(numbers.jittered(F.col("id").cast("double"), 1).alias("j")).agg(F.min("j"), F.max("j")).first()
    assert 100 <= lo <= hi <= 10_000


def test_log_positions(spark):
    lsn = lambda t: numbers.parse_lsn(lit(t))
    a, b, c, d = one(spark, lsn("16/B374D848"), lsn("FFFFFFFF/FFFFFFFF"), lsn("nonsense"), numbers.format_lsn(lsn("16/B374D848")))
    assert (int(a), int(b), c, d) == (97500059720, 2**64 - 1, None, "16/B374D848")
    assert [int(x) for x in one(spark, numbers.lag_bytes(lit("12.9")), numbers.lag_bytes(lit(None).cast("string")), numbers.lag_bytes(lit("x")))] == [12, 0, 0]


def test_ratios_and_bloat(spark):
    r = lambda a, b: telemetry.read_write_ratio(lit(a), lit(b))
    assert one(spark, r(0, 0), r(5, 0), r(10, 3), numbers.round_up_half(lit(-2.5), 0)) == (1.0, 100.0, 3.33, -2.0)
    assert [telemetry_header(spark, n) for n in (0, 1, 8, 9, 32, 73, 80)] == [24, 24, 24, 32, 32, 40, 40]
    assert one(spark, *(telemetry.compaction_action(lit(float(t)), lit(float(i))) for t, i in ((5, 30), (25, 0), (12, 50), (3, 3)))) == ("REINDEX", "REPACK", "TUNE", "OPTIMAL")
    assert one(spark, *(telemetry.headroom(lit(100), lit(n)) for n in (81, 86, 80, 10))) == ("CRITICAL", "CRITICAL", "SAFE", "SAFE")
    assert one(spark, telemetry.same_mount(lit("/data/"), lit("/data/wal")), telemetry.same_mount(lit("/data"), lit("/data2/wal"))) == (True, False)


def telemetry_header(spark, n):
    return one(spark, telemetry.tuple_header(lit(n)))[0]


@pytest.mark.parametrize(
    ("archived", "failed", "a", "f", "want"),
    [(0, 0, None, None, "NEVER_ARCHIVED"), (0, 2, None, 5, "FAILING_NOW"), (9, 1, 60, 5, "FAILING_NOW"), (9, 1, 5, 9, "RECOVERED"), (9, 0, 20, None, "STALE_ARCHIVE"), (9, 0, 5, None, "HEALTHY"), (9, 1, 20, 30, "STALE_ARCHIVE"), (9, 1, 100, 70, "STALE_ARCHIVE")],
)
def test_archiver_states(spark, archived, failed, a, f, want):
    now = dt.datetime(2024, 1, 1, 12)
    ago = lambda m: lit(now - dt.timedelta(minutes=m)) if m is not None else lit(None).cast("timestamp")
    assert one(spark, telemetry.archiver_state(lit(archived), lit(failed), ago(a), ago(f), lit(now)))[0] == want


def test_masks(spark):
    key = b"k" * 100
    text = hmac.new(key, b"text|abc", hashlib.sha256).hexdigest()
    got = spark.createDataFrame([("abc", "abc", 5), (None, None, None)], "t string, e string, i long")
    rows = masking.mask_columns(got, {"t": "text", "e": "email", "i": "int"}, key).collect()
    assert rows[0].t == text and rows[0].e.endswith("@anonymized.local") and rows[1] == (None, None, None)
    n = spark.range(10_000).select(masking.mask_integer(F.col("id") * 461_168_601_842_738 + 9_007_199_254_740_993, b"key").alias("m"))
    assert n.distinct().count() == 10_000 and n.filter("m < 0").count() == 0


def test_setting_risks(spark):
    rows = [(1, "log_statement", " ALL "), (1, "maintenance_work_mem", "16384"), (1, "autovacuum", "on"), (1, "lock_timeout", "0"), (1, "maintenance_work_mem", "1GB")]
    got = {r.rule_id for r in readiness.setting_risks(spark.createDataFrame(rows, "server int, name string, setting string"), "server").collect()}
    assert got == {"hazardous-log-statement-all", "undersized-maintenance-work-mem", "unbounded-lock-timeout"}


# Graphs, ledgers, drift


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "waiter long, blocker long")


def test_wait_graphs(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    e = edges(spark, [(101, 102), (102, 101), (201, 202), (202, 203), (203, 201), (301, 302), (302, 303), (1, 101), (203, 9), (7, 7)])
    assert sorted(r.pid for r in locks.cycle_members(e).collect()) == [7, 101, 102, 201, 202, 203]
    assert {(r.pid, r.n_waiters) for r in locks.root_blockers(e).collect()} == {(303, 1), (9, 1)}
    assert locks.cycle_members(e.limit(0)).count() == locks.root_blockers(e.limit(0)).count() == 0


def test_conflicts_are_symmetric():
    level = {x[0]: set(x[4]) for x in locks.LOCK_LEVELS}
    assert all((b in level[a]) == (a in level[b]) for a in level for b in level)


def test_sweep_and_latest(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("r", n, p, t, i) for i, (n, p) in enumerate([(1, "PREPARED"), (2, "PREPARED"), (2, "COMMITTED"), (3, "COMMITTED")])] + [("s", 1, "PREPARED", t, 9), ("s", 2, "COMMITTED", t, 10)]
    last = ledger.latest(spark.createDataFrame(rows, "run_id string, node_id int, phase string, prepared_at timestamp, seq int"), ["run_id", "node_id"], [F.col("seq")])
    got = {(r.run_id, r.node_id, r.to_phase) for r in ledger.sweep(last, lit(t + dt.timedelta(hours=1))).collect()}
    assert got == {("r", 1, "HEALED"), ("s", 1, "ABORTED")}
    assert ledger.sweep(last, lit(t)).count() == 0


def test_replay_and_streamed_changes(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "pk long, v string")
    log = spark.createDataFrame([(1, "U", 1, "x"), (2, "D", 2, None), (3, "I", 4, "n"), (4, "U", 1, "y"), (5, "I", 5, "z"), (6, "D", 5, None)], "id long, op string, pk long, v string")
    want = {(1, "y"), (3, "c"), (4, "n")}
    assert {tuple(r) for r in ledger.replay(base, log, "pk", ["v"]).collect()} == want
    state = {-1: [tuple(r) for r in base.collect()]}
    read = lambda: spark.createDataFrame(state[max(state)], "pk long, v string")
    for i in (0, 3):
        log.filter(f"id > {i} AND id <= {i + 3}").coalesce(1).write.parquet(f"{tmp_path}/log/{i}")
    stream = spark.readStream.schema(log.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    apply = streams.apply_changes(read, lambda df, n: state.__setitem__(n, [tuple(r) for r in df.collect()]), "pk", ["v"])
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert set(state[max(state)]) == want


def test_lock_streams_equal_batches(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(minutes=m), p, float(m)) for p, ms in ((1, (0, 30, 60, 300)), (2, (10, 400, 410))) for m in ms]
    spark.createDataFrame(rows, "ts timestamp, pid int, wait double").write.parquet(f"{tmp_path}/s")
    stream = spark.readStream.schema("ts timestamp, pid int, wait double").parquet(f"{tmp_path}/s")
    streams.hold_sessions(stream).writeStream.format("memory").queryName("holds").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.pid, r.ticks) for r in spark.table("holds").collect()) == [(1, 1), (1, 3), (2, 1), (2, 2)]
    batch = locks.hold_islands(spark.read.parquet(f"{tmp_path}/s").select("pid", F.col("ts").alias("tick")), 7200)
    assert sorted((r.pid, r.ticks) for r in batch.collect()) == [(1, 1), (1, 3), (2, 1), (2, 2)]
    streams.queue_trips(stream, "1 hour", max_depth=1).writeStream.format("memory").queryName("trips").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {(r.start.hour, r.trip) for r in spark.table("trips").collect()} == {(0, True), (1, False), (5, True), (6, True)}


def test_keyset_batches(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    got = ledger.keyset_batches(spark.range(0, 1000, 3).repartition(4), "id", 100).orderBy("batch").collect()
    assert [(r.batch, r.n, r.low, r.high) for r in got] == [(0, 100, 0, 297), (1, 100, 300, 597), (2, 100, 600, 897), (3, 34, 900, 999)]


def test_dual_write(spark):
    rows = spark.createDataFrame([(1, 5, 1, 1), (1, 5, None, 5), (2, 3, 2, 3), (None, 4, 1, 4)], "a int, b int, a_before int, b_before int")
    assert [(r.a, r.b) for r in ledger.dual_write(rows, "a", "b").collect()] == [(5, 5), (1, 1), (2, 3), (None, None)]


def test_redundant_indexes(spark):
    rows = [("i1", 1, ["a"], None, False), ("i2", 2, ["a", "b"], None, False), ("i3", 3, ["a", "b", "c"], None, False), ("u", 4, ["a"], None, True), ("p", 5, ["a"], "x", False), ("e", 6, ["b", "a"], None, False)]
    ix = spark.createDataFrame([("s", "t", n, o, k, p, u, False) for n, o, k, p, u in rows], "schema_name string, table_name string, index_name string, ord int, key_columns array<string>, predicate string, is_unique boolean, is_primary boolean")
    assert {(r.index_name, r.subsumed_by) for r in indexes.redundant_indexes(ix).collect()} == {("i1", "i2"), ("i2", "i3")}


def test_drift(spark):
    objects = spark.createDataFrame([(t, "t", c, "int") for t, cs in ((1, "ab"), (2, "ba"), (3, "a")) for c in cs], "tenant int, table_name string, column_name string, data_type string")
    fleet = drift.fleet(drift.fingerprints(objects, ["table_name", "column_name", "data_type"]), F.col("tenant"))
    assert {(r.tenant, r.is_drifted) for r in fleet.collect()} == {(1, False), (2, False), (3, True)}
    assert [tuple(r) for r in drift.missing_objects(objects, objects.filter("tenant = 1"), objects.filter("tenant = 3"), ["column_name"]).collect()] == [(3, "b")]
    live = spark.createDataFrame([("t", "a", "int", True, None)], "table_name string, column_name string, data_type string, is_not_null boolean, default_expr string")
    assert drift.diff_columns(live, live).count() == drift.diff_tables(live, live).count() == 0
    assert [tuple(r) for r in drift.diff_columns(live.limit(0), live).collect()] == [("t", "a", "unsafe", "BLOCKER")]


def test_partitions(spark):
    bounds = partitions.monthly(spark, "e", "2026-07-01", 3)
    rows = spark.createDataFrame([(dt.datetime(2026, 7, 31, 23, 59),), (dt.datetime(2026, 9, 1),), (dt.datetime(2026, 10, 1),), (None,)], "at timestamp_ntz")
    assert sorted(r.part for r in partitions.route(rows, "at", bounds).collect()) == ["default", "default", "e_2026_07", "e_2026_09"]
    names = spark.createDataFrame([("e_2026_07",), ("e_2026_09_01",), ("e_default",), ("e_2026_99",)], "part string")
    assert [r.part for r in partitions.expired(names, "2026-08-01").collect()] == ["e_2026_07"]


def test_backups(spark):
    text = '[{"name":"m","backup":[{"label":"1","error":false,"timestamp":{"stop":1704067200},"size":1},{"label":"2","error":false,"timestamp":{"stop":1704070800000},"size":2},{"label":"3","error":true,"timestamp":{"stop":1704080000},"size":3}]}]'
    got = backups.recovery_point(backups.latest(spark.createDataFrame([(text,), ("broken",), (None,)], "j string"), "j"), F.expr("timestamp'2024-01-01 03:00:00'"), 1).collect()
    assert [(r.stanza, r.backup, r.age_hours, r.within_rpo) for r in got] == [("m", "2", 2, False)]


def test_trees_of_any_depth_and_cycles(spark):
    pairs = [(f"p{i + 1}", f"p{i}") for i in range(12)]
    kind = "child string, parent string"
    assert sorted(r.depth for r in partitions.tree(spark.createDataFrame(pairs, kind), "p0").collect()) == list(range(1, 13))
    assert partitions.tree(spark.createDataFrame(pairs, kind), "other").count() == 0
    with pytest.raises(ValueError):
        partitions.tree(spark.createDataFrame([*pairs[:3], ("p1", "p3")], kind), "p0")


def test_ranges_of_any_length(spark):
    bounds = partitions.daily(spark, "d", "2026-07-01", 2).union(spark.sql("SELECT 'long', timestamp_ntz'2026-07-03 06:00:00', timestamp_ntz'2026-09-01 00:00:00'"))
    rows = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2026-07-01 00:00:00'), (2, timestamp_ntz'2026-07-02 23:59:59.999999'), (3, timestamp_ntz'2026-07-03 05:59:59'), (4, timestamp_ntz'2026-08-31 23:59:59'), (5, timestamp_ntz'2026-09-01 00:00:00'), (6, NULL), (6, NULL) AS t(k, at)")
    got = sorted((r.k, r.part) for r in partitions.route_ranges(rows, "at", bounds).collect())
    assert got == [(1, "d_2026_07_01"), (2, "d_2026_07_02"), (3, "default"), (4, "long"), (5, "default"), (6, "default"), (6, "default")]


def test_extras_roles_and_reports(spark, tmp_path):
    objects = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c")], "tenant int, name string")
    golden, drifted = objects.filter("tenant = 1"), objects.filter("tenant = 2")
    assert [tuple(r) for r in drift.extra_objects(objects, golden, drifted, ["name"]).collect()] == [(2, "c")]
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    e = edges(spark, [(1, 2), (2, 1), (3, 1), (4, 5), (5, 6), (8, 9), (9, 10), (10, 8), (10, 2)])
    cycles = locks.cycle_members(e)
    assert {(r.pid, r.cycle) for r in cycles.collect()} == {(1, 1), (2, 1), (8, 8), (9, 8), (10, 8)}
    assert {r.pid: r.role for r in locks.waits(e, cycles).collect()} == {
        1: "deadlocked", 2: "deadlocked", 3: "behind a deadlock", 4: "queued", 5: "waits and blocks", 6: "root blocker", 8: "deadlocked", 9: "deadlocked", 10: "deadlocked",
    }
    found = lint.findings(stmts(spark, "\n  DROP INDEX i"))
    assert reports.annotations(found).first().text == "::error file=f,line=2,col=3,title=non-concurrent-drop-index::the drop stops reads and writes of the table: DROP INDEX I"
    assert reports.markdown(found).first().text.splitlines()[-1].startswith("| 2 | BLOCKER | non-concurrent-drop-index | ACCESS EXCLUSIVE | the drop")
    scripts.write_scripts(spark.createDataFrame([("a", "x", "SELECT 1;\n\nSELECT 2;")], "file string, phase string, text string"), f"{tmp_path}/out", "phase")
    written = list((tmp_path / "out" / "file=a" / "phase=x").glob("*.txt"))
    assert [f.read_text() for f in written] == ["SELECT 1;\n\nSELECT 2;\n"]


def test_payloads_and_names(spark):
    log = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, '{"a": "no"}'), (3, None), (4, "broken")], "id int, payload string")
    assert [tuple(r) for r in ledger.populated(log, "payload", "a int, b string").orderBy("id").collect()] == [(1, 1, "x"), (2, None, None), (3, None, None), (4, None, None)]
    assert one(spark, numbers.clean_name(lit(' "A""b" ')), numbers.clean_name(lit("Ab"))) == ('A"b', "ab")
