"""Directives, other names of rules, places, phases, parity by hash trees, keyed tables and key graphs."""

import random

import pytest
from pyspark.sql import functions as F

from schemaloom.operators import key_graph, ledger, lint, readiness, statements
from schemaloom.sources.upserts import KeyedTable


def stmts(spark, *texts):
    return statements.statements(spark.createDataFrame(list(enumerate(texts)), "file int, text string"))


def rows(df, *columns):
    return {tuple(r[c] for c in columns or df.columns) for r in df.collect()}


def test_ignore_directives(spark):
    s = stmts(
        spark,
        "-- schemaloom-ignore\nDROP INDEX a; DROP INDEX b; /* schemaloom-disable */ DROP INDEX c; -- SchemaLoom-Ignore non-concurrent-drop-index\nDROP INDEX d; -- schemaloom-ignore unbatched-dml\nDROP INDEX e;"
        "-- schemaloom-disable-next-line * reason=\"long enough\"\nDROP INDEX f; -- schemaloom-disable require-concurrent-index non-concurrent-drop-index\nDROP INDEX g",
    )
    found = lint.findings(s)
    assert found.count() == 7
    assert rows(lint.ignored(found, s), "snippet") == {("DROP INDEX B",), ("DROP INDEX E",), ("DROP INDEX F",)}


@pytest.mark.parametrize(
    ("waives", "held"),
    [("non-concurrent-index", True), ("lock-access-exclusive", False), ("require-concurrent-index", True), ("share", True), ("unbatched-dml", False), ("ALL", True)],
)
def test_waivers_by_other_names(spark, waives, held):
    s = stmts(spark, f"-- schemaloom-disable-next-line {waives} reason=\"agreed with all\"\nCREATE INDEX i ON t (a)")
    assert rows(lint.waived(lint.findings(s), lint.waivers(s), "2024-01-01"), "rule_id", "suppressed") == {("require-concurrent-index", held)}


def test_waivers_of_the_strongest_lock(spark):
    for name in ("lock-access-exclusive", "access-exclusive"):
        s = stmts(spark, f"-- schemaloom-disable-next-line {name} reason=\"agreed with all\"\nALTER TABLE t ADD CHECK (a > 0); -- schemaloom-disable-next-line unvalidated-foreign-key reason=\"agreed with all\"\nALTER TABLE t ADD FOREIGN KEY (a) REFERENCES u (b)")
        assert rows(lint.waived(lint.findings(s), lint.waivers(s), "2024-01-01"), "rule_id", "suppressed") == {
            ("check-constraint-missing-not-valid", True), ("foreign-key-missing-not-valid", True), ("unindexed-foreign-key", False),
        }


def test_settings_by_other_names(spark):
    found = lint.findings(stmts(spark, "CREATE INDEX i ON t (a); ALTER TABLE t ADD FOREIGN KEY (a) REFERENCES u (b), ADD CHECK (a > 0), ADD COLUMN c int NOT NULL"))
    got = lint.override(found, {"non-concurrent-index": "warning", "foreign-key-not-valid": "off", "add-column-not-null": "ADVISORY", "add-column-not-null-without-default": "WARNING", "access-exclusive": "false"})
    assert rows(got, "rule_id", "severity") == {("require-concurrent-index", "WARNING"), ("unindexed-foreign-key", "WARNING"), ("add-column-not-null-without-default", "WARNING")}


def test_places_go_to_the_first_statement_that_has_them(spark):
    text = "-- c\nSELECT 1;  SELECT\n  2 ;\n\nSELECT 'a\nb'"
    s = stmts(spark, text)
    assert [(r.line, r.col, r.end_line, r.end_col) for r in s.orderBy("stmt").collect()] == [(2, 1, 2, 9), (2, 12, 3, 4), (5, 1, 6, 3)]
    places = [(0, line, col, f"{line}:{col}") for line in range(0, 8) for col in range(0, 22)]
    got = lint.placed(spark.createDataFrame(places, "file int, line int, col int, note string"), s)
    spans = [(0, (2, 1), (2, 9)), (1, (2, 12), (3, 4)), (2, (5, 1), (6, 3))]
    want = {(line, col): next((k for k, a, b in spans if a <= (line, col) < b), None) for _, line, col, _ in places}
    assert {(r.line, r.col): r.stmt for r in got.collect()} == want and got.columns == ["file", "line", "col", "note", "stmt"]


def test_places_in_spans_that_overlap(spark):
    rng = random.Random(6)
    spans = []
    for f in range(5):
        for k in range(25):
            a, n = rng.randrange(60), rng.randrange(0, 25)
            spans.append((f, k, a // 10, a % 10, (a + n) // 10, (a + n) % 10))
    places = [(f, p // 10, p % 10, p) for f in range(6) for p in range(-3, 95)]
    got = lint.placed(spark.createDataFrame(places, "file int, line int, col int, p int"), spark.createDataFrame(spans, "file int, stmt int, line int, col int, end_line int, end_col int"))

    def first(f, line, col):
        having = [(s[2:4], s[4:6], s[1]) for s in spans if s[0] == f and s[2:4] <= (line, col) < s[4:6]]
        return min(having)[0] if having else None

    begins = {(s[0], s[1]): s[2:4] for s in spans}
    assert {(r.file, r.p): r.stmt if r.stmt is None else begins[r.file, r.stmt] for r in got.collect()} == {(f, p): first(f, line, col) for f, line, col, p in places}


def test_phases_of_runs(spark):
    way = readiness.CUTOVER
    runs = {
        "good": way[:7], "open": way[:3], "failed": (*way[:2], "FAILED"), "again": (*way[:2], "FAILED", *way[:7]), "skips": (way[0], way[3]), "twice": (way[0], way[0], way[1]),
        "back": (*way[:4], way[1]), "after": (*way[:7], way[0]), "odd": ("DRAIN", "NAP"), "late": ("COMPLETE",),
    }
    log = spark.createDataFrame([(r, i, p) for r, ps in runs.items() for i, p in enumerate(ps)], "run_id string, started int, phase string")
    got = {r.run_id: r for r in readiness.judged_runs(log, readiness.cutover_steps()).collect()}
    odd = {n: {k: got[n][k] for k in ("failed", "restarted", "repeated", "rolled_back", "skipped", "illegal") if got[n][k]} for n in runs}
    assert odd == {"good": {}, "open": {}, "failed": {"failed": 1}, "again": {"failed": 1, "restarted": 1}, "skips": {"skipped": 1}, "twice": {"repeated": 1}, "back": {"rolled_back": 1}, "after": {"illegal": 1}, "odd": {"illegal": 1}, "late": {"skipped": 1}}
    assert {n: r.state for n, r in got.items()} == {"good": "complete", "open": "open", "failed": "failed", "again": "complete", "skips": "open", "twice": "open", "back": "open", "after": "open", "odd": "open", "late": "complete"}
    assert {n for n, r in got.items() if r.clean} == {"good", "open"}


def test_parity_by_hash_trees(spark):
    rng = random.Random(1)
    base = [(k, f"v{k % 17}", None if k % 11 == 0 else k * 1.5) for k in [*range(-700, 5000), 2**40, 2**40 + 1, -(2**50)]] + [(None, "n", 1.0), (7, "twice", 0.0)]
    other = [r for r in base if r[0] is None or r[0] % 997 != 5] + [(10**9, "new", 2.0), (7, "thrice", 0.0)]
    other = [(k, "" if k == 40 else v, 0.0 if k == 44 else x) for k, v, x in other]
    rng.shuffle(other)
    kind = "k long, v string, x double"
    a, b = spark.createDataFrame(base, kind), spark.createDataFrame(other, kind).repartition(3)
    want = {(k, "missing") for k, _, _ in base if k is not None and k % 997 == 5} | {(10**9, "extra"), (7, "changed"), (40, "changed"), (44, "changed")}
    for sizes in ({}, {"leaf_bits": 3, "fan_bits": 2, "levels": 6}, {"levels": 1}):
        assert rows(ledger.parity_differences(a, b, "k", ["v", "x"], **sizes)) == want
    assert ledger.parity_differences(a, a, "k", ["v", "x"]).count() == 0
    assert rows(ledger.parity_differences(a.filter("k = 3"), a.filter("k = 4"), "k", ["v", "x"])) == {(3, "missing"), (4, "extra")}
    assert ledger.parity_differences(a.limit(0), b.limit(0), "k", ["v"]).count() == 0


def test_a_keyed_table_takes_batches_once(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "k", "k long, v string", parts=8)
    assert t.read().count() == 0
    log = lambda *changes: spark.createDataFrame([(i, op, k, v) for i, (op, k, v) in enumerate(changes)], "id int, op string, k long, v string")
    one = log(*(("I", k, f"a{k}") for k in range(40)), ("U", 3, "b3"), ("D", 4, None))
    two = log(("U", 3, "c3"), ("D", 5, None), ("I", 100, "z"), ("I", None, "n"))
    assert t.merge(one, 1) == 8
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    assert t.merge(two, 2) < 8
    kept = [p for p in before if p.exists()]
    assert kept and all(before[p] == p.stat().st_mtime_ns for p in kept)  # folders that no key is in are not written
    want = {(k, f"a{k}") for k in range(40) if k not in (3, 4, 5)} | {(3, "c3"), (100, "z"), (None, "n")}
    assert rows(t.read()) == want
    t.merge(two, 2)
    t.merge(one, 1)  # an old batch again: later ones stand
    assert rows(t.read()) == want and t.merge(log(), 3) == 0
    t.merge(log(("D", None, None), ("I", 5, "back")), 4)
    assert rows(t.read()) == (want - {(None, "n")}) | {(5, "back")}


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "k", "k long, v string", parts=4)
    t.merge(spark.createDataFrame([("I", k, "a") for k in range(20)], "op string, k long, v string"), 1)
    want = rows(t.read())
    broken = spark.range(20).select(F.lit("U").alias("op"), F.col("id").alias("k"), F.when(F.col("id") < 19, "b").otherwise(F.raise_error(F.lit("no"))).alias("v"))
    with pytest.raises(Exception, match="no"):
        t.merge(broken, 2)
    assert rows(t.read()) == want
    t.merge(broken.withColumn("v", F.lit("b")), 2)
    assert {v for _, v in rows(t.read())} == {"b"}


def test_key_graphs(spark):
    kind = "child string, child_columns array<string>, parent string, parent_columns array<string>"
    keys = spark.createDataFrame(
        [
            ("orders", ["user_id"], "users", ["id"]), ("lines", ["order_id", "tenant"], "orders", ["id", "tenant"]), ("notes", ["author"], "users", ["id"]), ("refunds", ["line"], "lines", ["id"]),
            ("a", ["b_id"], "b", ["id"]), ("b", ["c_id"], "c", ["id"]), ("c", ["a_id"], "a", ["id"]), ("d", ["a_id"], "a", ["id"]), ("staff", ["boss"], "staff", ["id"]), ("c", ["u"], "users", ["id"]),
        ], kind,
    )
    groups = {}
    for table, column, group in rows(key_graph.alike(keys), "table_name", "column_name", "mask_group"):
        groups.setdefault(group, set()).add(f"{table}.{column}")
    assert groups == {min(g): g for g in (
        {"orders.user_id", "users.id", "notes.author", "c.u"}, {"lines.order_id", "orders.id"}, {"lines.tenant", "orders.tenant"}, {"refunds.line", "lines.id"}, {"a.b_id", "b.id"}, {"b.c_id", "c.id"},
        {"c.a_id", "a.id", "d.a_id"}, {"staff.boss", "staff.id"},
    )}
    tables, deferred = key_graph.layers(keys)
    assert rows(deferred) == {("a", "b"), ("b", "c"), ("c", "a"), ("staff", "staff")}
    assert rows(tables) == {("users", 0), ("orders", 1), ("lines", 2), ("notes", 1), ("refunds", 3), ("a", 0), ("b", 0), ("c", 1), ("d", 1), ("staff", 0)}


def test_types_of_tokens(spark):
    text = "ALTER table \"T\" add C numeric(1.5) -- x\n DEFAULT 'a' || $$b$$ <> é_1::text; /* y */ [1]"
    got = [(r.token, r.type) for r in statements.tokens(spark.createDataFrame([("f", text)], "file string, text string")).orderBy("pos").collect()]
    K, I, P, O, N = "KEYWORD", "IDENTIFIER", "PUNCTUATION", "OPERATOR", "NUMBER"  # noqa: E741
    assert got == [
        ("ALTER", K), ("table", K), ('"T"', I), ("add", K), ("C", I), ("numeric", I), ("(", P), ("1.5", N), (")", P), ("-- x", "COMMENT"), ("DEFAULT", K), ("'a'", "STRING"), ("|", O), ("|", O),
        ("$$b$$", "DOLLAR_STRING"), ("<>", O), ("é_1", I), ("::", O), ("text", I), (";", P), ("/* y */", "COMMENT"), ("[", P), ("1", N), ("]", P),
    ]


def test_ranges_open_to_a_side(spark):
    bounds = spark.sql("SELECT 'old' AS part, CAST(NULL AS timestamp_ntz) AS low, timestamp_ntz'2020-01-01' AS high UNION ALL SELECT 'new', timestamp_ntz'2021-05-05 12:00:00', NULL UNION ALL SELECT 'all_of_2020', timestamp_ntz'2020-01-01', timestamp_ntz'2021-01-01'")
    days = ["2019-06-01", "2019-12-31 23:59:59.999999", "2020-01-01", "2021-01-01", "2021-05-05 11:59:59", "2021-05-05 12:00:00", "2031-01-01", None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d string").select("i", F.col("d").cast("timestamp_ntz").alias("d"), F.create_map(F.lit("k"), F.col("i")).alias("m"), F.lit("x").alias("part"))
    from schemaloom.operators import partitions

    got = partitions.route_ranges(df, "d", bounds)
    assert {r.i: r.part for r in got.collect()} == dict(enumerate(["old", "old", "all_of_2020", "default", "default", "new", "new", "default"])) and set(got.columns) == {"i", "d", "m", "part"}
    everything = spark.sql("SELECT 'p' AS part, CAST(NULL AS timestamp_ntz) AS low, CAST(NULL AS timestamp_ntz) AS high")
    assert {r.part for r in partitions.route_ranges(df.filter("i < 7"), "d", everything).collect()} == {"p"}
    assert partitions.route_ranges(df.limit(0), "d", bounds).count() == 0


def test_migrations_are_those_of_the_first_layout(spark):
    from schemaloom.sources import scripts

    def found(files, named=False, root="/work/app"):
        df = spark.createDataFrame([(f"file:{f}", "SELECT 1") for f in files], "file string, text string")
        return [(r.n, r.name, r.project_type) for r in scripts.discovered(df, root, named).orderBy("n").collect()]

    flat, tool = ["/work/app/migrations/b.sql", "/work/app/migrations/a.sql"], ["/work/app/drizzle/0001_x.sql"]
    both = ["/work/app/migrations/2_z/migration.sql", "/work/app/migrations/1_y/migration.sql"]
    first = ["/work/app/prisma/migrations/9_q/migration.sql", "/work/app/prisma/migrations/9_q/other.sql"]
    assert found(flat) == [(1, "a.sql", "generic"), (2, "b.sql", "generic")]
    assert found(flat + both) == [(1, "1_y", "prisma"), (2, "2_z", "prisma")]
    assert found(flat + both + tool) == [(1, "0001_x.sql", "drizzle")]
    assert found(flat + both + tool + first) == [(1, "9_q", "prisma")]
    assert found(["/work/app/sql/deep/x.sql"]) == [] and found([]) == []
    assert found(["/work/app/sql/deep/x.sql"], True) == [(1, "x.sql", "generic")]
    assert found(["/work/app/x.sql", "/work/app/deep/y.sql"], True) == [(1, "x.sql", "drizzle")]
    assert found(["/work/app/x.sql", "/work/app/k/migration.sql"], True) == [(1, "k", "prisma")]


def test_remedy_of_attached_partitions(spark):
    s = stmts(spark, "ALTER TABLE p ATTACH PARTITION s.q FOR VALUES FROM (1) TO (f(2))")
    for r in lint.remedy_sql(lint.findings(s), s).collect():
        lines = r.fix_sql.split("\n")
        assert lines[0].startswith("ALTER TABLE s . q ADD CONSTRAINT b_") and lines[0].endswith("NOT VALID;") and "VALIDATE" in lines[1] and "ATTACH PARTITION s . q FOR VALUES FROM ( 1 ) TO ( f ( 2 ) );" in lines[2] and "DROP CONSTRAINT" in lines[3]
