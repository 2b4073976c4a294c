"""What scripts leave: clauses at any depth, the order of statements, what goes with a dropped table or column."""

import pytest

from schemaloom.operators import drift, lint, objects, statements


def stmts(spark, *texts):
    return statements.statements(spark.createDataFrame(list(enumerate(texts)), "file int, text string"))


def clauses_of(text):
    return [[(i[0], i[4]) for i in r[-1]] for r in statements.cut(text)]


def test_clauses_know_brackets_and_quotes():
    text = "ALTER TABLE s.t ADD a int DEFAULT 'x , y)', DROP \"b , (c\", ALTER c SET DEFAULT f('(', (1, 2)), ADD CHECK (a IN (1, (2)))"
    (found,) = clauses_of(text)
    assert [c for c, _ in found] == ["ADD a int DEFAULT 'x , y)'", 'DROP "b , (c"', "ALTER c SET DEFAULT f ( '(' , ( 1 , 2 ) )", "ADD CHECK ( a IN ( 1 , ( 2 ) ) )"]
    (found,) = clauses_of("create table if not exists t (a varchar(10) not null default coalesce(null, lower('Q')) constraint k check (a <> ''), b int[] default array[1, 2], like u including all)")
    assert [p for _, p in found] == [
        ["a varchar ( 10 )", "not null", "default coalesce ( null , lower ( 'Q' ) )", "constraint k check ( a <> '' )"], ["b int [ ]", "default array [ 1 , 2 ]"], ["like u including all"],
    ]
    (found,) = clauses_of("ALTER TABLE t ADD x int GENERATED BY DEFAULT AS IDENTITY NOT NULL, ADD y int REFERENCES u (i) ON DELETE SET NULL ON UPDATE SET DEFAULT UNIQUE")
    assert [p for _, p in found] == [["ADD x int", "GENERATED BY DEFAULT AS IDENTITY", "NOT NULL"], ["ADD y int", "REFERENCES u ( i ) ON DELETE SET NULL ON UPDATE SET DEFAULT", "UNIQUE"]]


@pytest.mark.parametrize("text", ["CREATE TABLE t", "CREATE TABLE t (", "CREATE TABLE t ((a, b", "ALTER TABLE", "ALTER TABLE t", "CREATE INDEX", "CREATE INDEX i ON", "CREATE TYPE m AS", "DROP TABLE", "CREATE TABLE p PARTITION OF q FOR VALUES IN (1)", "CREATE TABLE t ()", "ALTER TABLE t ADD ) , b", "CREATE"])
def test_clauses_of_broken_statements(text):
    for found in clauses_of(text):
        assert all(c and p for c, p in found)


def test_spans_of_clauses():
    text = "-- x\nALTER TABLE t ADD  a int /* , */ DEFAULT 1 , DROP b"
    (row,) = statements.cut(text)
    assert [text[i[2] : i[3]] for i in row[-1]] == ["ADD  a int /* , */ DEFAULT 1", "DROP b"]


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_columns_and_constraints_at_depth(spark):
    s = stmts(spark, "CREATE TABLE t (id int, a text CHECK (a IN ('x', lower('y'))), b numeric DEFAULT coalesce(1, abs(2)), PRIMARY KEY (id), c int REFERENCES u (id), e int CONSTRAINT ec UNIQUE, CHECK (b > 0 AND c > 0), CHECK (b < 9 OR c < 9), UNIQUE (a, b))")
    assert rows(objects.ddl_columns(s), "column_name", "data_type", "is_not_null", "default_expr") == {
        ("id", "integer", True, None), ("a", "text", False, None), ("b", "numeric", False, "coalesce ( 1 , abs ( 2 ) )"), ("c", "integer", False, None), ("e", "integer", False, None),
    }
    assert rows(objects.ddl_constraints(s), "constraint_name", "kind", "definition") == {
        ("t_a_check", "c", "CHECK ( a IN ( 'x' , lower ( 'y' ) ) )"), ("t_pkey", "p", "PRIMARY KEY ( id )"), ("t_c_fkey", "f", "FOREIGN KEY ( c ) REFERENCES u ( id )"), ("ec", "u", "UNIQUE ( e )"),
        ("t_check", "c", "CHECK ( b > 0 AND c > 0 )"), ("t_check1", "c", "CHECK ( b < 9 OR c < 9 )"), ("t_a_b_key", "u", "UNIQUE ( a , b )"),
    }


def test_keys_of_indexes_at_depth(spark):
    s = stmts(spark, "CREATE INDEX i ON t (coalesce(a, lower(a)), b) WHERE c IN (1, (2)); CREATE UNIQUE INDEX CONCURRENTLY j ON ONLY s.\"T x\" USING gin (\"q , r\")")
    assert [(r.index_name, r.table_name, r.is_unique, r.is_concurrent, r.key_columns, r.predicate) for r in objects.ddl_indexes(s).orderBy("index_name").collect()] == [
        ("i", "t", False, False, ["coalesce ( a , lower ( a ) )", "b"], "c IN ( 1 , ( 2 ) )"), ("j", "s.T x", True, True, ['"q , r"'], None),
    ]


def test_statements_apply_in_order(spark):
    s = stmts(
        spark,
        "CREATE TABLE t (a int, b int); CREATE INDEX i ON t (a); ALTER TABLE t ADD CONSTRAINT k CHECK (a > 0); DROP TABLE t; CREATE TABLE t (c int)",
        "CREATE TABLE t (a int, b int, CHECK (b > 0)); CREATE INDEX i ON t (lower(a), b); CREATE INDEX j ON t (b) WHERE a > 0; CREATE INDEX k ON t (b); ALTER TABLE t ADD UNIQUE (a), DROP COLUMN a; ALTER TABLE t ADD a text",
        "ALTER TABLE t ALTER a TYPE varchar(5) USING a::text, ALTER b SET NOT NULL; ALTER TABLE t ADD b int DEFAULT 1; ALTER TABLE t ALTER COLUMN b SET NOT NULL, ALTER b DROP DEFAULT; ALTER TABLE t ALTER b DROP NOT NULL, ALTER b SET DEFAULT f(1, 2)",
        "DROP TABLE IF EXISTS u, \"V\" CASCADE; CREATE TABLE u (a int PRIMARY KEY); CREATE TABLE \"V\" (a int); DROP TABLE x, \"V\"; ALTER TABLE u DROP CONSTRAINT u_pkey; ALTER TABLE u ADD PRIMARY KEY USING INDEX ix",
        "ALTER TABLE p ATTACH PARTITION p1 FOR VALUES FROM (1) TO (2), ATTACH PARTITION p2 DEFAULT; ALTER TABLE p DETACH PARTITION p2 CONCURRENTLY; DROP TYPE e; CREATE TYPE e AS ENUM ('b'); ALTER TYPE e ADD VALUE 'c' BEFORE 'b'; ALTER TYPE e ADD VALUE IF NOT EXISTS 'c'; CREATE TYPE f AS ENUM ('x'); DROP TYPE f",
    )
    assert rows(objects.graph(s), "file", "kind", "table_name", "name") == {
        (0, "table", "t", "t"), (0, "column", "t", "c"),
        (1, "table", "t", "t"), (1, "column", "t", "a"), (1, "column", "t", "b"), (1, "constraint", "t", "t_b_check"), (1, "index", "t", "k"),
        (2, "column", "t", "a"), (2, "column", "t", "b"),
        (3, "table", "u", "u"), (3, "column", "u", "a"), (3, "constraint", "u", "ix"),
        (4, "partition", "p", "p1"), (4, "enum", None, "e"),
    }
    assert rows(objects.ddl_columns(s).filter("file = 2"), "column_name", "data_type", "is_not_null", "default_expr") == {("a", "character varying(5)", False, None), ("b", "integer", False, "f ( 1 , 2 )")}
    assert rows(objects.ddl_partitions(s), "partition_name", "bound") == {("p1", "FOR VALUES FROM ( 1 ) TO ( 2 )")}
    assert [r.labels for r in objects.ddl_enums(s).collect()] == [["b", "c"]]


def test_a_graph_of_scripts_against_a_catalog(spark):
    live = stmts(spark, "CREATE TABLE users (id bigint PRIMARY KEY, name varchar(20)); CREATE TABLE legacy (a int)")
    target = stmts(spark, "CREATE TABLE Users (ID int8, name character varying(20) NOT NULL); ALTER TABLE users ADD phone varchar(20) NOT NULL, ADD role text NOT NULL DEFAULT 'm , n', ADD PRIMARY KEY (id)")
    columns = drift.diff_columns(objects.ddl_columns(live).drop("file"), objects.ddl_columns(target).drop("file"))
    assert rows(columns, "table_name", "column_name", "change") == {("users", "phone", "unsafe"), ("users", "role", "missing"), ("users", "name", "changed"), ("legacy", "a", "extra")}
    assert rows(drift.diff_tables(objects.ddl_columns(live), objects.ddl_columns(target)), "table_name", "change") == {("legacy", "extra")}
    assert drift.diff_constraints(objects.ddl_constraints(live), objects.ddl_constraints(target)).count() == 0


def test_rules_see_clauses_at_depth(spark):
    s = stmts(spark, "ALTER TABLE t ADD a int DEFAULT coalesce(f(1, (2)), 3) NOT NULL, ADD b text NOT NULL, ALTER c SET DEFAULT ', ADD d int NOT NULL'; ALTER TABLE t ADD e timestamptz DEFAULT transaction_timestamp()")
    got = rows(lint.findings(s), "rule_id", "snippet")
    assert got == {("add-column-not-null-without-default", "ADD B TEXT NOT NULL"), ("volatile-default", "ADD E TIMESTAMPTZ DEFAULT TRANSACTION_TIMESTAMP ( )")}


def test_no_scripts(spark):
    assert objects.graph(stmts(spark, "", "SELECT 1")).collect() == []
