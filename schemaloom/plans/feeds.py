"""Inputs of the analyses, derived from the business tables: every row takes part, nothing is drawn at random.

Each feed has a DuckDB text of the same shape, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One monitored table per part brand: reads, writes and in-page updates of its order lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("table_name")).agg(
        F.count("*").alias("reads"), F.count_if(F.col("l_returnflag") == "R").alias("writes"),
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("hot"),
        F.count_if(F.col("l_quantity") > 25).alias("seq_scans"), F.sum("p_size").cast("bigint").alias("width_sum"),
    )


TABLE_STATS = """
SELECT p_brand AS table_name, count(*) AS reads, count(*) FILTER (WHERE l_returnflag = 'R') AS writes,
       count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS hot,
       count(*) FILTER (WHERE l_quantity > 25) AS seq_scans, CAST(sum(p_size) AS BIGINT) AS width_sum
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"""


def wait_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who waits for whom: an order's session waits for the one that has its part's number, for each line of more than 34 pieces."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 35 AND l_orderkey <> l_partkey")
    return lines.select(F.col("l_orderkey").alias("waiter"), F.col("l_partkey").alias("blocker")).distinct()


WAIT_EDGES = "SELECT DISTINCT l_orderkey AS waiter, l_partkey AS blocker FROM lineitem WHERE l_quantity >= 35 AND l_orderkey <> l_partkey"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of distributed migrations: one run per customer, five nodes, the phase from the order's status."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("run_id"), (F.col("o_orderkey") % 5).alias("node_id"), F.col("o_orderdate").alias("prepared_at"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") == "F", "COMMITTED").when(F.col("o_orderstatus") == "O", "PREPARED").otherwise("ABORTED").alias("phase"),
    )


LEDGER = """
SELECT o_custkey AS run_id, o_orderkey % 5 AS node_id, o_orderdate AS prepared_at, o_orderkey AS seq,
       CASE o_orderstatus WHEN 'F' THEN 'COMMITTED' WHEN 'O' THEN 'PREPARED' ELSE 'ABORTED' END AS phase FROM orders"""

LATEST_LEDGER = f"SELECT * FROM ({LEDGER}) QUALIFY row_number() OVER (PARTITION BY run_id, node_id ORDER BY prepared_at DESC, seq DESC) = 1"


def indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index per part; its table is the part's type, its key columns grow with the part's size."""
    p = table(spark, sf_dir, "part")
    names = F.array(F.col("p_brand"), F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1)), F.concat(F.lit("c"), F.col("p_size").cast("string")))
    return p.select(
        F.lit("public").alias("schema_name"), F.col("p_type").alias("table_name"), F.concat(F.lit("ix_"), F.col("p_partkey").cast("string")).alias("index_name"),
        F.col("p_partkey").alias("ord"), F.slice(names, 1, (F.col("p_size") % 4 + 1).cast("int")).alias("key_columns"),
        F.when(F.col("p_size") % 7 == 0, "active").alias("predicate"), (F.col("p_size") % 11 == 0).alias("is_unique"), F.lit(False).alias("is_primary"),
        (F.col("p_size") % 13 != 0).alias("is_valid"), (F.col("p_size") % 3 == 0).alias("is_fk_backing"),
        (F.col("p_size") % 5).cast("bigint").alias("scans"), F.floor(F.col("p_retailprice") * 100).cast("bigint").alias("size_bytes"),
    )


INDEXES = """
SELECT 'public' AS schema_name, p_type AS table_name, 'ix_' || p_partkey AS index_name, p_partkey AS ord,
       list_slice([p_brand, split_part(p_name, ' ', 2), split_part(p_name, ' ', 1), 'c' || p_size], 1, p_size % 4 + 1) AS key_columns,
       CASE WHEN p_size % 7 = 0 THEN 'active' END AS predicate, p_size % 11 = 0 AS is_unique, p_size % 13 <> 0 AS is_valid, p_size % 3 = 0 AS is_fk_backing,
       CAST(p_size % 5 AS BIGINT) AS scans, CAST(floor(p_retailprice * 100) AS BIGINT) AS size_bytes FROM part"""


def tenant_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of tenant schemas: a tenant per customer group, a column per market segment that it serves, and one that is left over in every tenth."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        (F.col("c_custkey") % 97).alias("tenant"), F.lit("accounts").alias("table_name"), F.concat(F.col("c_mktsegment"), F.lit("_"), (F.col("c_nationkey") % 2).cast("string")).alias("column_name"),
        F.when(F.col("c_nationkey") % 2 == 0, "text").otherwise("bigint").alias("data_type"),
    ).union(
        c.filter("c_custkey % 97 % 10 = 3").select((F.col("c_custkey") % 97).alias("tenant"), F.lit("accounts"), F.concat(F.lit("legacy_"), (F.col("c_custkey") % 97 % 4).cast("string")), F.lit("text"))
    ).distinct()


TENANT_OBJECTS = """
SELECT DISTINCT c_custkey % 97 AS tenant, 'accounts' AS table_name, c_mktsegment || '_' || (c_nationkey % 2) AS column_name,
       CASE WHEN c_nationkey % 2 = 0 THEN 'text' ELSE 'bigint' END AS data_type FROM customer
UNION SELECT c_custkey % 97, 'accounts', 'legacy_' || (c_custkey % 97 % 4), 'text' FROM customer WHERE c_custkey % 97 % 10 = 3"""

_PLAN = (
    r'[{"Plan":{"Node Type":"Limit","Plan Rows":1,"Total Cost":', "top", r',"Plans":[{"Node Type":"Hash Join","Total Cost":', "join",
    r',"Plans":[{"Node Type":"Seq Scan","Relation Name":"lineitem","Plan Rows":', "rows", r',"Total Cost":', "scan", r',"Filter":"(note = \"Index Name\" : \"ix_0\")"},{"Node Type":"Index Scan","Relation Name":"part","Index Name":',
    "index", r',"Total Cost":', "probe", r"}]}]}}]",
)


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of a query per order, as EXPLAIN prints it: three levels, an index by the customer, costs by price."""
    o = table(spark, sf_dir, "orders")
    values = {
        "top": F.col("o_orderkey") % 50 + 9000, "join": F.col("o_orderkey") % 50 + 8000.5, "rows": F.col("o_orderkey"), "scan": F.col("o_custkey") % 100 + 0.25,
        "index": F.concat(F.lit('"ix_'), (F.col("o_custkey") % 40).cast("string"), F.lit('"')), "probe": F.col("o_orderkey") % 7 + 0.5,
    }
    return o.select(F.col("o_orderkey").alias("plan_id"), F.concat(*(values[x].cast("string") if x in values else F.lit(x) for x in _PLAN)).alias("plan"))


_PLAN_SQL = {
    "top": "o_orderkey % 50 + 9000", "join": "(o_orderkey % 50)::DOUBLE + 8000.5::DOUBLE", "rows": "o_orderkey", "scan": "(o_custkey % 100)::DOUBLE + 0.25::DOUBLE", "index": "'\"ix_' || o_custkey % 40 || '\"'", "probe": "(o_orderkey % 7)::DOUBLE + 0.5::DOUBLE",
}
PLANS = "SELECT o_orderkey AS plan_id, " + " || ".join(f"({_PLAN_SQL[x]})::VARCHAR" if x in _PLAN_SQL else f"'{x}'" for x in _PLAN) + " AS plan FROM orders"

#: Statements of the generated scripts, by kind; {t}, {c} and {n} are filled in. Begin and commit are kinds too.
TEMPLATES = (
    "CREATE INDEX ix_{n} ON t_{t} (c_{c})", "CREATE INDEX CONCURRENTLY ix_{n} ON t_{t} (c_{c})", "ALTER TABLE t_{t} ADD COLUMN c_{c} integer NOT NULL",
    "ALTER TABLE t_{t} ADD COLUMN c_{c} integer NOT NULL DEFAULT 0", "ALTER TABLE t_{t} ADD CONSTRAINT f_{n} FOREIGN KEY (c_{c}) REFERENCES t_0 (id)",
    "ALTER TABLE t_{t} ADD CONSTRAINT f_{n} FOREIGN KEY (c_{c}) REFERENCES t_0 (id) NOT VALID", "ALTER TABLE t_{t} ALTER COLUMN c_{c} SET NOT NULL",
    "UPDATE t_{t} SET c_{c} = 0", "DELETE FROM t_{t} WHERE c_{c} = ''x;y''", "ALTER TABLE t_{t} ADD CHECK (c_{c} > 0)", "ALTER TABLE t_{t} ADD UNIQUE (c_{c}, d)",
    "SELECT pg_advisory_lock({n})", "ALTER TABLE t_{t} DROP COLUMN c_{c}", "ALTER TABLE t_{t} ADD PRIMARY KEY (c_{c})", "ALTER TABLE t_{t} DETACH PARTITION p_{n}",
    "REINDEX TABLE t_{t}", "VACUUM t_{t}", "ALTER TABLE t_{t} ADD COLUMN u_{c} timestamp DEFAULT now()", "DROP INDEX ix_{n}", "DROP INDEX CONCURRENTLY ix_{n}",
    "ALTER TABLE t_{t} ATTACH PARTITION p_{n} FOR VALUES IN (1)", "TRUNCATE t_{t}", "BEGIN", "COMMIT", "SELECT 1 /* ; */", "CREATE TABLE t_{t}_new (id bigint)",
    "ALTER TABLE t_{t} ALTER COLUMN c_{c} TYPE bigint", "ALTER TYPE e_{t} ADD VALUE ''v_{n}''", "ALTER TABLE t_{t} ALTER COLUMN c_{c} RESTART WITH 1", "ALTER TABLE t_{t} ADD PRIMARY KEY USING INDEX pk_{n}",
    "CREATE TYPE e_{t} AS ENUM (''a'', ''b'')", "DROP TYPE e_{t}", "ALTER TABLE t_{t} ALTER COLUMN c_{c} TYPE e_{t} USING c_{c}::text::e_{t}", "ALTER TABLE t_{t} VALIDATE CONSTRAINT f_{n}",
    "DO $x$ BEGIN DELETE FROM a; END $x$",
)


def scripts(spark: SparkSession, sf_dir: str, templates: tuple[str, ...] = TEMPLATES) -> DataFrame:
    """A migration script per order, a statement per line, its kind from part and supplier."""
    lines = table(spark, sf_dir, "lineitem")
    kind = (F.col("l_partkey") * 7 + F.col("l_suppkey") + F.col("l_linenumber")) % len(templates)
    text = F.element_at(F.array(*(F.lit(t.replace("''", "'")) for t in templates)), (kind + 1).cast("int"))
    for mark, value in (("{t}", F.col("l_suppkey") % 3), ("{c}", F.col("l_partkey") % 4), ("{n}", F.col("l_partkey"))):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.concat(F.lit("-- step\n"), text, F.lit(";\n")).alias("text"))
    return lines.groupBy(F.col("l_orderkey").alias("file")).agg(F.array_join(F.sort_array(F.collect_list(line))["text"], "").alias("text"))


#: Statements about objects, with brackets in brackets, commas in strings and quoted names.
OBJECT_TEMPLATES = (
    "CREATE TABLE t_{t} (id bigint PRIMARY KEY, a numeric(10, 2) DEFAULT coalesce({n}, lower(''x , y'')) NOT NULL, \"B {c}\" text CHECK (\"B {c}\" IN (''p'', lower(''q''))), CHECK (a IN (1, (2))))",
    "CREATE INDEX ix_{n} ON t_{t} (coalesce(a, lower(a)), id) WHERE a IN (1, (2))", "ALTER TABLE t_{t} ADD COLUMN c_{c} varchar(20) DEFAULT ''x , y'' NOT NULL, DROP COLUMN a",
    "ALTER TABLE t_{t} ADD CONSTRAINT k_{c} CHECK (id > (0 + (1)))", "DROP TABLE IF EXISTS T_{t}", "ALTER TABLE t_{t} DROP COLUMN IF EXISTS c_{c}", "CREATE UNIQUE INDEX CONCURRENTLY ux_{n} ON ONLY t_{t} USING btree (c_{c})",
    "ALTER TABLE t_{t} ALTER COLUMN a TYPE int8 USING round(a, (0)), ALTER id SET DEFAULT f(1, (2))", "DROP INDEX ix_{n}", "ALTER TABLE ONLY t_{t} DROP CONSTRAINT K_{c}", "ALTER TABLE t_{t} ADD UNIQUE (id, a)",
    "ALTER TABLE t_{t} ADD c_{c} integer REFERENCES u (id) ON DELETE SET NULL", "ALTER TABLE t_{t} ATTACH PARTITION p_{n} FOR VALUES FROM (1) TO (f(2, 3))",
)


def statements_of(templates: tuple[str, ...]) -> str:
    """The statements of scripts for DuckDB: file, stmt, kind, t, c, n."""
    return STATEMENTS.replace(f"% {len(TEMPLATES)} AS kind", f"% {len(templates)} AS kind")


#: The statements of the scripts for DuckDB: file, stmt, kind, t, c, n. Each has a comment line before it.
STATEMENTS = f"""
SELECT l_orderkey AS file, (l_partkey * 7 + l_suppkey + l_linenumber) % {len(TEMPLATES)} AS kind, l_suppkey % 3 AS t, l_partkey % 4 AS c, l_partkey AS n,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS stmt FROM lineitem"""


def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A foreign key per supplier and per customer: supplier tables form trees, each fifth of them closes a cycle of three; customers refer to them by two columns."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    name = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    one = lambda child, a, parent, b: (child.alias("child"), F.array(F.lit(a)).alias("child_columns"), parent.alias("parent"), F.array(F.lit(b)).alias("parent_columns"))
    trees = s.filter("k > 1").select(*one(name("s", F.col("k")), "up", name("s", F.shiftright("k", 1)), "id"))
    back = s.filter("k % 5 = 0 AND k > 9").select(*one(name("s", F.shiftright("k", 2)), "back", name("s", F.col("k")), "id"))
    two = c.select(name("c", F.col("k")).alias("child"), F.array(F.lit("nation"), F.lit("owner")).alias("child_columns"), name("s", F.col("n") + 1).alias("parent"), F.array(F.lit("nation"), F.lit("id")).alias("parent_columns"))
    return trees.union(back).union(two)


FOREIGN_KEYS = """
SELECT 's' || s_suppkey AS child, ['up'] AS child_columns, 's' || (s_suppkey >> 1) AS parent, ['id'] AS parent_columns FROM supplier WHERE s_suppkey > 1
UNION ALL SELECT 's' || (s_suppkey >> 2), ['back'], 's' || s_suppkey, ['id'] FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey > 9
UNION ALL SELECT 'c' || c_custkey, ['nation', 'owner'], 's' || (c_nationkey + 1), ['nation', 'id'] FROM customer"""
