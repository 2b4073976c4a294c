"""What the review of round three found."""

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from schemaloom.llm import packing, text
from schemaloom.operators import lint, objects, statements


def stmts(spark, *texts):
    return statements.statements(spark.createDataFrame(list(enumerate(texts, 1)), "file long, text string"))


def test_indexes_by_their_own_statements_or_with_dropped_columns(spark):
    s = stmts(spark, "CREATE INDEX i ON t (c); CREATE INDEX k ON t (d); ALTER TABLE t DROP COLUMN c;")
    assert sorted(r.index_name for r in objects.ddl_indexes(s, cascades=False).collect()) == ["i", "k"]
    assert [r.index_name for r in objects.ddl_indexes(s).collect()] == ["k"]


def test_findings_take_one_shuffle_and_broadcast_nothing(spark):
    found = lint.findings(stmts(spark, "CREATE INDEX i ON t (c);"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Broadcast" not in plan


def test_statements_of_one_shape_keep_their_own_numbers_and_places():
    for script in ("CREATE TABLE t_1 (a int, b numeric(10, 2));\n-- 7\nCREATE TABLE t_222 (a int,\n b numeric(3, 14));", "SELECT 'a;%s',\n 1.25;;SELECT '';SELECT $x$ 1; $x$ 22;"):
        found = statements.cut(script)
        for stmt, line, col, end_line, end_col, low, high, raw, *_, items in found:
            own = script[low:high]
            assert "".join(raw.split()) == "".join(own.split())
            assert (line, col) == (script.count("\n", 0, low) + 1, low - script.rfind("\n", 0, low)) and (end_line, end_col) == (script.count("\n", 0, high) + 1, high - script.rfind("\n", 0, high))
            assert all("".join(i[0].split()) == "".join(script[i[2] : i[3]].split()) for i in items)
    assert [r[7] for r in statements.cut("a 1;b 22;a 333;' ;\\")] == ["a 1", "b 22", "a 333", "'", "\\"]


def test_sketches_are_the_smallest_hashes_of_each_text():
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, m, n)) for n, m in ((0, 1), (1, 1), (5, 3), (300, 5), (400, 300), (5000, 9), (3000, 10**6))]
    plain = [sorted({int(text.hash_words(pa.array([w], pa.large_string()))[0]) for w in t.split()})[:8] for t in texts]
    assert packing.sketches(pa.array(texts, pa.large_string()), 8).tolist() == [p + [2**64 - 1] * (8 - len(p)) for p in plain]


def test_words_and_keys_are_counted_over_all_documents(spark):
    # in long documents alone, which a sample of short ones or of some left out
    texts = [f"a{i} " * 3 for i in range(600)] + ["are " + " ".join(f"x{i}y{j}" for j in range(3)) for i in range(30)]
    frequent, size = packing.frequent_words(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), packing.PackParams())
    assert size == 630 and frequent.tolist() == text.hash_words(pa.array(["are"], pa.large_string())).tolist()


def test_statements_that_match_keep_their_numbers_and_scopes(spark):
    texts = ["BEGIN; CREATE TYPE e AS ENUM ('a'); COMMIT; -- x\nSELECT 1; ALTER TYPE e ADD VALUE 'b 1';", "DROP TYPE \"x\ny\";"]
    scripts = spark.createDataFrame(list(enumerate(texts)), "file int, text string")
    every = statements.statements(scripts)
    some = statements.statements(scripts, objects.said_by("enum"))
    assert some.collect() == every.filter("norm LIKE '%TYPE%'").collect() and some.count() == 3
    assert set(statements.statements(scripts, columns=objects.READ).columns) == {"file", *objects.READ}


def test_objects_of_one_kind_are_those_of_the_whole_graph_by_one_shuffle(spark):
    s = stmts(
        spark, "CREATE TABLE t (id int PRIMARY KEY, a text CHECK (a <> '') UNIQUE, UNIQUE (a)); CREATE INDEX i ON t (a); ALTER TABLE t ADD c int REFERENCES u (id), ALTER a SET NOT NULL; CREATE TYPE e AS ENUM ('x')",
        "CREATE TABLE t (a int); ALTER TABLE t ADD CHECK (a > 0), ADD PRIMARY KEY (a); CREATE INDEX i ON t (a); ALTER TABLE t DROP a; DROP TABLE t; ALTER TABLE t ADD b int; ALTER TYPE e ADD VALUE 'y'; ALTER TABLE t ATTACH PARTITION p DEFAULT",
    )
    whole = objects.graph(s)
    for kind in ("table", "column", "constraint", "index", "enum", "partition"):
        own = objects.graph(s, kinds=(kind,)).filter(f"kind = '{kind}'")
        assert sorted(map(repr, own.collect())) == sorted(map(repr, whole.filter(f"kind = '{kind}'").collect()))
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_a_column_named_type_keeps_its_type(spark):
    (c,) = objects.ddl_columns(stmts(spark, "CREATE TABLE t (type int); ALTER TABLE t ALTER COLUMN type SET NOT NULL")).collect()
    assert (c.column_name, c.data_type, c.is_not_null) == ("type", "integer", True)


def test_rules_on_one_statement_take_no_shuffle_and_cut_scripts_once(spark):
    texts = ("ALTER TABLE t ADD CHECK (a > 0), ADD CHECK (b > 0), ADD FOREIGN KEY (a) REFERENCES u (id), DROP COLUMN c; SELECT pg_advisory_lock(1), pg_advisory_lock(2)", "CREATE INDEX i ON t (c); UPDATE t SET a = 1; DELETE FROM t WHERE a = 'x'; REINDEX TABLE t")
    s = stmts(spark, *texts)
    rules = {"check-constraint-missing-not-valid", "foreign-key-missing-not-valid", "drop-column-lock", "session-advisory-lock", "require-concurrent-index", "unbatched-dml", "reindex-missing-concurrently"}
    whole = lint.findings(s).filter(F.col("rule_id").isin(*rules))
    scripts = spark.createDataFrame(list(enumerate(texts, 1)), "file long, text string")
    found = lint.fixes(statements.statements(scripts, lint.concerns(rules)), rules)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, lint.remedy_sql(whole, s).collect())) and found.count() == 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
    twin = lint.findings(s, {"check-constraint-not-valid"})
    assert [(r.stmt, r.rule_id) for r in twin.collect()] == [(0, "check-constraint-not-valid")] * 2 and "Exchange" not in twin._jdf.queryExecution().executedPlan().toString()
    assert lint.concerns({"lock-accumulation-mixed-ddl-dml", "unbatched-dml"}) is None


def test_toxicity_counts_stay_at_their_highest_and_take_few_bytes():
    import tracemalloc

    from schemaloom.llm import toxicity

    texts, labels = [f"bad w{i}" if i % 2 else f"good w{i}" for i in range(600)], np.arange(600) % 2.0
    tracemalloc.start()
    index, w = toxicity._fit_shard(texts, labels, toxicity.FtrlParams())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # the table of counts alone took 64 MB
    wide, wide_w = toxicity._fit_shard(texts, labels, toxicity.FtrlParams(min_documents=256))  # met 300 times
    assert set(wide) <= set(index) and len(wide) >= 2
