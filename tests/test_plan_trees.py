import json

from schemaloom.operators import plan_trees


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, plan string")


def node(kind, cost=None, plans=(), **more):
    return {"Node Type": kind, **({} if cost is None else {"Total Cost": cost}), **({"Plans": list(plans)} if plans else {}), **more}


def plain(n, path="0", parent=None):
    children = n.get("Plans", [])
    own = n.get("Total Cost", 0) - sum(c.get("Total Cost", 0) for c in children)
    yield path, parent, n["Node Type"], n.get("Index Name"), n.get("Total Cost"), own
    for i, c in enumerate(children):
        yield from plain(c, f"{path}.{i}", path)


def test_trees_equal_a_recursive_walk(spark):
    deep = node("Leaf", 1.5, **{"Index Name": "ix.a+"})
    for i in range(12):
        deep = node(f"N{i}", 3.0 + i, [deep, node("Other", 0.25, Filter='"Plans": "Index Name" : "ix_b"')])
    wide = node("Append", 100, [node("Seq Scan", k, **{"Index Name": f"i{k}"}) for k in range(20)])
    trees = [deep, wide, node("Lone")]
    got = {(r.id, r.path, r.parent, r.node_type, r.index_name, r.total_cost, r.own_cost) for r in plan_trees.nodes(frame(spark, json.dumps([{"Plan": deep}]), json.dumps({"Plan": wide}), json.dumps(trees[2]))).collect()}
    assert got == {(i, *x) for i, t in enumerate(trees) for x in plain(t)}


def test_what_is_no_plan_has_no_nodes(spark):
    assert plan_trees.nodes(frame(spark, None, "", "{oops", "[]", "3", '"text"', "null", "[1]")).collect() == []


def test_an_index_counts_only_as_a_node(spark):
    used = json.dumps([{"Plan": node("Limit", 1, [node("Index Scan", 1, **{"Index Name": "i.x"})])}])
    text = json.dumps([{"Plan": node("Seq Scan", 2, Filter='"Index Name": "i.x"')}])
    like = used.replace("i.x", "i_x")
    rows = frame(spark, used, text, like, "oops", None).select("id", plan_trees.uses_index(plan_trees.F.col("plan"), "i.x").alias("u"), plan_trees.total_cost(plan_trees.F.col("plan")).alias("c")).orderBy("id").collect()
    assert [(r.u, r.c) for r in rows] == [(True, 1.0), (False, 2.0), (False, 1.0), (False, 0.0), (False, 0.0)]
