"""Query plans as EXPLAIN gives them in JSON, walked to one row for each node.

A text is parsed once to a variant. The walk goes level by level inside one projection: an aggregate whose state is the nodes seen and
those of the next level, for as many steps as the text can have levels. Nothing is shuffled, and names inside of filters and other
texts are never taken for nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NODE = "struct<path: array<int>, node: variant>"


def _get(node: Column, field: str, kind: str) -> Column:
    return F.try_variant_get(node, f"$['{field}']", kind)


def _children(node: Column) -> Column:
    return F.coalesce(_get(node, "Plans", "array<variant>"), F.array().cast("array<variant>"))


def root(plan: Column) -> Column:
    """The top node of a plan: of an array of one plan, of an object with a plan, or the object itself; null if it is no JSON object."""
    v = F.try_parse_json(plan)
    found = F.coalesce(F.try_variant_get(v, "$[0].Plan", "variant"), F.try_variant_get(v, "$.Plan", "variant"), v)
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


def walked(plan: Column) -> Column:
    """All nodes of a plan as (path, node), top first. ``path`` has the number of each node on the way among its parent's children."""
    top = root(plan)
    none = F.array().cast(f"array<{_NODE}>")
    start = F.when(top.isNotNull(), F.array(F.struct(F.array().cast("array<int>").alias("path"), top.alias("node")))).otherwise(none)

    def below(n: Column) -> Column:
        return F.transform(_children(n["node"]), lambda child, i: F.struct(F.concat(n["path"], F.array(i)).alias("path"), child.alias("node")))

    levels = F.sequence(F.lit(0), F.coalesce(F.regexp_count(plan, F.lit('"Plans"')), F.lit(0)))  # a level below the top needs such a word
    step = lambda s, _: F.struct(F.concat(s["seen"], s["ahead"]).alias("seen"), F.flatten(F.transform(s["ahead"], below)).alias("ahead"))
    return F.aggregate(levels, F.struct(none.alias("seen"), start.alias("ahead")), step, lambda s: s["seen"])


def nodes(plans: DataFrame, column: str = "plan") -> DataFrame:
    """A row for each node, in place of the plan: path, parent (null at the top), level, node_type, relation, index_name, plan_rows,
    total_cost and own_cost, which is the total without that of the children. Plans that are no JSON objects have no rows."""
    kept = [c for c in plans.columns if c != column]
    n, path = F.col("__n.node"), F.col("__n.path")
    cost = lambda x: F.coalesce(_get(x, "Total Cost", "double"), F.lit(0.0))
    below = F.aggregate(_children(n), F.lit(0.0), lambda total, child: total + cost(child))
    dotted = lambda p: F.array_join(F.concat(F.array(F.lit("0")), p.cast("array<string>")), ".")
    return plans.select(*kept, F.explode(walked(F.col(column))).alias("__n")).select(
        *kept, dotted(path).alias("path"), F.when(F.size(path) > 0, dotted(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))))).alias("parent"), F.size(path).alias("level"),
        _get(n, "Node Type", "string").alias("node_type"), _get(n, "Relation Name", "string").alias("relation"), _get(n, "Index Name", "string").alias("index_name"),
        _get(n, "Plan Rows", "double").alias("plan_rows"), _get(n, "Total Cost", "double").alias("total_cost"), (cost(n) - below).alias("own_cost"),
    )


def uses_index(plan: Column, index: Column | str) -> Column:
    """Whether a node of the plan reads that index."""
    name = F.lit(index) if isinstance(index, str) else index
    return F.exists(walked(plan), lambda n: F.coalesce(_get(n["node"], "Index Name", "string") == name, F.lit(False)))


def total_cost(plan: Column) -> Column:
    """The cost of the top node, 0 where it says none."""
    return F.coalesce(_get(root(plan), "Total Cost", "double"), F.lit(0.0))
