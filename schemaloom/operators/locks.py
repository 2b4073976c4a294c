"""Lock analyses: wait-for graphs, queues, and how long locks were held."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from schemaloom.functions.session import Rounds

# Lock levels by rank, whether they block reads and writes, and the levels they conflict with.
LOCK_LEVELS = (
    ("NONE", 0, False, False, ()),
    ("ACCESS SHARE", 1, False, False, ("ACCESS EXCLUSIVE",)),
    ("ROW SHARE", 2, False, False, ("EXCLUSIVE", "ACCESS EXCLUSIVE")),
    ("ROW EXCLUSIVE", 3, False, False, ("SHARE", "SHARE ROW EXCLUSIVE", "EXCLUSIVE", "ACCESS EXCLUSIVE")),
    ("SHARE UPDATE EXCLUSIVE", 4, False, False, ("SHARE UPDATE EXCLUSIVE", "SHARE", "SHARE ROW EXCLUSIVE", "EXCLUSIVE", "ACCESS EXCLUSIVE")),
    ("SHARE", 5, False, True, ("ROW EXCLUSIVE", "SHARE UPDATE EXCLUSIVE", "SHARE ROW EXCLUSIVE", "EXCLUSIVE", "ACCESS EXCLUSIVE")),
    ("SHARE ROW EXCLUSIVE", 6, False, True, ("ROW EXCLUSIVE", "SHARE UPDATE EXCLUSIVE", "SHARE", "SHARE ROW EXCLUSIVE", "EXCLUSIVE", "ACCESS EXCLUSIVE")),
    ("EXCLUSIVE", 7, False, True, ("ROW SHARE", "ROW EXCLUSIVE", "SHARE UPDATE EXCLUSIVE", "SHARE", "SHARE ROW EXCLUSIVE", "EXCLUSIVE", "ACCESS EXCLUSIVE")),
    ("ACCESS EXCLUSIVE", 8, True, True, ("ACCESS SHARE", "ROW SHARE", "ROW EXCLUSIVE", "SHARE UPDATE EXCLUSIVE", "SHARE", "SHARE ROW EXCLUSIVE", "EXCLUSIVE", "ACCESS EXCLUSIVE")),
)


def lock_levels(spark) -> DataFrame:
    """The nine levels as a table; conflicts are symmetric, as the server has them."""
    return spark.createDataFrame([(*x[:4], list(x[4])) for x in LOCK_LEVELS], "level string, rank int, blocks_reads boolean, blocks_writes boolean, conflicts array<string>")


def conflicts(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """Rows with ``held`` and ``wanted`` levels, plus whether they conflict."""
    return requests.join(F.broadcast(levels.select(F.col("level").alias("held"), "conflicts")), "held", "left").withColumn(
        "conflict", F.coalesce(F.array_contains("conflicts", F.col("wanted")), F.lit(False))
    ).drop("conflicts")


def root_blockers(edges: DataFrame) -> DataFrame:
    """(pid, n_waiters): who blocks others and waits for nobody."""
    blockers = edges.groupBy(F.col("blocker").alias("pid")).agg(F.count_distinct("waiter").alias("n_waiters"))
    return blockers.join(edges.select(F.col("waiter").alias("pid")).distinct(), "pid", "left_anti")


_HOPS = 6  # edges that are followed before a table is written
_TASK_ROWS = 50_000  # rounds over small tables take a task for so many rows, not all that the session sets


def _dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The frame by ``keys`` in partitions of about _TASK_ROWS; as it is where that would be as many as the session's or more."""
    n = rows // _TASK_ROWS + 1
    return df.repartition(n, *keys) if n < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _spread(edges: DataFrame, labels: DataFrame, tables: Rounds, limit: int) -> DataFrame:
    """(pid, label): the smallest label that reaches each node over edges (source, target). Each round follows several edges, where an edge of a node
    to itself keeps its label, and then takes the label of the node that a label names, where that is a label itself: what reaches the label reaches
    the node, so long ways take few rounds."""
    state = None
    labels = tables.table(labels)
    kept = labels.select("pid").union(edges.select("source")).union(edges.select("target"))
    kept = _dealt(kept, 2 * edges.count() + labels.count(), "pid").distinct()
    ways = tables.table(edges.select("source", "target").union(kept.select("pid", F.col("pid").alias("target"))))
    size = ways.count()
    for _ in range(limit):
        low = labels
        for _ in range(_HOPS):
            step = ways.join(low.select(F.col("pid").alias("source"), "label"), "source").select(F.col("target").alias("pid"), "label")
            low = _dealt(step, size, "pid").groupBy("pid").agg(F.min("label").alias("label"))
        jump = low.join(labels.select(F.col("pid").alias("label"), F.col("label").alias("further")), "label", "left")
        now = tables.table(jump.select("pid", F.least("label", "further").alias("label")))
        tables.drop(labels)
        labels = now
        then = tuple(labels.agg(F.count("*"), F.sum(F.xxhash64("pid", "label").cast("decimal(38,0)"))).first())
        if then == state:
            tables.drop(ways)
            return labels
        state = then
    raise RuntimeError(f"labels still move after {limit} rounds")


def _contracted(edges: DataFrame, tables: Rounds, limit: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """What is left of edges (waiter, blocker) when ends and chains are taken out: (edges, rings, runs).

    Nodes that nobody waits for, or that wait for nobody, go. Nodes with one edge in and one out are links of a chain: each takes the
    node that it leads to, then that node's, and so on, doubling the way each round. A chain becomes one edge, and ``runs`` keeps the links as (pid, before,
    behind); one that closes on itself is a ring (pid, cycle, place, size), told by never leading out.
    """
    now, rings, runs = tables.table(edges), [], []
    count = now.count()
    for _ in range(limit):
        once = now.join(now.select(F.col("waiter").alias("blocker")), "blocker", "left_semi")
        once = once.join(now.select(F.col("blocker").alias("waiter")), "waiter", "left_semi").select("waiter", "blocker")
        twice = once.join(once.select(F.col("waiter").alias("blocker")), "blocker", "left_semi")
        rest = tables.table(twice.join(once.select(F.col("blocker").alias("waiter")), "waiter", "left_semi").select("waiter", "blocker"))
        tables.drop(now)
        now = rest
        sides = now.select(F.col("waiter").alias("pid"), F.col("blocker").alias("next"), F.lit(None).alias("before")).union(now.select("blocker", F.lit(None), "waiter"))
        nodes = _dealt(sides, 2 * count, "pid").groupBy("pid").agg(F.count("next").alias("n_out"), F.min("next").alias("next"), F.count("before").alias("n_in"), F.min("before").alias("before"))
        links = tables.table(nodes.filter("n_out = 1 AND n_in = 1").select("pid", "next", "before"))
        if n_links := links.count():
            # way: where a link's chain leads, both ways; low: the smallest pid on it; open: it ends at a node that is no link
            one = links.select(F.col("pid").alias("to"), F.lit(True).alias("linked"))
            way = links.join(one.withColumnRenamed("to", "next"), "next", "left").select("pid", F.col("next").alias("behind"), (~F.coalesce("linked", F.lit(False))).alias("out_open"), "before")
            way = way.join(one.withColumnRenamed("to", "before"), "before", "left").select("pid", "behind", "out_open", "before", (~F.coalesce("linked", F.lit(False))).alias("in_open"), F.least("pid", "behind").alias("low"))
            way = tables.table(way)
            for _ in range(n_links.bit_length()):
                ahead = way.select(F.col("pid").alias("behind"), F.col("behind").alias("b2"), F.col("out_open").alias("o2"), F.col("low").alias("l2"))
                back = way.select(F.col("pid").alias("before"), F.col("before").alias("a2"), F.col("in_open").alias("i2"))
                far = way.join(ahead, "behind", "left").join(back, "before", "left").select(
                    "pid", F.when(F.col("out_open"), F.col("behind")).otherwise(F.coalesce("b2", "behind")).alias("behind"), (F.col("out_open") | F.coalesce("o2", F.lit(False))).alias("out_open"),
                    F.when(F.col("in_open"), F.col("before")).otherwise(F.coalesce("a2", "before")).alias("before"), (F.col("in_open") | F.coalesce("i2", F.lit(False))).alias("in_open"),
                    F.when(F.col("out_open"), F.col("low")).otherwise(F.least("low", "l2")).alias("low"),
                )
                then = tables.table(far)
                tables.drop(way)
                way = then
                if way.filter("NOT (in_open AND out_open)").isEmpty():
                    break
            rings.append(way.filter("NOT out_open").select("pid", F.col("low").alias("cycle")))
            runs.append(way.filter("out_open").select("pid", "before", "behind"))
            linked = links.select("pid")
            kept = now.join(linked.withColumnRenamed("pid", "waiter"), "waiter", "left_anti").join(linked.withColumnRenamed("pid", "blocker"), "blocker", "left_anti").select("waiter", "blocker")
            rest = tables.table(_dealt(kept.union(runs[-1].select("before", "behind")), count, "waiter", "blocker").distinct())
            tables.drop(now)
            now = rest
        tables.drop(links)
        left = now.count()
        if left == count and not n_links:
            return now, rings, runs
        count = left
    raise RuntimeError(f"chains not taken out in {limit} rounds")


def _circling(edges: DataFrame) -> DataFrame:
    """The distinct edges whose waiter is waited for as well, as on every cycle; most sessions only wait."""
    edges = edges.filter("waiter IS NOT NULL AND blocker IS NOT NULL").select("waiter", "blocker")
    return edges.join(edges.select(F.col("blocker").alias("waiter")).distinct(), "waiter", "left_semi").distinct()


def cycle_members(edges: DataFrame, rounds: int = 1_000) -> DataFrame:
    """(pid, cycle) on a waiting cycle; ``cycle`` is the smallest pid of those that wait for each other. A table in the shared folder.

    Ends and chains are taken out first (``_contracted``), in rounds that grow with the logarithm of their length. Of the rest each node takes the smallest
    pid that reaches it; a node that took its own pid is the root of a component, and what reaches it back over edges of its own colour belongs to
    that. Those are taken out and the rest goes on. Last, the links of a chain join the component that both its ends are in. Every table has a row for a
    node or an edge, never one for a pair that reaches each other. Self waits are cycles of one; repeated edges and nulls do no harm.
    """
    with Rounds(edges.sparkSession) as tables:
        return tables.keep(_members(tables.table(_circling(edges)), tables, rounds))


def _members(given: DataFrame, tables: Rounds, rounds: int) -> DataFrame:
    """``cycle_members`` of distinct edges in a table, not written yet."""
    size = given.count()
    parts = [given.filter("waiter = blocker").select(F.col("waiter").alias("pid"), F.col("waiter").alias("cycle"))]
    now, rings, runs = _contracted(given.filter("waiter <> blocker"), tables, rounds)
    for _ in range(rounds):
        # a chain that came back to where it began is an edge of a node to itself
        parts.append(now.filter("waiter = blocker").select(F.col("waiter").alias("pid"), F.col("waiter").alias("cycle")))
        now = now.filter("waiter <> blocker")
        if not (left := now.count()):
            break
        nodes = _dealt(now.select(F.col("waiter").alias("pid")).union(now.select("blocker")), 2 * left, "pid").distinct()
        colour = _spread(now.select(F.col("waiter").alias("source"), F.col("blocker").alias("target")), nodes.withColumn("label", F.col("pid")), tables, rounds)
        tint = lambda name: colour.select(F.col("pid").alias(name), F.col("label").alias(f"{name}_label"))
        own = tables.table(now.join(tint("waiter"), "waiter").join(tint("blocker"), "blocker").filter("waiter_label = blocker_label").select(F.col("blocker").alias("source"), F.col("waiter").alias("target")))
        members = _spread(own, colour.filter("pid = label"), tables, rounds).select("pid", F.col("label").alias("cycle"))
        several = _dealt(members, left, "cycle").groupBy("cycle").agg(F.count("*").alias("n")).filter("n > 1").select("cycle")
        parts.append(members.join(several, "cycle", "left_semi").select("pid", "cycle"))
        gone = members.select(F.col("pid").alias("waiter"))
        now, more_rings, more_runs = _contracted(now.join(gone, "waiter", "left_anti").join(gone.withColumnRenamed("waiter", "blocker"), "blocker", "left_anti").select("waiter", "blocker"), tables, rounds)
        rings, runs = rings + more_rings, runs + more_runs
    else:
        raise RuntimeError(f"cycles not found in {rounds} rounds")
    parts += [ring.select("pid", "cycle") for ring in rings]
    found = tables.table(_dealt(_union(parts), size, "pid").groupBy("pid").agg(F.min("cycle").alias("cycle")))
    for run in reversed(runs):
        at = lambda name: found.select(F.col("pid").alias(name), F.col("cycle").alias(f"{name}_cycle"))
        inside = run.join(at("before"), "before").join(at("behind"), "behind").filter("before_cycle = behind_cycle").select("pid", F.col("before_cycle").alias("cycle"))
        found = tables.table(_dealt(found.union(inside), size, "pid").groupBy("pid").agg(F.min("cycle").alias("cycle")))
    lowest = _dealt(found, size, "cycle").groupBy("cycle").agg(F.min("pid").alias("low"))
    return found.join(lowest, "cycle").select("pid", F.col("low").alias("cycle"))


def cycles(edges: DataFrame, members: DataFrame | None = None, rounds: int = 100_000) -> DataFrame:
    """(cycle, pids): of each group of sessions that wait for each other one shortest cycle through its smallest pid, beginning there. Among equally
    short ones each pid is followed backwards to its smallest waiter. A table in the shared folder.

    Breadth first from the smallest pid, along who waits for whom, within the group, some levels before a table is written; each newly met session keeps
    the smallest of those it was met from, and an edge to itself keeps what is known of it. A group stops when its smallest pid is met again. The way is then
    followed back by doubled steps, in rounds that grow with the logarithm of its length.
    """
    with Rounds(edges.sparkSession) as tables:
        given = tables.table(_circling(edges))
        members = tables.table((_members(given, tables, 1_000) if members is None else members).select("pid", "cycle"))
        tint = lambda name: members.select(F.col("pid").alias(name), F.col("cycle").alias(f"{name}_cycle"))
        inside = given.join(tint("waiter"), "waiter").join(tint("blocker"), "blocker").filter("waiter_cycle = blocker_cycle").select(F.col("waiter_cycle").alias("cycle"), "waiter", "blocker", F.lit(1).alias("hop"))
        ways = tables.table(inside.union(members.select("cycle", "pid", "pid", F.lit(0))))
        size, pid = ways.count(), members.schema["pid"].dataType
        seen = tables.table(members.filter("pid = cycle").select("cycle", "pid", F.lit(0).alias("level"), F.lit(None).cast(pid).alias("met_from")))
        ends, steps = [], []
        for _ in range(rounds):
            far = seen
            for _ in range(_HOPS):
                met = ways.join(far.withColumnRenamed("pid", "waiter"), ["cycle", "waiter"])
                last = F.struct((F.col("level") + F.col("hop")).alias("level"), F.when(F.col("hop") == 1, F.col("waiter")).otherwise(F.col("met_from")).alias("met_from"))
                far = _dealt(met.select("cycle", F.col("blocker").alias("pid"), last.alias("last")), size, "cycle", "pid").groupBy("cycle", "pid").agg(F.min("last").alias("last")).select("cycle", "pid", "last.level", "last.met_from")
            far = tables.table(far)
            tables.drop(seen)
            back = ways.filter("hop = 1 AND blocker = cycle").select("cycle", F.col("waiter").alias("pid"))
            end = tables.table(_dealt(far.join(back, ["cycle", "pid"]), size, "cycle").groupBy("cycle").agg(F.min(F.struct("level", "pid")).alias("end")).select("cycle", "end.level", "end.pid"))
            ends.append(end)
            steps.append(far.join(end.select("cycle"), "cycle", "left_semi"))
            seen = far.join(end.select("cycle"), "cycle", "left_anti")
            if seen.isEmpty():
                break
            seen = tables.table(seen)
        else:
            raise RuntimeError(f"cycles longer than {rounds} rounds of {_HOPS}")
        ends = tables.table(_union(ends))
        # where 1, 2, 4 ... steps back lead, as far as the longest of the cycles asks
        longest = ends.agg(F.max("level")).first()[0] or 0
        jumps = [tables.table(_union(steps).filter("level > 0").select("cycle", "pid", F.col("met_from").alias("to")))] if longest else []
        while 2 ** len(jumps) <= longest:
            jump = jumps[-1]
            jumps.append(tables.table(jump.join(jump.select("cycle", F.col("pid").alias("to"), F.col("to").alias("further")), ["cycle", "to"]).select("cycle", "pid", F.col("further").alias("to"))))
        path = ends
        for k in reversed(range(len(jumps))):
            both = F.array(F.struct("level", "pid"), F.struct((F.col("level") - 2**k).alias("level"), F.col("to").alias("pid")))
            path = path.join(jumps[k], ["cycle", "pid"], "left").select("cycle", F.explode(both).alias("x")).select("cycle", "x.level", "x.pid").filter("pid IS NOT NULL")
        pids = F.transform(F.array_sort(F.collect_list(F.struct("level", "pid"))), lambda x: x["pid"])
        return tables.keep(_dealt(path, size, "cycle").groupBy("cycle").agg(pids.alias("pids")))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def verdict(edges: DataFrame) -> DataFrame:
    """(verdict, edges, cycles, root_blockers) of a whole wait-for graph, all but the first as counts: DEADLOCK_CYCLE if sessions wait in a circle,
    LINEAR_LOCK_CHAIN if some only wait, CLEAN if none does."""
    n = F.count("*").cast("bigint")
    parts = (
        edges.agg(n.alias("n")).withColumn("what", F.lit("edges"))
        .unionByName(cycle_members(edges).agg(F.count_distinct("cycle").alias("n")).withColumn("what", F.lit("cycles")))
        .unionByName(root_blockers(edges).agg(n.alias("n")).withColumn("what", F.lit("root_blockers")))
    )
    counts = parts.agg(*(F.sum(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("edges", "cycles", "root_blockers")))
    said = F.when(F.col("cycles") > 0, "DEADLOCK_CYCLE").when(F.col("edges") > 0, "LINEAR_LOCK_CHAIN").otherwise("CLEAN")
    return counts.select(said.alias("verdict"), "edges", "cycles", "root_blockers")


def waits(edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """Every session of a wait-for graph with its role: deadlocked (on a cycle), blocked by one (it waits for a member), root blocker
    (others wait, it waits for nobody), queued, or both waiting and blocking."""
    pids = edges.select(F.col("waiter").alias("pid"), F.lit(1).alias("waits"), F.lit(0).alias("blocks")).union(edges.select("blocker", F.lit(0), F.lit(1)))
    pids = pids.groupBy("pid").agg(F.sum("waits").alias("waits"), F.sum("blocks").alias("blocks"))
    stuck = edges.join(cycles.select(F.col("pid").alias("blocker")), "blocker", "left_semi").select(F.col("waiter").alias("pid")).distinct().withColumn("stuck", F.lit(True))
    rows = pids.join(cycles, "pid", "left").join(stuck, "pid", "left")
    role = F.when(F.col("cycle").isNotNull(), "deadlocked").when(F.col("stuck"), "behind a deadlock").when(F.col("waits") == 0, "root blocker").when(F.col("blocks") == 0, "queued").otherwise("waits and blocks")
    return rows.select("pid", "waits", "blocks", "cycle", role.alias("role"))


def hold_islands(samples: DataFrame, gap_seconds: int) -> DataFrame:
    """(pid, island, held_from, held_to, ticks): runs of samples of a pid without a gap longer than ``gap_seconds``."""
    by_pid = W.partitionBy("pid").orderBy("tick")
    new = F.coalesce(F.unix_timestamp("tick") - F.unix_timestamp(F.lag("tick").over(by_pid)) > gap_seconds, F.lit(True))
    return (
        samples.select("pid", "tick").distinct().withColumn("new", new.cast("int"))
        .withColumn("island", F.sum("new").over(by_pid.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("pid", "island").agg(F.min("tick").alias("held_from"), F.max("tick").alias("held_to"), F.count("*").alias("ticks"))
    )


def queue_trips(samples: DataFrame, window: str, max_depth: int, max_wait: float) -> DataFrame:
    """(start, depth, longest, trip) of each time window of samples (ts, wait)."""
    return samples.groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("depth"), F.coalesce(F.max("wait"), F.lit(0.0)).alias("longest")).select(
        F.col("w.start").alias("start"), "depth", "longest", ((F.col("depth") > max_depth) | (F.col("longest") > max_wait)).alias("trip")
    )


def stale_holders(locks: DataFrame, live: DataFrame, now, seconds: int = 30) -> DataFrame:
    """Locks with ``status``: STALE if the heartbeat is older than ``seconds`` or the backend is gone."""
    there = live.select("pid", F.lit(True).alias("there")).distinct()
    stale = (F.unix_timestamp(now) - F.unix_timestamp("last_heartbeat") > seconds) | F.col("there").isNull()
    return locks.join(there, "pid", "left").withColumn("status", F.when(stale, "STALE").otherwise("ACTIVE")).drop("there")
