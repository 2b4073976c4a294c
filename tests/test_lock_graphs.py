"""Wait-for graphs: who waits in a circle, by which way, against plain versions."""

import random

from schemaloom.operators import locks


def frame(spark, edges):
    return spark.createDataFrame(list(edges), "waiter long, blocker long").repartition(3)


def plain_members(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    to = {a: reach(a) for a in after}
    return {a: min(b for b in to[a] if a in to.get(b, ())) for a in after if a in to[a]}


def plain_cycle(edges, members, root):
    inside = [(a, b) for a, b in edges if members.get(a) == root == members.get(b)]
    met, edge, level = {root: None}, {root}, 0
    while True:
        level += 1
        new = {}
        for a, b in sorted(inside):
            if a in edge:
                new[b] = min(a, new.get(b, a))
        if root in new:
            path = [new[root]]
            while path[0] != root:
                path.insert(0, met[path[0]])
            return path
        edge = {b for b in new if b not in met}
        met |= {b: new[b] for b in edge}


GRAPHS = {
    "pair": [(101, 102), (102, 101)], "three": [(201, 202), (202, 203), (203, 201)], "line": [(301, 302), (302, 303)], "none": [], "self": [(1, 1), (2, 1), (1, 3)],
    "bridge": [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4)], "loops": [(5, 6), (6, 5), (5, 7), (7, 8), (8, 5), (9, 5)],
    "chord": [(1, 9), (9, 8), (8, 7), (7, 6), (6, 1), (9, 6), (8, 6), (3, 1)], "repeated": [(1, 2), (1, 2), (2, 1), (2, 1)],
    "inner": [(10, 4), (4, 3), (3, 10), (10, 7), (7, 2), (2, 9), (9, 10), (2, 50), (50, 51), (51, 52), (52, 60), (60, 52)],
}
for seed in range(4):
    rng = random.Random(seed)
    GRAPHS[f"random {seed}"] = [(rng.randrange(40), rng.randrange(40)) for _ in range(34 + 9 * seed)]


def test_members_and_cycles_equal_plain_ones(spark):
    edges = [(1000 * k + a, 1000 * k + b) for k, g in enumerate(GRAPHS.values()) for a, b in g]
    df = frame(spark, edges)
    want = plain_members(set(edges))
    members = locks.cycle_members(df)
    assert {r.pid: r.cycle for r in members.collect()} == want
    assert {r.cycle: r.pids for r in locks.cycles(df, members).collect()} == {c: plain_cycle(set(edges), want, c) for c in set(want.values())}


def test_long_chains_and_rings_take_few_rounds(spark):
    chain = [(i, i + 1) for i in range(3000)]
    ring = [(10_000 + i, 10_000 + (i + 1) % 2000) for i in range(2000)]
    tail = [(20_000 + i, 20_001 + i) for i in range(500)] + [(20_500, 10_007)]
    bow = [(30_000 + i, 30_001 + i) for i in range(400)] + [(30_400, 30_000), (30_200, 30_100)]
    got = {r.pid: r.cycle for r in locks.cycle_members(frame(spark, chain + ring + tail + bow), rounds=20).collect()}
    assert got == {**{10_000 + i: 10_000 for i in range(2000)}, **{30_000 + i: 30_000 for i in range(401)}}


def test_verdicts(spark):
    said = {n: tuple(locks.verdict(frame(spark, GRAPHS[n])).first()) for n in ("line", "none", "bridge")}
    assert said == {"line": ("LINEAR_LOCK_CHAIN", 2, 0, 1), "none": ("CLEAN", 0, 0, 0), "bridge": ("DEADLOCK_CYCLE", 6, 2, 0)}


def test_cycles_take_few_tables(spark, monkeypatch):
    """a table for some levels of the search, and the way back by doubled steps; a table or two for each level before."""
    written = []
    table = locks.Rounds.table
    monkeypatch.setattr(locks.Rounds, "table", lambda self, df: written.append(1) or table(self, df))
    ring = [(i, (i + 1) % 60) for i in range(60)]
    members = spark.createDataFrame([(i, 0) for i in range(60)], "pid long, cycle long")
    assert {r.cycle: r.pids for r in locks.cycles(frame(spark, ring), members).collect()} == {0: list(range(60))}
    assert len(written) < 60
