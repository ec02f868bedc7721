"""The stand-in inputs of the plans cover whole tables, and their results hold against brute force."""

from lithic.plans import fold_plans, graph_plans, log_plans, registry
from lithic.plans.base import frame

DIR, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows(spark, name, d=DIR):
    return {tuple(r) for r in registry.QUERIES[name](spark, d).collect()}


def edges(spark, sql, d):
    return {tuple(r) for r in frame(spark, d, sql).collect()}


def test_graphs_keep_whole_keys(spark):
    parts, suppliers = (spark.read.parquet(f"{LARGER}/{t}.parquet").count() for t in ("part", "supplier"))
    dag, cyclic = edges(spark, graph_plans.DAG, LARGER), edges(spark, graph_plans.CYCLIC, LARGER)
    assert len({a for a, _ in dag}) == parts - 1 and all(a > b for a, b in dag)
    assert len({a for a, _ in cyclic}) == suppliers and {b for _, b in cyclic} <= {a for a, _ in cyclic}


def test_levels_against_brute_force(spark):
    below: dict = {}
    for a, b in edges(spark, graph_plans.DAG, LARGER):
        below.setdefault(a, set()).add(b)
    level: dict = {}
    for n in range(max(below) + 1):
        level[n] = max((level[b] + 1 for b in below.get(n, ())), default=0)
    assert rows(spark, "dep_levels", LARGER) == set(level.items())


def test_cycles_against_brute_force(spark):
    e = edges(spark, graph_plans.CYCLIC, LARGER)
    reach: dict = {}
    for n in {a for a, _ in e}:
        todo, seen = [n], set()
        while todo:
            x = todo.pop()
            for a, b in e:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[n] = seen
    component = {n: min([n, *(m for m in reach[n] if n in reach[m])]) for n in reach}
    on_cycle = {n for n in reach if n in reach[n]}
    assert rows(spark, "reachability", LARGER) == {(a, b) for a in reach for b in reach[a]}
    assert rows(spark, "scc", LARGER) == set(component.items())
    assert rows(spark, "cyclic_nodes", LARGER) == {(n,) for n in on_cycle}
    assert rows(spark, "deferred_fks", LARGER) == {(a, b) for a, b in e if component[a] == component[b]}
    assert rows(spark, "cycle_breakers", LARGER) == {(c, max(n for n in on_cycle if component[n] == c)) for c in {component[n] for n in on_cycle}}


def test_line_differences_keep_whole_orders(spark):
    for d in (DIR, LARGER):
        orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority").collect()
        for sql in (log_plans.LEFT, log_plans.RIGHT):
            assert len(edges(spark, sql, d)) == len(orders)
        changed = [r for r in orders if r.o_orderkey % 7 == 0]
        want = {("left", f"{r.o_orderkey}|{r.o_custkey}|{r.o_orderpriority}") for r in changed} | {("right", f"{r.o_orderkey}|{r.o_custkey}|CHANGED") for r in changed}
        assert rows(spark, "line_set_diff", d) == want
        assert rows(spark, "diff_topk", d) == set(sorted(want)[:25]) | {("~", f"omitted {len(want) - 25}")}
