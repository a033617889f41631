"""Ways, costs and decisions of units of several somas against plain walks and enumeration."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from dendrovox.operators import decisions, neurites, ways


def forest(seed, n, share):
    """(node, x, y, z, parent) of a tree whose nodes have few children, and its somas."""
    rnd = random.Random(seed)
    kids, rows = {}, []
    for i in range(n):
        parent = -1
        if i:
            parent = rnd.choice([p for p in range(i) if kids.get(p, 0) < (3 if p % 4 == 0 else 2)])
            kids[parent] = kids.get(parent, 0) + 1
        rows.append((i, *(rnd.uniform(0, 50) for _ in "xyz"), parent))
    return rows, [i for i in range(n) if rnd.random() < share]


def prepared(spark, rows, somas):
    tree = spark.createDataFrame([(i, 0, x, y, z, 1.0, p) for i, x, y, z, p in rows], "node_id long, node_type long, x double, y double, z double, radius double, parent_id long")
    marks = spark.createDataFrame([(s,) for s in somas], "node_id long")
    nodes = neurites.topology_nodes(tree, marks)
    found = neurites.neurites(tree, nodes)
    units = neurites.units(found, nodes)
    return tree, marks, nodes, found, units, neurites.roads(found, nodes, units)


def plain_ways(edges, somas):
    """{(unit, soma, lower): (next, order, below)} by walking each unit's edges from each of its somas."""
    out = {}
    for unit in {u for _, _, u in edges}:
        mine = [(a, b) for a, b, u in edges if u == unit]
        for soma in {s for e in mine for s in e if s in somas}:
            level, seen, at = [(soma, None, 0)], set(), 0
            while level:
                node, came, order = level.pop()
                if node in somas and node != soma:
                    continue
                for a, b in mine:
                    if node in (a, b) and (a, b) not in seen:
                        seen.add((a, b))
                        out[unit, soma, a] = came, order + 1, node == a
                        level.append((b if node == a else a, a, order + 1))
    return out


@pytest.mark.parametrize("seed", [1])
def test_ways_follow_the_tree(spark, seed):
    rows, somas = forest(seed, 60, 0.2)
    _, marks, _, _, _, roads = prepared(spark, rows, somas)
    edges = [(r["lower"], r["upper"], r["unit"]) for r in roads.collect()]
    got = {(r["unit"], r["soma"], r["lower"]): (r["next"], r["order"], r["below"]) for r in decisions.unit_ways(roads, marks).collect()}
    assert got == plain_ways(edges, set(somas)) and len(got) > 10


def test_costs_of_ways(spark):
    rows, somas = forest(5, 40, 0.2)
    tree, marks, nodes, _, _, roads = prepared(spark, rows, somas)
    ways = decisions.unit_ways(roads, marks)
    at, up = {r[0]: r[1:4] for r in rows}, {r[0]: r[4] for r in rows}
    got = {(r["soma"], r["lower"]): r["cost"] for r in decisions.way_costs(tree, nodes, ways, lambda a: 1 - a / math.pi).collect()}
    for r in ways.collect():
        line, here = [r["lower"]], r["lower"]
        while here != r["upper"]:
            here = up[here]
            line.append(here)
        line = line if r["below"] else line[::-1]
        s, angles, length = at[r["soma"]], [], 0.0
        for a, b in zip(line, line[1:]):
            go, away = [q - p for p, q in zip(at[a], at[b])], [p - q for p, q in zip(at[a], s)]
            size, far = math.hypot(*go), math.hypot(*away)
            angles.append(math.acos(max(-1, min(1, sum(x * y for x, y in zip(go, away)) / ((size + 1e-10) * (far + 1e-10))))))
            length += size
        p = 1 - sum(angles) / len(angles) / math.pi
        assert got[r["soma"], r["lower"]] == pytest.approx((1 - p * math.log(1 + 1 / r["order"])) * math.log1p(length))
    assert len(got) > 10


def least_cost(unit_edges, somas_of, nexts, cost):
    """The least total over all labellings in which a neurite's soma also has the next one on the way to it."""
    best = math.inf
    for labels in itertools.product(somas_of, repeat=len(unit_edges)):
        held = dict(zip(unit_edges, labels))
        if all(nexts[s, e] is None or held[nexts[s, e]] == s for e, s in held.items()):
            best = min(best, sum(cost[s, e] for e, s in held.items()))
    return best


@pytest.mark.parametrize("seed, part_edges", [(0, 20_000), (2, 2)])
def test_decisions_are_the_best_of_all(spark, seed, part_edges):
    rows, somas = forest(seed + 20, 46, 0.16)
    _, marks, nodes, found, units, roads = prepared(spark, rows, somas)
    roads = roads.cache()
    ways = decisions.unit_ways(roads, marks).cache()
    rnd = random.Random(seed)
    all_ways = ways.collect()
    cost = {(r["unit"], r["soma"], r["lower"]): rnd.uniform(0, 10) for r in sorted(all_ways)}
    costs = spark.createDataFrame([(*k, c) for k, c in cost.items()], "unit long, soma long, lower long, cost double")
    edges = decisions.decision_tree(roads, ways, costs)
    decided = decisions.decide(edges, part_edges)
    got = {(r["unit"], r["edge"]): r["soma"] for r in decided.collect()}
    road = {(r["unit"], r["lower"]): r["ramp"] or r["lower"] for r in roads.collect()}
    next_of = {(r["unit"], r["soma"], r["lower"]): r["next"] for r in all_ways}
    assert set(got) == {(u, e) for (u, _), e in road.items()}
    tried = 0
    for unit in {u for u, _ in road}:
        mine = sorted({e for (u, _), e in road.items() if u == unit})
        somas_of = sorted({s for u, s, _ in cost if u == unit})
        summed = {(s, e): sum(c for (u, t, low), c in cost.items() if u == unit and t == s and road[u, low] == e) for s in somas_of for e in mine}
        nexts = {(s, e): next_of[unit, s, e] for s in somas_of for e in mine}
        # The way of a neurite above all somas goes on below it, that of a ramp above it: never over another ramp.
        held = {e: got[unit, e] for e in mine}
        assert all(nexts[s, e] is None or held[nexts[s, e]] == s for e, s in held.items())
        total = sum(summed[s, e] for e, s in held.items())
        if len(somas_of) ** len(mine) < 300_000:
            tried += 1
            assert total == pytest.approx(least_cost(mine, somas_of, nexts, summed))
    assert tried
    whole = {r["lower"]: r["soma"] for r in decisions.assigned_neurites(found, nodes, units, roads, decided).collect()}
    assert all(whole[low] == got[u, e] for (u, low), e in road.items())


def test_no_units_no_decisions(spark):
    rows, _ = forest(1, 10, 0)
    _, marks, _, _, _, roads = prepared(spark, rows, [3])
    ways = decisions.unit_ways(roads, marks)
    costs = ways.select("unit", "soma", "lower", F.lit(1.0).alias("cost"))
    assert decisions.decide(decisions.decision_tree(roads, ways, costs)).collect() == []


def test_branchings_of_many_neurites():
    """A star: every way to share out somas is tried."""
    import numpy as np

    rng = np.random.default_rng(2)
    for k in (1, 2, 3, 4):
        n = k + 1
        values, below = [rng.uniform(0, 9, n) for _ in range(k)], [np.arange(n) == i for i in range(k)]
        for offered in (None, k):
            star = decisions.Branching(values, below)
            best = math.inf
            for labels in itertools.product(range(n), repeat=k):
                if all(s == i or s == offered or (s < k and labels[s] == s) for i, s in enumerate(labels)):
                    best = min(best, sum(v[s] for v, s in zip(values, labels)))
            chosen = star.choose((1 << k) - 1, offered)
            assert sum(values[i][s] for i, s in chosen.items()) == pytest.approx(best)
            assert best == pytest.approx(star.split((1 << k) - 1)[0] if offered is None else star.cost((1 << k) - 1)[offered])


def test_rows_of_ways_are_made_where_they_are_sent_on(spark, monkeypatch):
    """Neither tables nor blocks hold a row for each neurite and soma."""
    rows, somas = forest(8, 150, 0.25)
    _, marks, _, _, _, roads = prepared(spark, rows, somas)
    edges = [(r["lower"], r["upper"], r["unit"]) for r in roads.collect()]
    written, keep = [], decisions.materialize

    def counted(df):
        out = keep(df)
        written.append(out.count())
        return out

    for module in (decisions, ways):
        monkeypatch.setattr(module, "materialize", counted)
    monkeypatch.setattr(ways, "BLOCK", 50)
    monkeypatch.setattr(ways, "BATCH", 20)
    found = decisions.unit_ways(roads, marks)
    got = {(r["unit"], r["soma"], r["lower"]): (r["next"], r["order"], r["below"]) for r in found.collect()}
    assert got == plain_ways(edges, set(somas)) and len(got) > 2 * len(edges)
    assert max(written) <= len(edges)


def test_costs_by_vectors_are_those_of_rows(spark, monkeypatch):
    rows, somas = forest(5, 90, 0.2)
    tree, marks, nodes, _, _, roads = prepared(spark, rows, somas)
    tree = tree.withColumn("x", F.when(F.col("node_id") != 7, F.col("x")))
    monkeypatch.setattr(ways, "BLOCK", 40)
    want = decisions.way_costs(tree, nodes, decisions.unit_ways(roads, marks), lambda a: neurites.tail_probability(a, [-0.02, 0.0, 0.35], 0.9, 0.6))
    edges, units = ways.laid_out(roads, marks)
    edges = ways.with_points(edges, tree, neurites.neurite_nodes(tree, nodes))
    got = ways.costs(edges, ways.with_places(units, tree), lambda a: neurites.tail_probabilities(a, [-0.02, 0.0, 0.35], 0.9, 0.6), 9)
    want = {(r["unit"], r["soma"], r["lower"]): r["cost"] for r in want.collect()}
    got = {(r["unit"], r["soma"], r["lower"]): r["cost"] for r in got.collect()}
    assert set(got) == set(want) and len(got) > 100
    assert any(v is None for v in want.values()) == any(v is None for v in got.values())
    assert all(got[k] == (None if v is None else pytest.approx(v, abs=1e-8)) for k, v in want.items())


def test_decisions_without_rows_of_pairs(spark, monkeypatch):
    """Costs stay vectors from the neurites to the decisions; parts and blocks are cut anywhere."""
    rows, somas = forest(26, 70, 0.2)
    tree, marks, nodes, _, _, roads = prepared(spark, rows, somas)
    roads, inner = roads.cache(), neurites.neurite_nodes(tree, nodes).cache()
    ways_ = decisions.unit_ways(roads, marks)
    costs = decisions.way_costs(tree, nodes, ways_, lambda a: neurites.tail_probability(a, [-0.02, 0.0, 0.35], 0.9, 0.6))
    want = decisions.decide(decisions.decision_tree(roads, ways_, costs)).collect()
    written, keep = [], decisions.materialize

    def counted(df):
        out = keep(df)
        written.append(out.count())
        return out

    for module in (decisions, ways):
        monkeypatch.setattr(module, "materialize", counted)
    monkeypatch.setattr(ways, "BLOCK", 30)
    monkeypatch.setattr(ways, "TOGETHER", 2)
    got = decisions.decide_roads(roads, marks, tree, inner, lambda a: neurites.tail_probabilities(a, [-0.02, 0.0, 0.35], 0.9, 0.6), 3)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want} and len(want) > 20
    assert max(written) <= 2 * roads.count() < ways_.count()
