"""Bounded walks against a queue in memory."""

import random
from itertools import takewhile

import pytest

from tidewire.operators import impact
from tidewire.operators.checkpoint import cut


def walked(edges, seeds, hops, most_links, most_nodes, hub):
    edges = sorted(edges)
    degree: dict = {}
    for s, _, o, _ in edges:
        degree[s] = degree.get(s, 0) + 1
        degree[o] = degree.get(o, 0) + 1
    queue, seen, links, used = [(s, 0) for s in sorted(seeds)], set(seeds), [], set()
    while queue and len(links) < most_links and len(seen) < most_nodes:
        node, hop = queue.pop(0)
        if hop >= hops or (hop and degree.get(node, 0) > hub):
            continue
        for s, p, o, c in edges:
            if node in (s, o) and c >= 0.35 and (s, p, o) not in used:
                used.add((s, p, o))
                forward, other = s == node, o if s == node else s
                links.append((s, p, o, forward, min(hop + 1, 4), round(c * 0.75**hop, 9)))
                if other not in seen:
                    seen.add(other)
                    queue.append((other, hop + 1))
    return sorted(links, key=lambda x: (-x[5], x[4], *x[:3]))[:most_links]


@pytest.mark.parametrize("seed,limits", [(1, (3, 40, 400, 40)), (2, (3, 9, 400, 4)), (3, (2, 200, 12, 5)), (4, (4, 1000, 1000, 3))])
def test_impact_links(spark, seed, limits):
    r = random.Random(seed)
    edges = {(f"n{r.randrange(30)}", r.choice(["supplies", "part_of"]), f"n{r.randrange(30)}"): r.choice([0.2, 0.4, 0.5, 0.9, 1.0]) for _ in range(70)}
    rows = [(*k, c) for k, c in edges.items()]
    seeds = [f"n{i}" for i in range(0, 30, 13)]
    frame = spark.createDataFrame(rows, "subject string, predicate string, object string, confidence double")
    hops, most_links, most_nodes, hub = limits
    out = impact.impact_links(frame, spark.createDataFrame([(s,) for s in [*seeds, None]], "node string"), cut, hops, most_links, most_nodes, hub)
    assert [(*x[:5], round(x[5], 9)) for x in map(tuple, out.collect())] == walked(rows, seeds, *limits)


def test_walk_of_nothing(spark):
    edges = spark.createDataFrame([("a", "supplies", "b", 0.1)], "subject string, predicate string, object string, confidence double")
    assert impact.impact_links(edges, spark.createDataFrame([("a",)], "node string"), cut).collect() == []
    assert impact.impact_links(edges, spark.createDataFrame([], "node string"), cut).collect() == []


def test_trends_that_name_nothing_are_not_sorted(spark):
    links = spark.createDataFrame([(f"S{i}", "supplies", f"C{i}", True, 1, 1 - i / 100, f"m{i}") for i in range(30)], "subject string, predicate string, object string, forward boolean, order int, confidence double, mechanism string")
    kinds = "id long, name string, named array<string>, claims array<struct<entity:string,mechanism:string,order:int>>"
    silent = impact.trend_cascades(spark.createDataFrame([(i, "", [], [("", "x", 3)]) for i in range(5)], kinds), links)
    assert sorted((x.id, x.place, x.mechanism) for x in silent.collect()) == sorted((i, p + 1, f"m{p}") for i in range(5) for p in range(20))
    plan = silent._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    top = next(i for i, line in enumerate(plan) if "windowspecdefinition(id" in line)
    below = list(takewhile(lambda line: depth(line) > depth(plan[top]), plan[top + 1 :]))
    assert not any("Cross" in line for line in below)
    named = impact.trend_cascades(spark.createDataFrame([(1, "arc", ["c3", "s3", "S7"], [("N1", " pays ", 9), (" ", "x", 3)])], kinds), links)
    assert [tuple(x)[1:6] for x in named.orderBy("place").collect()] == [(1, "S3", "C3", "m3", 1), (2, "S7", "C7", "m7", 1), (3, "arc", "N1", "pays", 4)]
