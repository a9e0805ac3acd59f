import heapq
import random

from pyspark.sql import functions as F

from wayfold.operators import network, paths


def grid(n=14, seed=3):
    rnd = random.Random(seed)
    nodes = [(i * n + j, -6.0 + i * 0.01, 106.0 + j * 0.01) for i in range(n) for j in range(n)]
    edges = []
    for i in range(n):
        for j in range(n):
            for di, dj in ((0, 1), (1, 0)):
                a, b = i * n + j, (i + di) * n + j + dj
                if i + di < n and j + dj < n:
                    for u, v in ((a, b), (b, a)):
                        if rnd.random() > 0.15:
                            edges.append((u, v, 100.0 + rnd.randrange(900), rnd.random() * 90, rnd.choice(["yes", "no"])))
    return nodes, edges


def dijkstra(edges, s):
    out = {}
    for u, v, _, w, _ in edges:
        out.setdefault(u, []).append((v, w))
    dist, todo = {s: 0.0}, [(0.0, s)]
    while todo:
        d, u = heapq.heappop(todo)
        if d > dist[u]:
            continue
        for v, w in out.get(u, []):
            if d + w < dist.get(v, 1e18):
                dist[v] = d + w
                heapq.heappush(todo, (d + w, v))
    return dist


def test_paths_over_many_blocks(spark):
    nodes, edges = grid()
    n = spark.createDataFrame(nodes, "node long, lat double, lon double")
    e = spark.createDataFrame(edges, "u long, v long, length double, travel_time double, toll string")
    net = paths.network_blocks(n, e, block_nodes=40)
    assert net.select("block").distinct().count() > 4
    sources = [0, 91, 195]
    seeds = spark.createDataFrame([(s, s, 0.0) for s in sources], "source long, node long, cost double")
    tree = paths.shortest_paths(seeds, net, group_sources=2)
    got = {(r.source, r.node): r for r in tree.collect()}
    for s in sources:
        want = dijkstra(edges, s)
        assert {n for (x, n) in got if x == s} == set(want)
        assert all(abs(got[(s, k)].cost - d) < 1e-9 for k, d in want.items())
    # traced paths add up to the same time, length and toll
    wanted = spark.createDataFrame([(1, 0, 195), (2, 195, 0), (3, 91, 91)], "route_id long, source long, node long")
    sums = {r.route_id: r for r in paths.path_totals(paths.trace_paths(wanted, tree), e).collect()}
    for route, s, t in ((1, 0, 195), (2, 195, 0), (3, 91, 91)):
        r = got[(s, t)]
        assert abs(sums[route].time_s - r.cost) < 1e-9 and abs(sums[route].length_m - r.length) < 1e-6 and abs(sums[route].toll_m - r.toll) < 1e-6
    # a search bounded by its targets gives the same costs
    targets = spark.createDataFrame([(0, 30), (91, 100)], "source long, node long")
    some = paths.shortest_paths(seeds, net, targets).collect()
    assert {(r.source, r.node): round(r.cost, 9) for r in some} == {k: round(got[k].cost, 9) for k in ((0, 30), (91, 100)) if k in got}


def test_components_and_special_edges(spark):
    e = spark.createDataFrame(
        [(1, 2), (2, 3), (3, 4), (10, 11), (7, 7)] + [(100, 100 + i) for i in range(1, 40)], "u long, v long")
    got = {r.node: r.component for r in network.weak_components(e).collect()}
    assert got[4] == got[1] == 1 and got[11] == 10 and got[139] == 100 and 7 not in got
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0)], "node long, lat double, lon double")
    zero = spark.createDataFrame([(1, 2, 0.0)], "u long, v long, travel_time double")
    assert network.speed_bound(nodes, zero).first()[0] == float("inf")
    par = spark.createDataFrame([(1, 2, 0, 83.3, None), (1, 2, 1, 500.0, 10.0), (1, 2, 2, 1.0, 10.0)], "u long, v long, key int, length double, travel_time double")
    assert network.collapse_parallel(par).select("key").collect()[0][0] == 0  # equal times: the first key
