from wayfold.operators import benchmarks, changes


def test_comparison_of_pairs(spark):
    rows = [(1, 10.0, 8.0, 50, 20), (2, 8.0, 10.0, 20, 50), (3, 0.0, 0.0, 5, 5), (4, None, 1.0, 3, None), (5, 1.0, 3.0, 9, 9)]
    df = spark.createDataFrame(rows, "pair_index int, dijkstra_ms double, astar_ms double, dijkstra_nodes int, astar_nodes int")
    got = {r.pair_index: tuple(r)[5:] for r in benchmarks.compare_pairs(df).collect()}
    assert got == {
        1: ("A*", 2.0, 20.0, "A*", 30, 30), 2: ("Dijkstra", 2.0, 20.0, "Dijkstra", 30, 0), 3: ("Sama", 0.0, 0.0, "Sama", 0, 0),
        4: (None, None, None, None, None, None), 5: ("Dijkstra", 2.0, 66.7, "Sama", 0, 0),
    }


def test_settings_are_deleted(spark):
    now = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "user_id string, x int")
    ask = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "user_id string")
    rest, answers = changes.delete_settings(now, ask)
    assert {(r.user_id, r.x) for r in rest.collect()} == {("b", 2), (None, 3)}
    assert {tuple(r) for r in answers.collect()} == {("a", "success"), ("z", "not_found"), (None, "not_found")} and answers.count() == 3
