"""Graph queries over all orders: brute force on a fixture."""

from tessera.queries import graphs


def write(spark, path, name, rows, columns):
    spark.createDataFrame(rows, columns).write.parquet(f"{path}/{name}.parquet")


def test_graphs_take_all_orders(spark, tmp_path):
    orders = [(1, 20, "F"), (2, 20, "P"), (3, 40, "O"), (4, 5, "F")]
    lines = [(1, 1, 1), (2, 2, 2), (2, 2, 2), (3, 3, 3), (4, 1, 1)]
    write(spark, tmp_path, "orders", orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string")
    write(spark, tmp_path, "lineitem", lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint")
    write(spark, tmp_path, "supplier", [(1, 7), (2, 7), (3, 8)], "s_suppkey bigint, s_nationkey bigint")
    write(spark, tmp_path, "customer", [(20,), (40,), (5,)], "c_custkey bigint")
    edges = {(f"c{c}", f"p{p}") for o, c, _ in orders for k, p, _ in lines if o == k} | {(f"p{p}", f"s{s}") for _, p, s in lines} | {("s1", "n7"), ("s2", "n7"), ("s3", "n8")}
    reached = {}
    for start in ("c20", "c40"):
        layer, seen = {start}, {start}
        for depth in (1, 2, 3):
            layer = {b for a, b in edges if a in layer} - seen
            seen |= layer
            reached |= {(start, node): depth for node in layer}
    assert {(r.start, r.node): r.depth for r in graphs.graph_neighbours_all(spark, str(tmp_path)).collect()} == reached
    nodes = {x for e in edges for x in e}
    degrees = {x: (sum(a == x for a, _ in edges), sum(b == x for _, b in edges)) for x in nodes}
    assert {r.node: (r.out_degree, r.in_degree) for r in graphs.graph_degrees_all(spark, str(tmp_path)).collect()} == degrees
    component = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            component[a] = component[b] = min(component[a], component[b])
    assert {r.node: r.component for r in graphs.graph_components_all(spark, str(tmp_path)).collect()} == component and len(set(component.values())) == 2
