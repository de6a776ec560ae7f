import random

from doclake.operators.hierarchy import contract

SCHEMA = "src string, node_id string, parent_id string, depth int"


def brute(pairs):
    parent = {}
    for n, p in pairs:
        if n is not None:
            parent[n] = p if n not in parent or parent[n] is None else parent[n] if p is None else min(p, parent[n])
    parent = {n: p if p in parent else None for n, p in parent.items()}
    above = {}
    for n in parent:
        path, x = [n], n
        while parent[x] is not None and len(path) <= len(parent):
            x = parent[x]
            path.append(x)
        above[n] = path[::-1] if parent[x] is None else None
    below = {n: 0 for n in parent}
    for path in above.values():
        for x in (path or [])[:-1]:
            below[x] += 1
    return sorted(((n, p[0], len(p) - 1, below[n], "/".join(p)) if p else (n, "", -1, -1, None) for n, p in above.items()), key=repr)


def test_trees_chains_and_loops(spark):
    rnd = random.Random(9)
    pairs = [("r", None), ("lone", "nowhere"), ("self", "self"), ("under", "self"), ("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("hang", "l2"), ("hang2", "hang"), ("m1", "m2"), ("m2", "m1"), (None, "r"), ("twice", "r"), ("twice", "r"), ("twice", None)]
    pairs += [(f"c{i}", f"c{i - 1}" if i else "r") for i in range(120)]
    pairs += [(f"k{i}", f"k{(i + 1) % 37}") for i in range(37)]
    pairs += [(f"t{i}", f"t{rnd.randrange(i)}" if i else None) for i in range(300)]
    df = spark.createDataFrame([("a", n, p, 0) for n, p in pairs] + [("b", "r", "c5", 0)], SCHEMA)
    got = contract(df, paths=True).collect()
    assert [(r.node_id, r.root_id, r.depth, r.n_desc) for r in got if r.src == "b"] == [("r", "r", 0, 0)]
    assert sorted(((r.node_id, r.root_id, r.depth, r.n_desc, "/".join(r.path) if r.path else None) for r in got if r.src == "a"), key=repr) == brute(pairs)


def test_no_nodes(spark):
    assert contract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_parent_of_a_third_of_all_nodes(spark):
    """A hub with leaves, with short chains and in the middle of a long chain."""
    n = 3_000
    data = [("t", f"leaf{i}", "hub") for i in range(n)] + [("t", f"top{i}", "hub") for i in range(n // 3)] + [("t", f"low{i}", f"top{i}") for i in range(n // 3)]
    data += [("t", "hub", "c0")] + [("t", f"c{i}", f"c{i + 1}") for i in range(40)] + [("t", "c40", None)]
    got = {r.node_id: (r.root_id, r.depth, r.n_desc) for r in contract(spark.createDataFrame(data, "src string, node_id string, parent_id string")).collect()}
    assert len(got) == len(data) and {r for r, _, _ in got.values()} == {"c40"}
    assert got["hub"] == ("c40", 41, n + 2 * (n // 3)) and got["leaf7"] == ("c40", 42, 0) and got["low5"] == ("c40", 43, 0) and got["top5"][2] == 1 and got["c40"][2] == len(data) - 1
