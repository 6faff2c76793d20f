from __future__ import annotations

import random

from strataframe.operators.hierarchy import descendants, hierarchy, intervals


def brute(links: dict) -> dict:
    out = {}
    for n in links:
        chain, at = [n], n
        while links.get(at) in links and links[at] not in chain:
            at = links[at]
            chain.append(at)
        if links.get(at) in links:
            out[n] = ("cycle" if links[at] == n or n in chain[chain.index(links[at]) :] else "into-cycle", None, -1)
        else:
            out[n] = ("tree", at, len(chain) - 1)
    return out


def run(spark, links: dict, schema="id string, parent string", **kw):
    df = spark.createDataFrame([(k, v) for k, v in links.items()], schema)
    return {r.id: (r.kind, r.root, r.depth) for r in hierarchy(df, **kw).collect()}


def test_random_forests_with_cycles(spark):
    rng = random.Random(5)
    links = {f"n{k}": rng.choice([None, "gone", *[f"n{j}" for j in range(60)]]) for k in range(60)}
    links |= {f"c{k}": f"c{k - 1}" for k in range(1, 40)} | {"c0": None, "self": "self", "under": "self"}
    assert run(spark, links) == brute(links)


def test_long_chain_and_large_broadcast_switch(spark, monkeypatch):
    import strataframe.operators.hierarchy as h

    links = {k: k - 1 for k in range(1, 130)} | {0: None, 500: 501, 501: 500, 502: 501}
    want = brute(links)
    for limit in (0, 10, 40_000):
        monkeypatch.setattr(h, "BROADCAST_ROWS", limit)
        assert run(spark, links, "id long, parent long") == want


def test_nulls_repeats_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", None, 1), (None, "a", 2), ("b", "a", 3), ("b", "a", 3), ("b", None, 4)], "id string, parent string, depth int")
    assert sorted((r.id, r.root, r.depth) for r in hierarchy(df).collect()) == [("a", "a", 0), ("b", "a", 1)]
    assert hierarchy(df.limit(0)).count() == 0
    assert hierarchy(df.limit(0), paths=True).columns == ["id", "root", "depth", "kind", "path"]


def test_paths_and_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("x", "y"), ("y", "x")], "id string, parent string")
    tree = hierarchy(df, paths=True)
    assert {r.id: r.path for r in tree.collect()} == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"], "d": ["a", "b", "d"], "x": None, "y": None}
    assert sorted(map(tuple, descendants(tree).collect())) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)]


def test_intervals_hold_the_descendants(spark):
    rng = random.Random(9)
    links = [(f"n{k}", f"n{rng.randrange(k)}" if k and rng.random() < 0.95 else None) for k in range(80)] + [("x", "y"), ("y", "x")]
    tree = hierarchy(spark.createDataFrame(links, "id string, parent string"), paths=True)
    place = {r.id: (r.first, r.last) for r in intervals(tree).collect()}
    assert sorted(p[0] for p in place.values()) == list(range(1, 81))
    want = {(r.ancestor, r.descendant) for r in descendants(tree).collect()}
    assert {(a, b) for a, (s, e) in place.items() for b, (t, _) in place.items() if s < t <= e} == want


def test_path_joins_are_never_broadcast(spark):
    links = [(k, k - 1 if k else None) for k in range(300)]
    tree = hierarchy(spark.createDataFrame(links, "id long, parent long"), paths=True)
    assert "Broadcast" not in tree._jdf.queryExecution().executedPlan().toString()
    assert {len(r.path) - r.depth for r in tree.collect()} == {1}
