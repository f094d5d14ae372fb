import random

import brute_walks as W
from braidwork.operators import graph as G
from braidwork.operators import omnitigs as O


def component(r, base, n, m):
    """A strongly connected graph of n nodes and m arcs."""
    arcs = {(base + i, base + (i + 1) % n) for i in range(n)}
    while len(arcs) < m:
        a, b = r.randrange(n), r.randrange(n)
        if a != b:
            arcs.add((base + a, base + b))
    return sorted(arcs)


def test_tables_match_the_definitions(spark):
    r = random.Random(11)
    parts = {100 * i: component(r, 100 * i, *r.choice([(5, 8), (6, 8), (8, 11), (9, 12), (9, 11)])) for i in range(14)}
    parts[2000] = component(r, 2000, 4, 4)
    # a component on either side of arcs that belong to none
    df = spark.createDataFrame([x for p in parts.values() for x in p] + [(5, 105), (203, 9999)], "src long, dst long").repartition(3)
    walks = {base: W.maximal_omnitigs(arcs) for base, arcs in parts.items()}
    nodes = lambda arcs, w: " ".join(map(str, [arcs[w[0]][0]] + [arcs[e][1] for e in w]))
    assert sorted(map(tuple, O.omnitigs(df).collect())) == sorted((b, i, len(w), nodes(parts[b], w)) for b in parts for i, w in enumerate(walks[b]))
    counts, per, safe = [], [], []
    for b, arcs in parts.items():
        g = W.Digraph(arcs)
        micro = W.microtigs(arcs, walks[b])
        macro = W.macrotigs(micro)
        n = [len(w) for w in macro]
        counts.append((b, len(micro), sum(map(bool, micro.values())), len(macro), sum(n), max(n, default=0), min(n, default=0)))
        hard = [set(zip(w, w[1:])) for w in walks[b] if not W.is_trivial(g, w)]
        per += [(b, i, sum(bool(set(zip(m, m[1:])) & w) for w in hard)) for i, m in enumerate(macro)]
        own = W.node_safe_walks(arcs)
        inside = lambda w: any(len(g.into[x]) > 1 and any(len(g.out[y]) > 1 for y in w[i:-1]) for i, x in enumerate(w[1:-1], 1))
        safe.append((b, len(own), sum(len(w) > 2 for w in own), sum(map(inside, own))))
    assert any(x[3] for x in counts)
    assert sorted(tuple(x) for x in O.macro_counts(df).select("scc", "macronodes", "with_microtigs", "macrotigs", "edges", "most", "least").collect()) == sorted(counts)
    assert sorted(map(tuple, O.omnitigs_per_macrotig(df).collect())) == sorted(per)
    assert sorted(map(tuple, O.node_safe_counts(df).collect())) == sorted(safe)


def test_no_component(spark):
    df = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    assert O.omnitigs(df).count() == 0
    assert O.macro_counts(df).count() == 0
    assert O.omnitigs(df.limit(0)).count() == 0


def test_a_loop_is_a_circle(spark):
    df = spark.createDataFrame([(3, 3), (3, 3)], "src long, dst long")
    assert [tuple(x) for x in O.omnitigs(df).collect()] == [(3, 0, 1, "3 3")]
    assert len(set(G.tarjan([3], [3]).values())) == 1


def test_rows_and_tables_search_alike(spark, monkeypatch):
    """Nodes reached are rows in large components alone."""
    r = random.Random(5)
    parts = {100 * i: component(r, 100 * i, 8, 12) for i in range(3)}
    df = spark.createDataFrame([x for p in parts.values() for x in p], "src long, dst long")
    written = []
    stored = O.session.stored
    monkeypatch.setattr(O.session, "stored", lambda df, label="table": written.append(label) or stored(df, label))
    rows = sorted(map(tuple, O.omnitigs(df).collect()))
    assert "front" not in written
    monkeypatch.setattr(O, "ROW_LETTERS", 2)
    assert sorted(map(tuple, O.omnitigs(df).collect())) == rows
    monkeypatch.setattr(O, "TASK_LETTERS", 3)
    assert sorted(map(tuple, O.omnitigs(df).collect())) == rows
    assert "front" in written
