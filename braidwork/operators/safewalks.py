"""Hamiltonian preprocessing, per strong component.

Arcs that every circuit must use are contracted one after the other, in a fixed order: a strong component is one
task's group. Components over MOST_EDGES edges are refused with an error rather than cut.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.operators import graph as G

MOST_EDGES = 5_000


def shrink(arcs: list[tuple]) -> tuple[list[tuple], bool]:
    """Hamiltonian preprocessing: (arcs, possible). A node with one way out (or in) must use it: the arc is contracted, and its rivals go. A node without a way, or a lost strong connection, rules a circuit out."""
    arcs = sorted({(a, b) for a, b in arcs if a != b})
    nodes = {v for x in arcs for v in x}
    while len(nodes) > 2:
        out: dict = {v: [] for v in nodes}
        into: dict = {v: [] for v in nodes}
        for a, b in arcs:
            out[a].append(b)
            into[b].append(a)
        if any(not x for x in out.values()) or any(not x for x in into.values()):
            return arcs, False
        if len(set(G.tarjan([a for a, _ in arcs], [b for _, b in arcs]).values())) > 1:
            return arcs, False
        forced = next(((v, out[v][0]) for v in sorted(nodes) if len(out[v]) == 1), None) or next(((into[v][0], v) for v in sorted(nodes) if len(into[v]) == 1), None)
        if forced is None:
            break
        a, b = forced  # a takes over b's arcs out
        arcs = sorted({(x, y) for x, y in ((a if x == b else x, y) for x, y in arcs if x != a and y != b) if x != y})
        nodes.discard(b)
    return arcs, len(nodes) > 2 or len(nodes) == 2 and {(a, b) for a, b in arcs} >= {(a, b) for a in nodes for b in nodes if a != b}


def per_component(arcs: DataFrame, work, schema: str) -> DataFrame:
    """work(list of (src, dst), component) -> rows, for each strong component with an arc."""
    edges = arcs.select(F.concat_ws(" ", "src", "dst").alias("edge"), "src", "dst")
    inside = G.induced(edges, G.strong_components(edges).select("node", "scc"), "scc").select("scc", "src", "dst")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_EDGES:
            raise ValueError(f"a strong component of {len(pdf)} edges is beyond this algorithm's {MOST_EDGES}")
        pdf = pdf.sort_values(["src", "dst"])
        rows = work(list(zip(pdf["src"].tolist(), pdf["dst"].tolist())), pdf["scc"].iloc[0])
        return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return inside.groupBy("scc").applyInPandas(run, schema)


def preprocess(arcs: DataFrame) -> DataFrame:
    """(scc, nodes, arcs, nodes_left, arcs_left, possible, nodes_removed, arcs_removed): sizes before and after, removed in percent."""

    def work(a, scc):
        left, possible = shrink(a)
        n, m = len({v for x in a for v in x}), len({v for x in left for v in x})
        return [(scc, n, len(a), m, len(left), possible, 100.0 * (n - m) / n, 100.0 * (len(a) - len(left)) / len(a))]

    return per_component(arcs, work, "scc bigint, nodes bigint, arcs bigint, nodes_left bigint, arcs_left bigint, possible boolean, nodes_removed double, arcs_removed double")
