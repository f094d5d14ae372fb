"""Omnitigs, macro structures and safe walks: of the trade graph between nations, and of the strong components of the event graph, which has walks with joins before splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.operators import omnitigs as O
from braidwork.operators import safewalks
from braidwork.plans.graph_queries import EG, NG, event_graph, nation_arcs
from braidwork.plans.registry import query

c = F.col


def numbered_sql(arcs: str) -> str:
    """Edges inside strong components, their degrees, and pairs of them with a detour, of the arcs `arcs` (src, dst)."""
    return f"""ar AS (SELECT DISTINCT src, dst FROM {arcs}),
rc AS (SELECT src AS a, src AS b FROM ar UNION SELECT dst, dst FROM ar UNION SELECT rc.a, ar.dst FROM rc JOIN ar ON ar.src = rc.b),
sc AS (SELECT x.a AS node, min(x.b) AS scc FROM rc x JOIN rc y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
n AS MATERIALIZED (SELECT row_number() OVER (ORDER BY x.scc, src, dst) - 1 AS edge, x.scc, src, dst FROM ar JOIN sc x ON x.node = src JOIN sc y ON y.node = dst AND y.scc = x.scc),
dg AS MATERIALIZED (SELECT scc, node, sum(i) AS n_in, sum(o) AS n_out FROM (SELECT scc, src AS node, 0 AS i, 1 AS o FROM n UNION ALL SELECT scc, dst, 1, 0 FROM n) GROUP BY scc, node),
pr AS (SELECT x.edge AS e, y.edge AS f, x.dst AS goal, y.src AS start FROM n x JOIN n y ON y.scc = x.scc JOIN dg a ON a.node = x.dst AND a.n_in > 1 JOIN dg b ON b.node = y.src AND b.n_out > 1),
dt AS (SELECT e, f, goal, n.dst AS cur FROM pr JOIN n ON n.src = start AND n.edge <> e AND n.edge <> f UNION SELECT e, f, goal, n.dst FROM dt JOIN n ON n.src = cur AND n.edge <> e AND n.edge <> f WHERE cur <> goal),
bd AS MATERIALIZED (SELECT f, list(DISTINCT e) AS es FROM dt WHERE cur = goal GROUP BY f),
ci AS (SELECT scc, min(edge) AS first FROM n GROUP BY scc HAVING count(*) = count(DISTINCT src) AND count(*) = count(DISTINCT dst)),
wk AS (SELECT scc, [edge] AS items, dst FROM n WHERE scc NOT IN (SELECT scc FROM ci) UNION ALL
  SELECT wk.scc, list_append(items, n.edge), n.dst FROM wk JOIN n ON n.src = wk.dst AND n.scc = wk.scc LEFT JOIN bd ON bd.f = n.edge WHERE NOT list_has_any(items, coalesce(bd.es, []::BIGINT[]))),
cw AS (SELECT ci.scc, [first] AS items, n.dst FROM ci JOIN n ON n.edge = first UNION ALL SELECT cw.scc, list_append(items, n.edge), n.dst FROM cw JOIN n ON n.src = cw.dst AND n.scc = cw.scc AND n.edge <> items[1]),
mx AS MATERIALIZED (SELECT scc, items FROM wk WHERE items NOT IN (SELECT items[:-2] FROM wk WHERE len(items) > 1) AND items NOT IN (SELECT items[2:] FROM wk WHERE len(items) > 1)
  UNION ALL SELECT scc, max_by(items, len(items)) FROM cw GROUP BY scc),
om AS MATERIALIZED (SELECT scc, row_number() OVER (PARTITION BY scc ORDER BY items) - 1 AS walk, items FROM mx),
st AS MATERIALIZED (SELECT o.scc, walk, pos, o.edge, n.src, n.dst, dg.n_in AS n_in, dg.n_out AS n_out FROM (SELECT scc, walk, unnest(items) AS edge, unnest(range(0, len(items))) AS pos FROM om) o JOIN n USING (edge) JOIN dg ON dg.node = n.src)"""


OMNI = "SELECT scc, walk, count(*) AS n, min_by(src, pos)::VARCHAR || ' ' || string_agg(dst, ' ' ORDER BY pos) AS nodes FROM st GROUP BY scc, walk"
#: Pieces of hard walks inside macronodes, and macrotigs.
MACRO = """ha AS (SELECT scc, walk FROM st WHERE pos > 0 GROUP BY scc, walk HAVING max(pos) FILTER (n_out > 1) > min(pos) FILTER (n_in > 1)),
bi AS (SELECT scc, node FROM dg WHERE n_in > 1 AND n_out > 1),
ob AS (SELECT scc, node AS centre, node FROM bi UNION SELECT ob.scc, centre, n.src FROM ob JOIN n ON n.dst = ob.node JOIN dg ON dg.node = n.src AND dg.n_out = 1),
oa AS (SELECT scc, node AS centre, node FROM bi UNION SELECT oa.scc, centre, n.dst FROM oa JOIN n ON n.src = oa.node JOIN dg ON dg.node = n.dst AND dg.n_in = 1),
ow AS (SELECT * FROM ob UNION SELECT * FROM oa),
ins AS (SELECT DISTINCT st.scc, st.walk, pos, edge, centre FROM st JOIN ha USING (scc, walk) JOIN ow ON ow.node = st.src OR ow.node = st.dst),
pc AS (SELECT DISTINCT scc, centre, list(edge ORDER BY pos) AS items FROM (SELECT *, pos - row_number() OVER (PARTITION BY scc, centre, walk ORDER BY pos) AS run FROM ins) GROUP BY scc, centre, walk, run HAVING count(*) > 1),
px AS (SELECT *, ',' || array_to_string(items, ',') || ',' AS line FROM pc),
mi AS MATERIALIZED (SELECT row_number() OVER (ORDER BY scc, items, centre) AS piece, scc, centre, items FROM px WHERE NOT EXISTS (SELECT 1 FROM px y WHERE y.centre = px.centre AND y.line <> px.line AND contains(y.line, px.line))),
fi AS (SELECT scc, items[1] AS edge, min(piece) AS piece FROM mi GROUP BY ALL HAVING count(*) = 1), la AS (SELECT scc, items[-1] AS edge, min(piece) AS prev FROM mi GROUP BY ALL HAVING count(*) = 1),
nx AS (SELECT prev, piece FROM fi JOIN la USING (scc, edge)),
mc AS (SELECT piece AS head, piece AS cur, items FROM mi WHERE piece NOT IN (SELECT piece FROM nx) UNION ALL SELECT head, nx.piece, list_concat(mc.items, mi.items[2:]) FROM mc JOIN nx ON nx.prev = mc.cur JOIN mi ON mi.piece = nx.piece),
lo AS (SELECT piece AS s, piece AS cur FROM mi WHERE piece NOT IN (SELECT cur FROM mc) UNION SELECT s, nx.piece FROM lo JOIN nx ON nx.prev = lo.cur), lh AS (SELECT DISTINCT min(cur) AS head FROM lo GROUP BY s),
lc AS (SELECT head, head AS cur, items FROM lh JOIN mi ON mi.piece = head UNION ALL SELECT head, nx.piece, list_concat(lc.items, mi.items[2:]) FROM lc JOIN nx ON nx.prev = lc.cur AND nx.piece <> lc.head JOIN mi ON mi.piece = nx.piece),
al AS (SELECT head, max_by(items, len(items)) AS items FROM (SELECT * FROM mc UNION ALL SELECT * FROM lc) GROUP BY head),
ay AS (SELECT mi.scc, head, al.items, ',' || array_to_string(al.items, ',') || ',' AS line FROM al JOIN mi ON mi.piece = head),
mt AS MATERIALIZED (SELECT scc, row_number() OVER (PARTITION BY scc ORDER BY items) - 1 AS macrotig, items FROM ay WHERE NOT EXISTS (SELECT 1 FROM ay y WHERE y.scc = ay.scc AND (y.line <> ay.line AND contains(y.line, ay.line) OR y.line = ay.line AND y.head < ay.head)))"""
COUNTS = """SELECT s.scc, coalesce(a.k, 0) AS macronodes, coalesce(b.k, 0) AS with_microtigs, coalesce(d.k, 0) AS macrotigs, coalesce(d.edges, 0)::BIGINT AS edges, coalesce(d.most, 0) AS most, coalesce(d.least, 0) AS least
FROM (SELECT DISTINCT scc FROM n) s LEFT JOIN (SELECT scc, count(*) AS k FROM bi GROUP BY scc) a USING (scc) LEFT JOIN (SELECT scc, count(DISTINCT centre) AS k FROM mi GROUP BY scc) b USING (scc)
LEFT JOIN (SELECT scc, count(*) AS k, sum(len(items)) AS edges, max(len(items)) AS most, min(len(items)) AS least FROM mt GROUP BY scc) d USING (scc)"""
PER = """SELECT mt.scc, macrotig, (SELECT count(DISTINCT st.walk) FROM st JOIN st y ON y.scc = st.scc AND y.walk = st.walk AND y.pos = st.pos + 1 JOIN ha ON ha.scc = st.scc AND ha.walk = st.walk
  WHERE st.scc = mt.scc AND contains(',' || array_to_string(mt.items, ',') || ',', ',' || st.edge || ',' || y.edge || ',')) AS omnitigs FROM mt"""
SAFE = """sp AS (SELECT st.*, NOT (st.n_out > 1 AND d.n_in > 1) AS needed FROM st JOIN dg d ON d.node = st.dst),
rg AS (SELECT scc, walk, min(pos) FILTER (needed) AS a, max(pos) FILTER (needed) AS b, max_by(dst, pos) AS last FROM sp GROUP BY scc, walk),
nw AS (SELECT rg.scc, rg.walk, CASE WHEN a IS NULL THEN [last] ELSE list_prepend(min_by(src, pos) FILTER (pos >= a), list(dst ORDER BY pos) FILTER (pos BETWEEN a AND b)) END AS nodes FROM rg JOIN sp ON sp.scc = rg.scc AND sp.walk = rg.walk GROUP BY rg.scc, rg.walk, a, b, last),
ns AS (SELECT DISTINCT scc, nodes, chr(10) || array_to_string(nodes, chr(10)) || chr(10) AS line FROM nw),
sf AS (SELECT scc, nodes FROM ns WHERE NOT EXISTS (SELECT 1 FROM ns y WHERE y.scc = ns.scc AND y.line <> ns.line AND contains(y.line, ns.line)))
SELECT scc, count(*) AS walks, count(*) FILTER (len(nodes) > 2) AS longer, count(*) FILTER (hard) AS non_trivial FROM
  (SELECT sf.scc, sf.nodes, coalesce(max(pos) FILTER (n_out > 1) >= min(pos) FILTER (n_in > 1), false) AS hard FROM sf LEFT JOIN (SELECT nodes, unnest(nodes) AS node, unnest(range(0, len(nodes))) AS pos FROM sf) p ON p.nodes = sf.nodes AND pos > 0 AND pos < len(sf.nodes) - 1 LEFT JOIN dg ON dg.node = p.node GROUP BY sf.scc, sf.nodes) GROUP BY scc"""
#: The trade graph's nodes aren't text.
N, E = numbered_sql("a"), numbered_sql("e")


def arcs_of_events(spark, sf):
    return event_graph(spark, sf).select("src", "dst")


@query("g18_omnitigs", f"WITH RECURSIVE {NG}, {N} {OMNI}")
def g18(spark, sf):
    """Maximal omnitigs of the strong components of the trade graph between nations' suppliers."""
    return O.omnitigs(nation_arcs(spark, sf))


@query("g18_event_omnitigs", f"WITH RECURSIVE {EG}, {E} {OMNI}")
def g18_events(spark, sf):
    return O.omnitigs(arcs_of_events(spark, sf))


@query("g20_g22_macro_structures", f"WITH RECURSIVE {NG}, {N}, {MACRO} {COUNTS}")
def g20(spark, sf):
    return O.macro_counts(nation_arcs(spark, sf))


@query("g20_g22_event_macro_structures", f"WITH RECURSIVE {EG}, {E}, {MACRO} {COUNTS}")
def g20_events(spark, sf):
    return O.macro_counts(arcs_of_events(spark, sf))


@query("g19_omnitigs_per_macrotig", f"WITH RECURSIVE {NG}, {N}, {MACRO} {PER}")
def g19(spark, sf):
    return O.omnitigs_per_macrotig(nation_arcs(spark, sf))


@query("g19_event_omnitigs_per_macrotig", f"WITH RECURSIVE {EG}, {E}, {MACRO} {PER}")
def g19_events(spark, sf):
    return O.omnitigs_per_macrotig(arcs_of_events(spark, sf))


@query("g29_node_safe_walks", f"WITH RECURSIVE {NG}, {N}, {SAFE}")
def g29(spark, sf):
    return O.node_safe_counts(nation_arcs(spark, sf))


@query("g29_event_node_safe_walks", f"WITH RECURSIVE {EG}, {E}, {SAFE}")
def g29_events(spark, sf):
    return O.node_safe_counts(arcs_of_events(spark, sf))


@query("g30_g32_hamiltonian_preprocessing")
def g30(spark, sf):
    return safewalks.preprocess(nation_arcs(spark, sf))
