"""Interval operators: lineitem as alignments of reads (orders) on contigs (parts), and as node alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork import session
from braidwork.operators import intervals as I
from braidwork.operators import chunks as C
from braidwork.plans.registry import DNA_SQL, ORACLES, dna, query, records, table

c = F.col


def contigs(spark, sf):
    return table(spark, sf, "part", "p_partkey").select(c("p_partkey").alias("name"), F.lit(24000).cast("bigint").alias("len"))


def alignments(spark, sf):
    li = table(spark, sf, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")
    start = (c("l_orderkey") * 37 + c("l_linenumber") * 101) % 20000
    return li.select(c("l_partkey").alias("tname"), c("l_orderkey").alias("qname"), start.alias("tstart"), (start + 1000 + 40 * c("l_quantity").cast("bigint")).alias("tend"), (c("l_suppkey") % 25).alias("qstart"), (3000 - c("l_suppkey") % 21).alias("qend"))


ALN = """con AS (SELECT p_partkey AS name, 24000::BIGINT AS len FROM part),
aln AS (SELECT l_partkey AS tname, l_orderkey AS qname, (l_orderkey * 37 + l_linenumber * 101) % 20000 AS tstart,
  (l_orderkey * 37 + l_linenumber * 101) % 20000 + 1000 + 40 * l_quantity::BIGINT AS tend, l_suppkey % 25 AS qstart, 3000 - l_suppkey % 21 AS qend FROM lineitem),
ev AS (SELECT tname AS name, block, count(*) AS e FROM (SELECT tname, unnest(range(((tstart + 499) // 32 + 1)::BIGINT, least((tend - 499) // 32, 750)::BIGINT)) AS block FROM aln) GROUP BY ALL),
blk AS (SELECT name, block, coalesce(e, 0) AS e FROM (SELECT name, unnest(range(0, 750)) AS block FROM con) LEFT JOIN ev USING (name, block))"""
BRK = f"""{ALN},
low AS (SELECT name, block, block - row_number() OVER (PARTITION BY name ORDER BY block) AS g FROM blk WHERE e < 2 AND block >= 22 AND block < 728),
run AS (SELECT name, CASE WHEN min(block) = 22 THEN 0 ELSE min(block) END AS a, max(block) AS b FROM low GROUP BY name, g),
brk AS (SELECT name, a AS start, CASE WHEN b = 727 THEN 750 ELSE b END AS "end" FROM run WHERE CASE WHEN b = 727 THEN (750 - a) * 32 > 1000 ELSE a <> 0 OR (b + 1) * 32 > 1000 END)"""


@query("a2_group_by_target", f"WITH {ALN} SELECT tname, count(*) AS n, min(tstart) AS first, max(tend) AS last FROM aln GROUP BY tname")
def a2(spark, sf):
    return alignments(spark, sf).groupBy("tname").agg(F.count("*").alias("n"), F.min("tstart").alias("first"), F.max("tend").alias("last"))


@query("a3_unmapped_contigs", "SELECT c_custkey AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def a3(spark, sf):
    return I.unmapped(table(spark, sf, "customer").select(c("c_custkey").alias("name")), table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(c("o_custkey").alias("tname")))


@query("a4_read_lengths", "SELECT l_orderkey, l_linenumber, o_totalprice AS read_len FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def a4(spark, sf):
    reads = table(spark, sf, "orders").select(c("o_orderkey").alias("l_orderkey"), c("o_totalprice").alias("read_len"))
    return table(spark, sf, "lineitem", "l_orderkey", "l_linenumber").join(reads, "l_orderkey")


@query("a5_proper_alignments", f"WITH {ALN} SELECT tname, count(*) AS n FROM aln WHERE NOT (tstart > 10 AND qstart > 10) AND NOT (tend < 23990 AND qend < 2990) GROUP BY tname")
def a5(spark, sf):
    return alignments(spark, sf).filter(I.proper(F.lit(24000), F.lit(3000))).groupBy("tname").agg(F.count("*").alias("n"))


@query("a6_block_evidence", f"WITH {ALN} SELECT name, sum(e)::BIGINT AS total, max(e) AS most, count(*) FILTER (e < 2) AS weak FROM blk GROUP BY name")
def a6(spark, sf):
    size = c("limit") - c("first")
    return I.evidence(contigs(spark, sf), alignments(spark, sf)).groupBy("name").agg(F.sum(c("evidence") * size).alias("total"), F.max("evidence").alias("most"), F.coalesce(F.sum(F.when(c("evidence") < 2, size)), F.lit(0)).alias("weak"))


@query("a7_breakpoints", f"WITH {BRK} SELECT name, start, \"end\" FROM brk")
def a7(spark, sf):
    return I.breakpoints(contigs(spark, sf), alignments(spark, sf))


def real(spark, sf):
    start = (c("name") * 131) % 20000
    return contigs(spark, sf).select("name", start.alias("start"), (start + 200).alias("end"))


@query("a8_a9_compare_breakpoints", f"""WITH {BRK}, rel AS (SELECT name, (name * 131) % 20000 AS rs, (name * 131) % 20000 + 200 AS re FROM con),
h AS (SELECT b.name, b.start, b."end", row_number() OVER (PARTITION BY b.name ORDER BY b.start) = 1 AS f, lead(b.start) OVER (PARTITION BY b.name ORDER BY b.start) IS NULL AS l,
  EXISTS (SELECT 1 FROM rel r WHERE r.name = b.name AND rs <= (b."end" + 1) * 32 AND b.start * 32 <= re) AS hit FROM brk b),
n AS (SELECT count(*) AS n_found, count(*) FILTER (hit) AS n_correct, count(*) FILTER (NOT hit) AS n_wrong,
  (count(*) FILTER (NOT hit AND f AND start = 0) + count(*) FILTER (NOT hit AND l AND "end" = 750))::BIGINT AS n_wrong_terminal FROM h),
m AS (SELECT count(*) AS n_real, count(*) FILTER (EXISTS (SELECT 1 FROM brk b WHERE b.name = rel.name AND rs <= (b."end" + 1) * 32 AND b.start * 32 <= re)) AS n_real_found FROM rel)
SELECT *, n_wrong / n_found AS fp_rate, (n_wrong - n_wrong_terminal) / n_found AS fp_rate_inner, 1 - n_real_found / n_real AS fn_rate FROM n, m""")
def a8(spark, sf):
    return I.compare_breakpoints(contigs(spark, sf), I.breakpoints(contigs(spark, sf), alignments(spark, sf)), real(spark, sf))


@query("a10_split_contigs", f"""WITH {BRK}, p AS (SELECT name, row_number() OVER w - 1 AS ix, coalesce((lag("end") OVER w + 1) * 32, 0) AS a, start * 32 AS b FROM brk WINDOW w AS (PARTITION BY name ORDER BY start))
SELECT name || '.' || ix AS id, a::BIGINT AS start, b::BIGINT AS "end" FROM p WHERE b - a >= 1000 AND name IN (SELECT tname FROM aln)
UNION ALL SELECT name::VARCHAR, 0, len FROM con WHERE name NOT IN (SELECT name FROM brk) AND name IN (SELECT tname FROM aln)""")
def a10(spark, sf):
    cs, al = contigs(spark, sf), alignments(spark, sf)
    return I.split_contigs(cs, I.breakpoints(cs, al), al)


@query("a11_run_statistics", f"WITH {BRK} SELECT (SELECT count(*) FROM con) AS n_contigs, (SELECT count(*) FROM brk) AS n_breakpoints, (SELECT count(*) FROM brk WHERE start <> 0 AND \"end\" <> 750) AS n_inner, (SELECT sum(e) FROM blk)::BIGINT AS evidence")
def a11(spark, sf):
    cs, al = contigs(spark, sf), alignments(spark, sf)
    b = I.breakpoints(cs, al).agg(F.count("*").alias("n_breakpoints"), F.count_if((c("start") != 0) & (c("end") != 750)).alias("n_inner"))
    e = I.evidence(cs, al).agg(F.sum(c("evidence") * (c("limit") - c("first"))).alias("evidence"))
    return cs.agg(F.count("*").alias("n_contigs")).crossJoin(b).crossJoin(e)  # one row each


def aligns(spark, sf):
    start = 100000 + (c("l_partkey") * 7) % 400 + F.when(c("l_quantity") > 40, 1500).otherwise(0)
    return table(spark, sf, "lineitem").select(c("l_orderkey").alias("node"), F.when(c("l_quantity") > 49, "c1").otherwise("c0").alias("contig"), start.alias("a_start"), (start + 1024 + (c("l_suppkey") % 3) * 64).alias("a_end"))


NODE = """al AS (SELECT l_orderkey AS node, CASE WHEN l_quantity > 49 THEN 'c1' ELSE 'c0' END AS contig, 100000 + (l_partkey * 7) % 400 + CASE WHEN l_quantity > 40 THEN 1500 ELSE 0 END AS a_start,
  100000 + (l_partkey * 7) % 400 + CASE WHEN l_quantity > 40 THEN 1500 ELSE 0 END + 1024 + (l_suppkey % 3) * 64 AS a_end FROM lineitem),
st AS (SELECT *, coalesce(abs(a_start - lag(a_start) OVER w) > 128 OR abs(a_end - lag(a_end) OVER w) > 128, false) AS split, (a_start + a_end) / 2 - lag((a_start + a_end) / 2) OVER w AS gap,
  row_number() OVER w AS place FROM al WINDOW w AS (PARTITION BY node ORDER BY a_start + a_end, a_start, a_end)),
dev AS (SELECT node, CASE WHEN count(DISTINCT contig) = 1 THEN greatest(max(a_start) - min(a_start), max(a_end) - min(a_end)) END AS deviation FROM al GROUP BY node)"""


@query("s16_b1_decode_alignments", """SELECT l_orderkey, l_linenumber, 'r' || l_partkey AS read_id, 'NC_' || l_suppkey || '.2' AS contig_id, l_partkey AS read_start, l_partkey + 20000 AS read_end,
  (l_returnflag = 'R') = (l_linenumber % 2 = 0) AS forward, l_quantity > 25 AS star,
  CASE WHEN l_linenumber % 2 = 0 THEN l_partkey + 256 * l_linenumber ELSE l_partkey + 20000 - 256 * l_linenumber - 256 * l_quantity::BIGINT END AS align_start FROM lineitem""")
def b1(spark, sf):
    straight = c("l_linenumber") % 2 == 0
    low, high = c("l_partkey"), c("l_partkey") + 20000
    token = F.concat_ws("_", F.concat(F.lit("r"), "l_partkey"), F.lit("NC"), F.concat("l_suppkey", F.lit(".2")), F.when(straight, low).otherwise(high), F.when(straight, high).otherwise(low), F.when(c("l_returnflag") == "R", "F").otherwise("R"), "l_linenumber", F.concat(c("l_quantity").cast("bigint"), F.when(c("l_quantity") > 25, "*").otherwise("")))
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", I.decode_alignment(token).alias("d"))
    return d.select("l_orderkey", "l_linenumber", *(c(f"d.{k}").alias(k) for k in ("read_id", "contig_id", "read_start", "read_end", "forward", "star", "align_start")))


@query("b2_node_deviation", f"WITH {NODE} SELECT * FROM dev")
def b2(spark, sf):
    return I.node_deviation(aligns(spark, sf))


@query("b3_deviation_shares", f"WITH {NODE} SELECT count(*) AS n, count(*) FILTER (deviation < 256) * 100.0 / count(*) AS correct, count(*) FILTER (deviation >= 1024) * 100.0 / count(*) AS large_error, count(*) FILTER (deviation IS NULL) * 100.0 / count(*) AS joins_contigs FROM dev")
def b3(spark, sf):
    return I.deviation_shares(I.node_deviation(aligns(spark, sf)))


@query("b4_transitively_correct", f"WITH {NODE} SELECT node, NOT bool_or(split) AS correct FROM st GROUP BY node")
def b4(spark, sf):
    return I.transitively_correct(aligns(spark, sf))


SESSIONS = f"""{NODE}, se AS (SELECT *, sum(split::INT) OVER (PARTITION BY node ORDER BY place) AS session, max(a_end) OVER (PARTITION BY node) AS top FROM st),
ss AS (SELECT *, max(session) OVER (PARTITION BY node) AS sessions FROM se)"""


@query("b5_transitive_intervals", f"WITH {SESSIONS} SELECT node, min_by(a_start, place) AS start, CASE WHEN session = sessions THEN max(top) ELSE max_by(a_end, place) END AS \"end\" FROM ss GROUP BY node, session, sessions")
def b5(spark, sf):
    return I.transitive_intervals(aligns(spark, sf))


@query("b6_deviation_histogram", f"WITH {NODE} SELECT floor(log2(greatest(deviation, 1)))::BIGINT AS bin, count(*) AS n FROM dev WHERE deviation IS NOT NULL GROUP BY 1")
def b6(spark, sf):
    return I.deviation_histogram(I.node_deviation(aligns(spark, sf)))


@query("b7_linkage_heights", f"WITH {NODE} SELECT node, gap AS height FROM st WHERE gap IS NOT NULL")
def b7(spark, sf):
    return I.linkage_1d(aligns(spark, sf))


@query("b8_largest_subnode", f"""WITH {NODE}, s AS (SELECT node, sum(coalesce((gap > 128)::INT, 0)) OVER (PARTITION BY node ORDER BY place) AS session FROM st), n AS (SELECT node, count(*) AS n FROM s GROUP BY node, session)
SELECT node, max(n) / sum(n) AS share FROM n GROUP BY node""")
def b8(spark, sf):
    return I.largest_subnode(aligns(spark, sf))


@query("b9_pair_distances", "SELECT a.p_brand, a.p_partkey AS a, b.p_partkey AS b, levenshtein(a.p_name, b.p_name)::INT AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey")
def b9(spark, sf):
    return I.pair_distances(table(spark, sf, "part"), "p_brand", "p_partkey", "p_name")


def named_aligns(spark, sf):
    """(node, item, center, text): a node's alignments with the part's name for the reference slice."""
    start = 100000 + (c("l_partkey") * 7) % 400 + F.when(c("l_quantity") > 40, 1500).otherwise(0)
    li = table(spark, sf, "lineitem").select(c("l_orderkey").alias("node"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("item"), "l_partkey", (start + 512 + (c("l_suppkey") % 3) * 32).cast("double").alias("center"))
    return li.join(table(spark, sf, "part").select(c("p_partkey").alias("l_partkey"), c("p_name").alias("text")), "l_partkey").drop("l_partkey")


#: All cuts of single linkage by thresholds: with the first r pairs of a node by distance, which items hang together; a cut's number is that of its parts, and the fewest parts without a gap count.
CUTS = """it AS (SELECT l_orderkey AS node, l_linenumber::BIGINT * 100000000000000 + l_partkey * 1000000 + l_suppkey AS item, 100000 + (l_partkey * 7) % 400 + CASE WHEN l_quantity > 40 THEN 1500 ELSE 0 END + 512 + (l_suppkey % 3) * 32 AS center, p_name AS text FROM lineitem JOIN part ON p_partkey = l_partkey),
fa AS (SELECT node, bool_or(coalesce(far, false)) AS far FROM (SELECT node, center - lag(center) OVER (PARTITION BY node ORDER BY center) > 128 AS far FROM it) GROUP BY node),
dt AS (SELECT a.node, a.item AS a, b.item AS b, levenshtein(a.text, b.text) AS d FROM it a JOIN it b ON a.node = b.node AND a.item < b.item JOIN fa ON fa.node = a.node AND fa.far),
rk AS (SELECT node, a, b, row_number() OVER (PARTITION BY node ORDER BY d, a, b) AS r FROM dt), rs AS (SELECT node, unnest(range(0, max(r) + 1)) AS t FROM rk GROUP BY node),
re AS (SELECT it.node, t, item AS root, item FROM it JOIN rs USING (node) UNION SELECT re.node, re.t, re.root, CASE WHEN rk.a = re.item THEN rk.b ELSE rk.a END FROM re JOIN rk ON rk.node = re.node AND rk.r <= re.t AND (rk.a = re.item OR rk.b = re.item)),
pa AS (SELECT node, t, item, min(root) AS part FROM re GROUP BY ALL),
ga AS (SELECT node, t, part, center - lag(center) OVER (PARTITION BY node, t, part ORDER BY center) > 128 AS far FROM pa JOIN it USING (node, item)),
ct AS (SELECT node, t, count(DISTINCT part) AS k, bool_or(coalesce(far, false)) AS far FROM ga GROUP BY node, t),
k AS (SELECT node, min(k) AS clusters FROM ct WHERE NOT far GROUP BY node UNION ALL SELECT node, 1 FROM fa WHERE NOT far)"""


def clusters(spark, sf):
    return I.split_counts_of_texts(named_aligns(spark, sf))


@query("b10_split_counts", f"WITH RECURSIVE {CUTS} SELECT node, clusters FROM k")
def b10(spark, sf):
    return clusters(spark, sf)


@query("b11_split_shares", f"WITH RECURSIVE {CUTS} SELECT count(*) FILTER (clusters <= 2) * 100.0 / count(*) AS at_most_2, count(*) FILTER (clusters <= 3) * 100.0 / count(*) AS at_most_3, count(*) FILTER (clusters <= 4) * 100.0 / count(*) AS at_most_4 FROM k")
def b11(spark, sf):
    return I.split_shares(clusters(spark, sf))


@query("b12_bucket_coverage", """WITH al AS (SELECT l_suppkey AS contig, l_partkey AS node, (l_orderkey * 37) % 20000 AS a, (l_orderkey * 37) % 20000 + 300 + 2 * l_quantity::BIGINT AS b FROM lineitem),
v AS (SELECT contig, bucket, count(DISTINCT node) AS nodes FROM (SELECT contig, node, unnest(range(a // 128 + 1, (b - 1) // 128 + 1)) AS bucket FROM al) GROUP BY ALL)
SELECT contig, bucket, coalesce(nodes, 0) AS nodes FROM (SELECT s_suppkey AS contig, unnest(range(0, 189)) AS bucket FROM supplier) LEFT JOIN v USING (contig, bucket)""")
def b12(spark, sf):
    return I.bucket_coverage(*coverage_tables(spark, sf))


def coverage_tables(spark, sf):
    """Suppliers as contigs, their lines as alignments of parts."""
    start = (c("l_orderkey") * 37) % 20000
    al = table(spark, sf, "lineitem").select(c("l_suppkey").alias("contig"), c("l_partkey").alias("node"), start.alias("a_start"), (start + 300 + 2 * c("l_quantity").cast("bigint")).alias("a_end"))
    return table(spark, sf, "supplier").select(c("s_suppkey").alias("contig"), F.lit(24000).cast("bigint").alias("len")), al


@query("b13_layers", f"""WITH RECURSIVE {SESSIONS}, iv AS (SELECT min_by(a_start, place)::BIGINT AS start, (CASE WHEN session = sessions THEN max(top) ELSE max_by(a_end, place) END)::BIGINT AS "end" FROM ss GROUP BY node, session, sessions),
o AS (SELECT start, "end", row_number() OVER (ORDER BY start, "end") AS i FROM iv QUALIFY i <= 10),
g AS (SELECT 0::BIGINT AS i, 0::BIGINT AS start, 0::BIGINT AS "end", 0::BIGINT AS layer, [0::BIGINT] AS ends UNION ALL
  SELECT i, start, "end", layer, CASE WHEN layer < len(ends) THEN list_transform(ends, lambda x, j: CASE WHEN j = layer + 1 THEN "end" ELSE x END) ELSE list_append(ends, "end") END
  FROM (SELECT o.i, o.start, o."end", g.ends, coalesce(list_position(list_transform(g.ends, lambda x: x <= o.start - 1), true) - 1, len(g.ends))::BIGINT AS layer FROM g JOIN o ON o.i = g.i + 1))
SELECT start, "end", layer FROM g WHERE i > 0""")
def b13(spark, sf):
    return I.layers(I.transitive_intervals(aligns(spark, sf)))


@query("h1_hoco_map", f"""WITH {DNA_SQL}, r AS (SELECT rec_ix, length(seq) AS n, list_filter(range(1, length(seq) + 1), lambda i: i = 1 OR l[i] <> l[i - 1]) AS s FROM (SELECT rec_ix, seq, string_split(seq, '') AS l FROM dna WHERE seq <> ''))
SELECT rec_ix, len(s) AS runs, list_sum(s)::BIGINT - len(s) AS places, s[1 + len(s) // 2] - 1 AS middle FROM r""")
def h1(spark, sf):
    d = dna(spark, sf).filter("seq <> ''").select("rec_ix", "seq", I.run_starts(c("seq")).alias("s"))
    return d.select("rec_ix", F.size("s").cast("bigint").alias("runs"), F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("places"), I.to_raw(c("s"), F.floor(F.size("s") / 2).cast("int"), F.length("seq")).cast("bigint").alias("middle"))


@query("h1_chunked_places", ORACLES["h1_hoco_map"])
def h1_chunked(spark, sf):
    """The same over chunks of 97 letters: runs and places summed by chunk, the middle one looked up."""
    ch = C.chunked(dna(spark, sf).filter("seq <> ''"), 97, 1)
    found = C.runs(ch, 97)
    per = found[0].groupBy("rec_ix").agg(F.sum("n").alias("runs"), F.sum("places").alias("places"))
    raw = C.to_raw(per.withColumn("place", F.floor(c("runs") / 2)), found, C.lengths(ch), 97)
    return raw.select("rec_ix", "runs", "places", c("raw_place").alias("middle"))


@query("b9_reference_slices", f"""WITH {DNA_SQL}, al AS (SELECT l_orderkey AS node, l_linenumber::BIGINT * 100000000000000 + l_partkey * 1000000 + l_suppkey AS item, l_partkey % 200 AS rec_ix, (l_orderkey * 37) % 300 AS s, l_quantity > 25 AS fw FROM lineitem WHERE l_discount > 0.07),
x AS (SELECT node, item, CASE WHEN fw THEN t ELSE translate(t, 'ACGT', 'TGCA') END AS t FROM (SELECT node, item, fw, seq[s + 1:s + 40] AS t FROM al JOIN dna USING (rec_ix)))
SELECT a.node, a.item AS a, b.item AS b, levenshtein(a.t, b.t)::INT AS distance FROM x a JOIN x b ON a.node = b.node AND a.item < b.item""")
def b9_slices(spark, sf):
    """Orders as nodes; the lines of theirs that are much reduced are alignments on documents, of 40 letters each, of which the slices are cut from chunks of 97."""
    item = c("l_linenumber").cast("bigint") * 100000000000000 + c("l_partkey") * 1000000 + c("l_suppkey")
    start = (c("l_orderkey") * 37) % 300
    al = table(spark, sf, "lineitem").filter("l_discount > 0.07").select(c("l_orderkey").alias("node"), item.alias("item"), (c("l_partkey") % 200).alias("rec_ix"), start.alias("start"), (start + 40).alias("end"), (c("l_quantity") > 25).alias("forward"))
    return I.slice_distances(al, C.chunked(dna(spark, sf), 97, 1), 97)


@query("b12_coverage_stretches", """WITH al AS (SELECT l_suppkey AS contig, l_partkey AS node, (l_orderkey * 37) % 20000 AS a, (l_orderkey * 37) % 20000 + 300 + 2 * l_quantity::BIGINT AS b FROM lineitem),
v AS (SELECT contig, bucket, count(DISTINCT node) AS nodes FROM (SELECT contig, node, unnest(range(a // 128 + 1, (b - 1) // 128 + 1)) AS bucket FROM al) GROUP BY ALL),
e AS (SELECT contig, bucket, coalesce(nodes, 0) AS nodes FROM (SELECT s_suppkey AS contig, unnest(range(0, 189)) AS bucket FROM supplier) LEFT JOIN v USING (contig, bucket)),
g AS (SELECT *, sum((nodes IS DISTINCT FROM prev)::INT) OVER (PARTITION BY contig ORDER BY bucket) AS k FROM (SELECT *, lag(nodes) OVER (PARTITION BY contig ORDER BY bucket) AS prev FROM e))
SELECT contig, min(bucket) AS first, max(bucket) AS last, any_value(nodes) AS nodes FROM g GROUP BY contig, k""")
def b12_stretches(spark, sf):
    contigs_, al = coverage_tables(spark, sf)
    return I.coverage_stretches(contigs_, al)
