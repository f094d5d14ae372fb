"""Readers of text formats: the driver's tables written in a format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork import session
from braidwork.plans.registry import DNA_SQL, dna, query, table
from braidwork.sources import formats as S

c = F.col


def written(spark, lines, label, *parts):
    """The path of a new text with these lines (value)."""
    at = session.scratch_path(spark, label)
    (lines.write.partitionBy(*parts) if parts else lines.write).text(at)
    return at


@query("s3_fastq", f"WITH {DNA_SQL} SELECT id, seq FROM dna WHERE seq <> ''")
def s3(spark, sf):
    d = dna(spark, sf).filter("seq <> ''")
    four = F.array(F.concat(F.lit("@"), "id", F.lit(" "), "desc"), c("seq"), F.lit("+"), F.regexp_replace("seq", ".", "I"))
    return S.fastq_to_fasta(d.select("rec_ix", F.posexplode(four).alias("k", "value")).select((4 * c("rec_ix") + c("k")).alias("ix"), "value")).select("id", "seq")


@query("s9_s10_gfa", """SELECT c_custkey::VARCHAR AS src, CASE WHEN c_nationkey % 3 > 0 THEN '+' ELSE '-' END AS own, (c_custkey * 31 + c_nationkey)::VARCHAR AS dst, CASE WHEN c_nationkey % 2 > 0 THEN '+' ELSE '-' END AS other, c_nationkey % 4 AS overlap,
  translate(lower(c_mktsegment), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM customer""")
def s9(spark, sf):
    """Customers as segments with a link each."""
    sign = lambda x: F.when(x, "+").otherwise("-")
    name = c("c_custkey").cast("string")
    segment = F.concat_ws("\t", F.lit("S"), name, F.translate(F.lower("c_mktsegment"), "abcdefghijklmnopqrstuvwxyz", "ACGT" * 6 + "AC"))
    link = F.concat_ws("\t", F.lit("L"), name, sign(c("c_nationkey") % 3 > 0), (c("c_custkey") * 31 + c("c_nationkey")).cast("string"), sign(c("c_nationkey") % 2 > 0), F.concat((c("c_nationkey") % 4).cast("string"), F.lit("M")))
    at = written(spark, table(spark, sf, "customer").select(F.concat_ws("\n", F.lit("H\tVN:Z:1.0"), segment, link).alias("value")), "gfa")
    segments, links = S.read_gfa(spark, at)
    return links.join(segments.select(c("name").alias("src"), "seq"), "src")


@query("s27_gfa_to_fasta", "SELECT s_suppkey::VARCHAR AS id, s_name AS seq FROM supplier UNION ALL SELECT p_partkey::VARCHAR, p_brand FROM part")
def s27(spark, sf):
    """Two files of segments, one after the other."""
    line = lambda df, key, seq: df.select(F.concat_ws("\t", F.lit("S"), c(key).cast("string"), seq).alias("value"))
    paths = [written(spark, line(table(spark, sf, "supplier"), "s_suppkey", "s_name"), "gfa"), written(spark, line(table(spark, sf, "part"), "p_partkey", "p_brand"), "gfa")]
    return S.gfa_to_fasta(spark, paths)


@query("s11_dot", "SELECT 'N' || l_orderkey AS src, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS own, 'N' || l_partkey AS dst, CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END AS other FROM lineitem")
def s11(spark, sf):
    """Lines of orders as arrows to parts."""
    sign = lambda x: F.when(x, "-").otherwise("+")
    arrow = F.concat(F.lit("N"), "l_orderkey", F.lit(" -> N"), "l_partkey", F.lit(' [label="'), sign(c("l_returnflag") == "R"), sign(c("l_linestatus") == "F"), F.lit('"]'))
    return S.read_dot(spark, written(spark, table(spark, sf, "lineitem").select(arrow.alias("value")), "dot"))


@query("s17_paf", """SELECT 'q' || l_orderkey AS qname, 3000::BIGINT AS qlen, l_suppkey % 25 AS qstart, (3000 - l_suppkey % 21)::BIGINT AS qend, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, 't' || l_partkey AS tname, 24000::BIGINT AS tlen,
  (l_orderkey * 37) % 20000 AS tstart, (l_orderkey * 37) % 20000 + 1000 AS tend, 900::BIGINT AS matches, 1000::BIGINT AS block, 60 AS mapq, 'tp:A:P,cm:i:' || l_linenumber AS tags FROM lineitem""")
def s17(spark, sf):
    """Lines of orders as alignments on parts."""
    start = (c("l_orderkey") * 37) % 20000
    fields = [F.concat(F.lit("q"), "l_orderkey"), F.lit(3000), c("l_suppkey") % 25, 3000 - c("l_suppkey") % 21, F.when(c("l_returnflag") == "R", "-").otherwise("+"), F.concat(F.lit("t"), "l_partkey"), F.lit(24000), start, start + 1000, F.lit(900), F.lit(1000), F.lit(60), F.lit("tp:A:P"), F.concat(F.lit("cm:i:"), "l_linenumber")]
    at = written(spark, table(spark, sf, "lineitem").select(F.concat_ws("\t", *(x.cast("string") for x in fields)).alias("value")), "paf")
    return S.read_paf(spark, at).withColumn("tags", F.array_join("tags", ","))


@query("s23_time_logs", """SELECT o_orderpriority[1:1] AS job, sum(60 * (o_orderkey % 90) + o_custkey % 60)::DOUBLE AS time, max(o_totalprice::BIGINT) AS mem FROM orders GROUP BY 1""")
def s23(spark, sf):
    """Orders as runs of the jobs of their priorities."""
    clock = F.concat((c("o_orderkey") % 90).cast("string"), F.lit(":"), F.lpad((c("o_custkey") % 60).cast("string"), 2, "0"))
    report = F.concat(F.lit("\tElapsed (wall clock) time (h:mm:ss or m:ss): "), clock, F.lit("\n\tMaximum resident set size (kbytes): "), F.round("o_totalprice").cast("bigint").cast("string"))
    at = written(spark, table(spark, sf, "orders").select(F.substring("o_orderpriority", 1, 1).alias("job"), report.alias("value")), "logs", "job")
    found = S.time_log(S.read_logs(spark, at))
    return found.groupBy(F.regexp_extract("path", "job=([^/]*)/", 1).alias("job")).agg(F.sum("time").alias("time"), F.max("mem").alias("mem"))


UNITIGS = """un AS (SELECT o_orderkey AS unitig, translate(lower(o_orderpriority), 'abcdefghijklmnopqrstuvwxyz -1234567890', 'ACGTACGTACGTACGTACGTACGTACACGTACGTACGT') AS seq FROM orders),
li AS (SELECT DISTINCT l_orderkey AS unitig, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS own, l_partkey AS target, CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END AS other FROM lineitem)"""


def compacted(spark, sf):
    """Orders as unitigs, their lines as links, written and read back."""
    link = F.struct(F.when(c("l_returnflag") == "R", "-").otherwise("+").alias("own"), c("l_partkey").alias("target"), F.when(c("l_linestatus") == "F", "-").otherwise("+").alias("other"))
    links = table(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("unitig")).agg(F.collect_set(link).alias("links"))
    seq = F.translate(F.lower("o_orderpriority"), "abcdefghijklmnopqrstuvwxyz -1234567890", "ACGT" * 6 + "AC" + "ACGTACGTACGT")
    unitigs = table(spark, sf, "orders").select(c("o_orderkey").alias("unitig"), seq.alias("seq")).join(links, "unitig", "left")
    at = session.scratch_path(spark, "compacted")
    S.write_compacted(unitigs.withColumn("links", F.coalesce("links", F.array().cast(unitigs.schema["links"].dataType))), at)
    return S.read_compacted(spark, at)


@query("s4_compacted", f"WITH {UNITIGS} SELECT unitig, seq, count(own) AS n_links FROM un LEFT JOIN li USING (unitig) GROUP BY unitig, seq")
def s4(spark, sf):
    return compacted(spark, sf).select("unitig", "seq", F.size("links").cast("bigint").alias("n_links"))


@query("s5_edge_centric", f"""WITH {UNITIGS}, b AS (SELECT unitig, true AS forward, seq AS s FROM un UNION ALL SELECT unitig, false, reverse(translate(seq, 'ACGT', 'TGCA')) FROM un)
SELECT 2 * unitig + CASE WHEN forward THEN 0 ELSE 1 END AS edge, s[1:3] AS src, s[-3:] AS dst, 2 * unitig + CASE WHEN forward THEN 1 ELSE 0 END AS mirror, unitig, forward, s AS seq FROM b""")
def s5(spark, sf):
    return S.edge_centric(compacted(spark, sf), 4)


@query("s6_node_centric", f"""WITH {UNITIGS}, a AS (SELECT 2 * unitig + (own = '-')::INT AS src, 2 * target + (other = '-')::INT AS dst FROM li)
SELECT src, dst FROM a UNION SELECT xor(dst, 1), xor(src, 1) FROM a""")
def s6(spark, sf):
    return S.node_centric(compacted(spark, sf))[1]
