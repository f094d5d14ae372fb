"""Report and configuration operators on the order tables, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork import session
from braidwork.functions import seq as S
from braidwork.operators import reports as P
from braidwork.plans.registry import query, table
from braidwork.sources.formats import read_labelled_xy

c = F.col


@query("r2_argument_matrix", "SELECT r_name, p AS priority, f AS flag FROM region, (VALUES ('high'), ('low')) p(p), (VALUES ('A'), ('N'), ('R')) f(f)")
def r2(spark, sf):
    """The regions, a fixed table, by two options: a matrix of nested lists, expanded."""
    regions = [r[0] for r in table(spark, sf, "region").select("r_name").collect()]
    m = P.matrix_rows(spark, {"region": regions, "priority": ["high", ["low"]], "flag": ["A", ["N", "R"]]})
    return m.select(c("arguments")["region"].alias("r_name"), c("arguments")["priority"].alias("priority"), c("arguments")["flag"].alias("flag"))


@query("r5_defaults", "SELECT event_id, coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE event_type END, 'none') AS kind, coalesce(CASE WHEN value < 10 THEN NULL ELSE value END, 10.0) AS value FROM events")
def r5(spark, sf):
    return table(spark, sf, "events").select("event_id", F.coalesce(F.when(c("event_type") != "error", c("event_type")), F.lit("none")).alias("kind"), F.coalesce(F.when(c("value") >= 10, c("value")), F.lit(10.0)).alias("value"))


@query("r6_experiments_join", "SELECT c_nationkey * 10 + c_custkey % 10 AS \"column\", s_suppkey AS experiment FROM (SELECT DISTINCT c_nationkey, c_custkey % 10 AS c_custkey FROM customer) JOIN supplier ON s_nationkey = c_nationkey AND s_suppkey % 10 = c_custkey % 10")
def r6(spark, sf):
    """Columns by nation and last digit, experiments with the same arguments in another order."""
    cu, su = table(spark, sf, "customer"), table(spark, sf, "supplier")
    entry = lambda k, v: (F.lit(k), v.cast("string"))
    columns = cu.select("c_nationkey", (c("c_custkey") % 10).alias("d")).distinct()
    columns = columns.select((c("c_nationkey") * 10 + c("d")).alias("column"), F.create_map(*entry("nation", c("c_nationkey")), *entry("digit", c("d"))).alias("arguments"))
    runs = su.select(c("s_suppkey").alias("experiment"), F.create_map(*entry("digit", c("s_suppkey") % 10), *entry("nation", c("s_nationkey"))).alias("arguments"))
    return P.columns_of_experiments(columns, runs)


@query("r7_merge_metrics", """WITH n AS (SELECT n_regionkey AS report, n_nationkey AS k, 'n' || n_nationkey AS key, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey)::VARCHAR AS a,
  (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey)::VARCHAR AS b FROM nation)
SELECT report, row_number() OVER (PARTITION BY report ORDER BY k) - 1 AS ord, key, CASE WHEN k % 3 = 0 THEN '' ELSE a END || '|' || b || '|' || CASE WHEN k % 5 = 1 THEN 'N/A' ELSE a END AS line FROM n""")
def r7(spark, sf):
    """Three tables a region: the first lacks some nations, the third others."""
    nation = table(spark, sf, "nation")
    count = lambda t, key: table(spark, sf, t).groupBy(c(key).alias("n_nationkey")).agg(F.count("*").alias("n"))
    metrics = lambda df: nation.join(df, "n_nationkey", "left").select(c("n_regionkey").alias("report"), c("n_nationkey").alias("ord"), F.concat(F.lit("n"), "n_nationkey").alias("key"), F.coalesce("n", F.lit(0)).cast("string").alias("value"))
    a, b = metrics(count("customer", "c_nationkey")), metrics(count("supplier", "s_nationkey"))
    merged = P.merge_metrics([a.filter("ord % 3 <> 0"), b, a.filter("ord % 5 <> 1")])
    return merged.select("report", "ord", "key", F.array_join("values", "|").alias("line"))


@query("r8_number_format", """SELECT o_orderkey, format('{:t,}', (o_orderkey * 7919)::BIGINT) AS whole, format('{:,.2f}', o_totalprice) AS price, o_orderpriority AS raw FROM orders""".replace("{:t,}", "{:,}"))
def r8(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", S.formatted((c("o_orderkey") * 7919).cast("string")).alias("whole"), S.formatted(F.format_string("%.2f", c("o_totalprice"))).alias("price"), S.formatted(c("o_orderpriority")).alias("raw"))


@query("r9_sections", "SELECT CASE WHEN p_size < 7 THEN 0 WHEN p_size < 13 THEN 1 WHEN p_size < 30 THEN 2 ELSE 3 END AS section, count(*) AS n FROM part GROUP BY 1")
def r9(spark, sf):
    return table(spark, sf, "part").groupBy(P.section(c("p_size")).alias("section")).agg(F.count("*").alias("n"))


@query("r10_r28_resources", "SELECT coalesce(o_orderpriority, 'total') AS step, sum(o_orderkey % 1000)::BIGINT AS time, max(o_custkey) AS mem FROM orders GROUP BY ROLLUP (o_orderpriority)")
def r10(spark, sf):
    return P.resources(table(spark, sf, "orders").select(c("o_orderpriority").alias("step"), (c("o_orderkey") % 1000).alias("time"), c("o_custkey").alias("mem")))


@query("r11_elapsed", "SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE AS long, (minute(ts) * 60 + second(ts))::DOUBLE AS short FROM events")
def r11(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", S.elapsed_seconds(F.date_format("ts", "H:mm:ss")).alias("long"), S.elapsed_seconds(F.date_format("ts", "m:ss")).alias("short"))


@query("r12_gibibytes", "SELECT o_orderkey, round((o_orderkey * 1037) / 1048576, 2) AS gib FROM orders")
def r12(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", P.gibibytes(c("o_orderkey") * 1037).alias("gib"))


@query("r14_last_metric", """WITH w AS (SELECT user_id AS source, event_id AS ord, event_type, value, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS header FROM events)
SELECT source, max_by(header, ord)::VARCHAR AS header, max_by(value, ord)::VARCHAR AS value FROM w WHERE event_type = 'purchase' GROUP BY source""")
def r14(spark, sf):
    kind = F.when(c("event_type") == "view", "header").when(c("event_type") == "purchase", "value").otherwise("other")
    return P.last_metric(table(spark, sf, "events").select(c("user_id").alias("source"), c("event_id").alias("ord"), kind.alias("kind"), c("value").cast("string").alias("text")))


@query("r15_metric_pairs", """WITH v AS (SELECT l_orderkey AS source, l_returnflag AS key, max_by(l_quantity::BIGINT::VARCHAR, l_linenumber * 1000000 + l_partkey) AS value FROM lineitem GROUP BY ALL),
q AS (SELECT source, title, x, y FROM (SELECT DISTINCT source FROM v), (VALUES ('A/R', 'A', 'R'), ('N/A', 'N', 'A')) g(title, x, y))
SELECT q.source, title, coalesce(a.value, 'N/A') || '/' || coalesce(b.value, 'N/A') AS value FROM q LEFT JOIN v a ON a.source = q.source AND a.key = x LEFT JOIN v b ON b.source = q.source AND b.key = y""")
def r15(spark, sf):
    """Of lines at the same place, the one that stands first counts: in the first file by name, and there in the first row."""
    first = F.struct(-(c("l_linenumber") * 1000000 + c("l_partkey")).alias("place"), c("_metadata.file_path"), c("_metadata.row_index"))
    lines = table(spark, sf, "lineitem").select(c("l_orderkey").alias("source"), c("l_returnflag").alias("key"), first.alias("first"), c("l_quantity").cast("bigint").cast("string").alias("value"))
    rows = lines.groupBy("source", "key").agg(F.min_by("value", "first").alias("value"), F.lit(0).alias("ord"))
    return P.metric_pairs(rows, [("A", "R"), ("N", "A")])


@query("r16_s20_labelled_union", "SELECT 'orders' AS label, o_orderkey::DOUBLE AS x, o_totalprice AS y FROM orders UNION ALL SELECT 'parts', p_partkey, p_retailprice FROM part")
def r16(spark, sf):
    """Both tables as headerless CSV files, read back with their labels."""
    at = {"orders": session.scratch_path(spark, "csv"), "parts": session.scratch_path(spark, "csv")}
    table(spark, sf, "orders").select("o_orderkey", "o_totalprice").write.csv(at["orders"])
    table(spark, sf, "part").select("p_partkey", "p_retailprice").write.csv(at["parts"])
    return read_labelled_xy(spark, at)


#: The logs of a run for each part: five times the nodes is the optimum of even parts; preprocessing solves every eleventh odd one; every seventh part lacks a value, and in every thirteenth the graphs disagree.
RUNS = """r AS (SELECT p_partkey AS run, p_size AS n, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 3 END AS more, p_retailprice AS t FROM part),
h AS (SELECT run, CASE WHEN run % 7 = 0 THEN 'missing raw_time' WHEN run % 13 = 0 THEN 'raw and preprocessed graph disagree' END AS error, n AS raw_nodes, 5 * n + more AS raw_optimum, CASE WHEN run % 7 <> 0 THEN round(t, 2) END AS raw_time,
  run % 2 = 1 AND run % 11 = 0 AS solved, CASE WHEN NOT (run % 2 = 1 AND run % 11 = 0) THEN (run % 50)::DOUBLE END AS removed_nodes, CASE WHEN NOT (run % 2 = 1 AND run % 11 = 0) THEN (run % 30)::DOUBLE END AS removed_arcs,
  (n + 5)::DOUBLE AS safe_walks, (n + 2)::DOUBLE AS long_safe_walks, n::DOUBLE AS non_trivial_safe_walks, round(t / 10, 2) AS preprocessing_time, round(t / 2, 2) AS preprocessed_time, more = 0 AS ham FROM r)"""


def run_logs(spark, sf):
    k, n = c("p_partkey"), c("p_size")
    more = F.when(k % 2 == 0, 0).otherwise(3)
    solved = (k % 2 == 1) & (k % 11 == 0)
    two = lambda x: F.format_string("%.2f", F.round(x, 2))
    t = c("p_retailprice")
    line = lambda log, *parts: F.struct(F.lit(log).alias("log"), F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)).alias("line"))
    lines = F.array(
        line("preprocess", "[INFO] Preprocessing took ", two(t / 10), " seconds"),
        F.when(~solved, line("preprocess", "[INFO] Preprocessing removed ", k % 50, ".0% of nodes and ", k % 30, ".0% of arcs")),
        F.when(solved, line("preprocess", "[WARN] Preprocessing the graph revealed that it is not hamiltonian")),
        line("preprocess", "Found ", n + 5, " safe walks"),
        line("preprocess", "Found ", n + 2, " safe walks of length > 2"),
        line("preprocess", "Found ", n, " non-trivial safe walks"),
        line("raw", "Number of Nodes: ", n),
        line("raw", "Optimal Solution: ", 5 * n + more, ".00"),
        F.when(k % 7 != 0, line("raw", "Total Running Time: ", two(t), " (seconds)")),
        line("preprocessed", "Number of Nodes: ", n),
        line("preprocessed", "Optimal Solution: ", 5 * n + F.when(k % 13 == 0, 3 - more).otherwise(more), ".00"),
        line("preprocessed", "Total Running Time: ", two(t / 2), " (seconds)"),
    )
    return table(spark, sf, "part").select(k.alias("run"), F.posexplode(lines).alias("ord", "l")).filter("l IS NOT NULL").select("run", "ord", "l.log", "l.line")


@query("r17_hamiltonian_report", f"WITH {RUNS} SELECT run, error, raw_nodes::BIGINT AS raw_nodes, raw_optimum::BIGINT AS raw_optimum, raw_time, solved, removed_nodes, removed_arcs, CASE WHEN error IS NULL THEN ham END AS hamiltonian FROM h")
def r17(spark, sf):
    return P.hamiltonian_report(run_logs(spark, sf), strict=False).select("run", "error", "raw_nodes", "raw_optimum", "raw_time", "solved", "removed_nodes", "removed_arcs", "hamiltonian")


@query("r18_hamiltonian_averages", f"""WITH {RUNS}, g AS (SELECT * FROM h WHERE error IS NULL)
SELECT count(*) AS runs, round(avg(ham::INT) * 100, 6) AS hamiltonian, round(avg(preprocessing_time), 6) AS preprocessing_time, round(avg(preprocessed_time), 6) AS preprocessed_time, round(avg(preprocessing_time + preprocessed_time), 6) AS preprocessed_total_time,
  round(avg(raw_time), 6) AS raw_time, round(avg(solved::INT) * 100, 6) AS solved, round(sum(removed_nodes) / count(*) FILTER (NOT solved), 6) AS removed_nodes, round(sum(removed_arcs) / count(*) FILTER (NOT solved), 6) AS removed_arcs,
  round(avg(safe_walks - long_safe_walks), 6) AS strong_bridges, round(avg(long_safe_walks - non_trivial_safe_walks), 6) AS trivial_safe_walks, round(avg(non_trivial_safe_walks), 6) AS non_trivial_safe_walks FROM g""")
def r18(spark, sf):
    """Over the runs without an error."""
    one = P.hamiltonian_averages(P.hamiltonian_report(run_logs(spark, sf), strict=False).filter("error IS NULL"))
    return one.select("runs", *(F.round(x, 6).alias(x) for x in one.columns if x != "runs"))


@query("r13_resource_inputs", """WITH o AS (SELECT o_orderkey AS run, CASE o_orderkey % 3 WHEN 0 THEN 'wtdbg2' WHEN 1 THEN 'hifiasm' ELSE 'flye' END AS a, o_orderstatus = 'F' AS tig, o_orderkey % 5 = 0 AS hod FROM orders)
SELECT run, step FROM o, (VALUES ('hoco'), ('hodeco'), ('trivial_omnitigs'), ('assembly'), ('wtdbg2_extract'), ('contig_assembly'), ('wtdbg2_consensus')) s(step)
WHERE step = 'assembly' OR a = 'wtdbg2' AND (step IN ('wtdbg2_extract', 'wtdbg2_consensus') OR tig AND step IN ('trivial_omnitigs', 'contig_assembly') OR hod AND step IN ('hoco', 'hodeco')) OR a = 'hifiasm' AND tig AND step = 'trivial_omnitigs'""")
def r13(spark, sf):
    k, injected = c("o_orderkey"), c("o_orderstatus") == "F"
    runs = table(spark, sf, "orders").select(k.alias("run"), F.when(k % 3 == 0, "wtdbg2").when(k % 3 == 1, "hifiasm").otherwise("flye").alias("assembler"), F.when(injected, "unitigs").otherwise("none").alias("tig"), F.lit(None).cast("string").alias("frg"), F.when(k % 5 == 0, "simple").otherwise("none").alias("hodeco"), F.when(injected, "trivial_omnitigs_a").otherwise("builtin").alias("contigs"))
    return P.resource_inputs(runs)


@query("r19_superfluous_files", """WITH f AS (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS path FROM pages), q AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM f WHERE contains(path, '/en/'))
SELECT path FROM f WHERE NOT EXISTS (SELECT 1 FROM q WHERE starts_with(f.path, q.folder))""")
def r19(spark, sf):
    f = table(spark, sf, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("path")).distinct()
    return P.superfluous(f, f.filter(c("path").contains("/en/")))


@query("r20_unsuccessful_logs", "SELECT user_id || '' AS path FROM events WHERE contains(user_id || '', '1') GROUP BY user_id HAVING NOT bool_or(event_type = 'signup' AND value > 90)")
def r20(spark, sf):
    line = F.when((c("event_type") == "signup") & (c("value") > 90), "1 of 1 steps (100%) done").otherwise(c("event_type"))
    return P.unsuccessful(table(spark, sf, "events").select(c("user_id").cast("string").alias("path"), line.alias("line")), tag="1")


@query("r21_unfinished_outputs", """WITH w AS (SELECT user_id, event_id, event_type, value, min(event_id) FILTER (event_type = 'view') OVER p AS s1, bool_or(event_type = 'signup' AND value > 90) OVER p AS done FROM events WHERE contains(user_id || '', '1') WINDOW p AS (PARTITION BY user_id)),
x AS (SELECT *, min(event_id) FILTER (event_type = 'click' AND event_id >= s1) OVER (PARTITION BY user_id) AS s2 FROM w), y AS (SELECT *, min(event_id) FILTER (event_type = 'error' AND event_id >= s2) OVER (PARTITION BY user_id) AS s3 FROM x),
z AS (SELECT user_id || '' AS path, unnest(['a/out' || event_id || '/f', 'log' || event_id]) AS output FROM y WHERE NOT done AND s3 IS NOT NULL AND event_id = s2)
SELECT path, output, regexp_extract(output, '^(.*)/[^/]*$', 1) AS folder FROM z""")
def r21(spark, sf):
    e, i = c("event_type"), c("event_id").cast("string")
    line = F.when((e == "signup") & (c("value") > 90), "1 of 1 steps (100%) done").when(e == "view", "Select jobs to execute...").when(e == "click", F.concat(F.lit("output: a/out"), i, F.lit("/f, log"), i)).when(e == "error", "jobid: 3").otherwise("x")
    return P.unfinished_outputs(table(spark, sf, "events").select(c("user_id").cast("string").alias("path"), c("event_id").alias("ord"), line.alias("line")), tag="1")


@query("r22_job_status", """SELECT o_custkey AS job, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'success' WHEN bool_or(o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') THEN 'running'
  WHEN bool_and(o_orderstatus = 'O') THEN 'failed' ELSE 'error' END AS status FROM orders GROUP BY o_custkey""")
def r22(spark, sf):
    s, p = c("o_orderstatus"), c("o_orderpriority")
    state = F.when(s == "F", "COMPLETED").when((s == "P") & (p == "1-URGENT"), "RUNNING").when(s == "O", "FAILED").otherwise("UNKNOWN")
    return P.job_status(table(spark, sf, "orders").select(c("o_custkey").alias("job"), state.alias("state")))


@query("r25_r26_genomes_of_report", "SELECT DISTINCT source FROM documents WHERE starts_with(source, 'src1')")
def r25(spark, sf):
    return table(spark, sf, "documents").filter(c("source").startswith("src1")).select("source").distinct()


@query("r27_log_extraction", "SELECT user_id || '' AS path, event_id AS ord, event_id % 7 || '' AS coverage FROM events WHERE event_type = 'click'")
def r27(spark, sf):
    """Events as lines of a log for each user; clicks set the edge coverage."""
    e = table(spark, sf, "events")
    line = F.when(c("event_type") == "click", F.concat(F.lit("[note] Set --edge-cov to "), (c("event_id") % 7).cast("string"))).otherwise(F.concat(F.lit("--edge-cov is "), (c("event_id") % 7).cast("string")))
    return P.edge_coverage(e.select(c("user_id").cast("string").alias("path"), c("event_id").alias("ord"), line.alias("line")))


@query("s7_canonical_links", """WITH t AS (SELECT l_orderkey, 'L:' || CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END || ':' || l_partkey || ':' || CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END AS link,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS a, l_partkey AS b, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS d FROM lineitem)
SELECT l_orderkey, string_agg(link, ' ' ORDER BY a, b, d) AS links FROM t GROUP BY l_orderkey""")
def s7(spark, sf):
    from braidwork.sources.formats import canonical_links

    link = F.concat_ws(":", F.lit("L"), F.when(c("l_returnflag") == "R", "-").otherwise("+"), "l_partkey", F.when(c("l_linestatus") == "F", "-").otherwise("+"))
    t = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(link).alias("l"))
    return t.select("l_orderkey", F.array_join(canonical_links(c("l")), " ").alias("links"))


@query("s21_resource_json", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def s21(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("s30_plot_data", "SELECT event_type, floor(value / 10)::BIGINT AS bin, count(*) AS n FROM events GROUP BY ALL")
def s30(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.floor(c("value") / 10).alias("bin")).agg(F.count("*").alias("n"))
