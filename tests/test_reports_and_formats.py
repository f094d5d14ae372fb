import pytest
from pyspark.sql import functions as F

from braidwork.operators import reports as P
from braidwork.sources import formats as S


def test_argument_trees():
    assert P.merge_arguments({"a": None, "b": {"x": 1, "y": 2}}, {"a": 3, "b": "y"}) == {"a": 3, "b": {"y": 2}}
    with pytest.raises(ValueError):
        P.merge_arguments({"b": {"x": 1}}, {"b": "z"})
    got = P.expand_matrix({"k": [1, 2], "m": {"p": [3, {"q": 4}]}})
    assert len(got) == 4 and {"k": 2, "m": {"p": {"q": 4}}} in got
    args = {"--a": None, "--b": True, "--c": False, "-d": 5}
    assert P.argument_string(args) == "--a --b -d 5"
    long = {"x": "y" * 700}
    assert P.argument_of(P.argument_name(long)) == long and "/_/" in P.argument_name(long)
    assert P.format_partial("{a}/{b}", a=1) == "1/{b}"
    assert P.numeric_argument(["x", "a 12"]) == "12"
    with pytest.raises(ValueError):
        P.numeric_argument(["1", "2"])


def test_more_of_the_matrix(spark):
    m = {"k": [1, {"one": None}], "m": ["a", "b", ["c"]]}
    assert {"k": "one", "m": "c"} in P.expand_matrix(m) and len(P.expand_matrix(m)) == P.matrix_size(m) == 6
    got = [r.arguments for r in P.matrix_rows(spark, {"k": [1, 2], "f": None}).orderBy("ix").collect()]
    assert got == [{"k": "1", "f": None}, {"k": "2", "f": None}]
    assert P.format_product("{a}-{b}-{c}", a=[1, 2], b="x") == ["1-x-{c}", "2-x-{c}"]
    assert P.short_name({"wtdbg2": {"mode": "a b", "-x": True, "no": False}}) == "ab_-x"
    assert P.evaluation_arguments("normal_hoco") == "--fragmented --minimap-hoco"
    with pytest.raises(ValueError):
        P.evaluation_arguments("other")
    cols = spark.createDataFrame([("c1", {"a": "1", "b": "2"}), ("c2", {"a": "2"})], "column string, arguments map<string,string>")
    runs = spark.createDataFrame([(1, {"b": "2", "a": "1"}), (2, {"b": "2"})], "experiment int, arguments map<string,string>")
    assert [tuple(r) for r in P.columns_of_experiments(cols, runs).collect()] == [("c1", 1)]


def metrics(spark, *keys):
    return spark.createDataFrame([(1, i, k, f"{k}{len(keys)}") for i, k in enumerate(keys)], "report int, ord int, key string, value string")


def merged(spark, *tables):
    return [(r.key, r["values"]) for r in P.merge_metrics([metrics(spark, *t) for t in tables]).orderBy("ord").collect()]


def test_merge_metrics(spark):
    assert merged(spark, "ab", "ab") == [("a", ["a2", "a2"]), ("b", ["b2", "b2"])]
    # what only the second has stands where it stands there, with blanks; what it lacks is N/A
    assert merged(spark, "ac", "abcd") == [("a", ["a2", "a4"]), ("b", ["", "b4"]), ("c", ["c2", "c4"]), ("d", ["", "d4"])]
    assert merged(spark, "xab", "b") == [("x", ["x3", "N/A"]), ("a", ["a3", "N/A"]), ("b", ["b3", "b1"])]
    assert merged(spark, "a", "ab", "b") == [("a", ["a1", "a2", "N/A"]), ("b", ["", "b2", "b1"])]
    for tables in (("a", "b"), ("axb", "ayb"), ("ab", "ba")):
        with pytest.raises(Exception, match="mismatching keys|another order"):
            merged(spark, *tables)


def test_superfluous_files(spark):
    of = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
    files = of("a/b/c", "a/bc/d", "x/y", "a", "", "a/b/c")
    assert sorted(r.path for r in P.superfluous(files, of("a/b/q", "")).collect()) == ["a", "x/y"]
    assert P.superfluous(files, of("bare")).count() == 0
    assert P.superfluous(files, of()).count() == 4
    folders = of("/f", "f", "a//f", "a/b/").select(P.folder_of(F.col("path"))).collect()
    assert [r[0] for r in folders] == ["/", "", "a", "a/b"]


def test_logs(spark):
    rows = [("p1", 0, "Select jobs to execute..."), ("p1", 1, " output: a/b/x, y"), ("p1", 2, "jobid: 3"), ("p2", 0, "Select jobs to execute..."), ("p2", 1, "output: z"), ("p2", 2, "jobid: 1"), ("p2", 3, "1 of 1 steps (100%) done"), ("q", 0, "output: w"), ("q", 1, "Set --edge-cov to 4")]
    lines = spark.createDataFrame(rows, "path string, ord int, line string")
    assert sorted(map(tuple, P.unfinished_outputs(lines).collect())) == [("p1", "a/b/x", "a/b"), ("p1", "y", "")]
    assert P.unfinished_outputs(lines, "q").count() == 0
    assert sorted(r.path for r in P.unsuccessful(lines).collect()) == ["p1", "q"]
    assert [r.path for r in P.unsuccessful(lines, tag="p").collect()] == ["p1"]
    assert [tuple(r) for r in P.edge_coverage(lines).collect()] == [("q", 1, "4")]


def test_hamiltonian_reports(spark):
    whole = [("preprocess", "Preprocessing took 2.5 seconds"), ("preprocess", "Preprocessing removed 10.0% of nodes and 5.5% of edges"), ("preprocess", "Found 7 safe walks"), ("preprocess", "Found 4 safe walks of length > 2"), ("preprocess", "Found 1 non-trivial safe walks"),
             ("raw", "Number of Nodes: 4"), ("raw", "Optimal Solution: 20.00"), ("raw", "Total Running Time: 3.0 (seconds)"), ("preprocessed", "Number of Nodes: 3"), ("preprocessed", "Optimal Solution: 15.00"), ("preprocessed", "Total Running Time: 1.5 (seconds)")]
    table = lambda runs: spark.createDataFrame([(k, i, *x) for k, lines in runs.items() for i, x in enumerate(lines)], "run int, ord int, log string, line string")
    r = P.hamiltonian_report(table({1: whole})).first()
    assert r.hamiltonian and (r.raw_nodes, r.raw_optimum, r.removed_nodes, r.removed_arcs, r.safe_walks, r.long_safe_walks, r.non_trivial_safe_walks) == (4, 20, 10.0, 5.5, 7.0, 4.0, 1.0)
    other = [("preprocessed", "Optimal Solution: 16.00") if "15.00" in x[1] else x for x in whole]
    for lines in (whole[1:], other):
        with pytest.raises(Exception, match="run 1"):
            P.hamiltonian_report(table({1: lines})).collect()
    solved = [("preprocess", "Preprocessing the graph revealed that it is not hamiltonian"), ("raw", "Optimal Solution: 21")]
    two = table({1: whole, 2: [x for x in whole if "removed" not in x[1] and "Optimal" not in x[1]] + solved + [("preprocessed", "Optimal Solution: 17")]})
    a = P.hamiltonian_averages(P.hamiltonian_report(two)).first()
    assert (a.runs, a.hamiltonian, a.solved, a.removed_nodes, a.preprocessed_total_time, a.strong_bridges, a.trivial_safe_walks) == (2, 50.0, 50.0, 10.0, 4.0, 3.0, 3.0)


def test_job_status(spark):
    rows = [(1, "COMPLETED"), (2, "COMPLETED"), (2, "PENDING"), (3, "FAILED"), (3, "TIMEOUT"), (4, "FAILED"), (4, "COMPLETED")]
    got = P.job_status(spark.createDataFrame(rows, "job int, state string")).collect()
    assert {r.job: r.status for r in got} == {1: "success", 2: "running", 3: "failed", 4: "error"}


def test_fasta_round_trip(spark, tmp_path):
    rows = [("a", "d e", "ACGT"), ("b", None, "GG")]
    df = spark.createDataFrame(rows, "id string, desc string, seq string")
    S.write_fasta(df.coalesce(1), str(tmp_path / "f"))
    got = S.read_fasta(spark, str(tmp_path / "f")).orderBy("rec_ix").collect()
    assert [(r.id, r.desc, r.seq) for r in got] == rows
    (tmp_path / "m.fa").write_text(">x y z\nAC\nGT\n>w\nA\n")
    assert [(r.id, r.desc, r.seq) for r in S.read_fasta(spark, str(tmp_path / "m.fa")).orderBy("rec_ix").collect()] == [("x", "y z", "ACGT"), ("w", None, "A")]
    (tmp_path / "d.fa").write_text(">s1 kinase a->b\nAC\n>s2 >x\nGG\n")
    assert [(r.rec_ix, r.id, r.desc, r.seq) for r in S.read_fasta(spark, str(tmp_path / "d.fa")).orderBy("rec_ix").collect()] == [(0, "s1", "kinase a->b", "AC"), (1, "s2", ">x", "GG")]
    (tmp_path / "o.fa").write_text("AC\n>s\nGG\n")
    with pytest.raises(Exception, match="before the first record"):
        S.read_fasta(spark, str(tmp_path / "o.fa")).collect()
    (tmp_path / "e.fa").write_text(">x\n>w\nA\n")
    with pytest.raises(Exception, match="empty record"):
        S.read_fasta(spark, str(tmp_path / "e.fa")).collect()


def test_compacted_round_trip(spark, tmp_path):
    (tmp_path / "u.fa").write_text(">0 LN:i:4 KC:i:1 km:f:1.0 L:-:1:+ L:+:1:-\nACGT\n>1 LN:i:3 KC:i:1 km:f:1.0 L:+:0:+\nTAC\n")
    u = S.read_compacted(spark, str(tmp_path / "u.fa"))
    S.write_compacted(u, str(tmp_path / "out"))
    again = S.read_compacted(spark, str(tmp_path / "out"))
    key = lambda df: sorted((r.unitig, r.seq, sorted(map(tuple, r.links))) for r in df.collect())
    assert key(u) == key(again)
    e = S.edge_centric(u, 3).collect()
    assert {(r.edge, r.mirror) for r in e} == {(0, 1), (1, 0), (2, 3), (3, 2)}
    assert next((r.src, r.dst) for r in e if r.edge == 3) == ("GT", "TA")
    nodes, edges = S.node_centric(u)
    assert nodes.count() == 4 and {(r.src, r.dst) for r in edges.collect()} >= {(0, 3), (2, 1)}
    line = spark.createDataFrame([(">0 a b c L:-:2:+ L:+:3:+ L:+:3:-",)], "l string").select(S.canonical_header(F.col("l"))).first()[0]
    assert line == ">0 a b c L:+:3:- L:+:3:+ L:-:2:+"


def test_small_formats(spark, tmp_path):
    (tmp_path / "g.gfa").write_text("H\tx\nS\ta\tACG\nL\ta\t+\tb\t-\t12M\n")
    seg, links = S.read_gfa(spark, str(tmp_path / "g.gfa"))
    assert tuple(seg.first()) == ("a", "ACG") and tuple(links.first()) == ("a", "+", "b", "-", 12)
    (tmp_path / "p.paf").write_text("q\t9\t1\t8\t+\tt\t99\t10\t17\t7\t7\t60\ttp:A:P\tcm:i:3\n")
    r = S.read_paf(spark, str(tmp_path / "p.paf")).first()
    assert (r.qname, r.tend, r.tags) == ("q", 17, ["tp:A:P", "cm:i:3"])
    (tmp_path / "d.dot").write_text('digraph {\nN1 -> N2 [label="+-:3"]\n}\n')
    assert tuple(S.read_dot(spark, str(tmp_path / "d.dot")).first()) == ("N1", "+", "N2", "-")
    (tmp_path / "b.json").write_text('{"c": [[1, 5], [9, 10]]}')
    assert sorted(map(tuple, S.read_breakpoints(spark, str(tmp_path / "b.json")).collect())) == [("c", 1, 5), ("c", 9, 10)]
    (tmp_path / "l.lay").write_text(">ctg1 nodes=2 len=9\nE\t0\tN1\t+\tN2\t-\nS\tr1\t+\t0\t5\tACGTA\nE\t4\tN2\t+\tN3\t-\nS\tr2\t-\t3\t2\tAC\n")
    got = S.read_layout(spark, str(tmp_path / "l.lay")).orderBy("edge").collect()
    assert [(r.contig, r.edge, r.n1, r.read, r.len) for r in got] == [("ctg1", 1, "N1", "r1", 5), ("ctg1", 2, "N2", "r2", 2)]
    heads = S.read_layout_heads(spark, str(tmp_path / "l.lay"))
    S.write_layout(S.read_layout(spark, str(tmp_path / "l.lay")), heads, str(tmp_path / "again"))
    again = S.read_layout(spark, str(tmp_path / "again"))
    assert sorted(map(str, again.collect())) == sorted(map(str, got)) and S.read_layout_heads(spark, str(tmp_path / "again")).collect() == heads.collect()
    assert [tuple(r) for r in S.layout_walks(again).collect()] == [("ctg1", ["N1+", "N2+", "N3-"])]
    (tmp_path / "t.log").write_text("\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02.5\n\tMaximum resident set size (kbytes): 77\n\tElapsed (wall clock) time (h:mm:ss or m:ss): 0:01.5\n")
    r = S.time_log(S.read_logs(spark, str(tmp_path / "t.log"))).first()
    assert (r.time, r.mem) == (64.0, 77)


def test_gfa_round_trip_and_strands(spark, tmp_path):
    u = spark.createDataFrame([(0, "ACGT", [("+", 1, "-")]), (1, "GTT", [])], "unitig long, seq string, links array<struct<own:string,target:long,other:string>>")
    S.write_gfa(u, str(tmp_path / "g"), 3)
    assert spark.read.text(str(tmp_path / "g")).filter("value LIKE 'H%'").count() == 1
    segments, links = S.read_gfa(spark, str(tmp_path / "g"))
    nodes, arcs = S.gfa_bigraph(segments, links)
    assert {(r.node, r.mirror, r.seq) for r in nodes.collect()} == {("0+", "0-", "ACGT"), ("0-", "0+", "ACGT"), ("1+", "1-", "GTT"), ("1-", "1+", "AAC")}
    assert {tuple(r) for r in arcs.collect()} == {("0+", "1-", 2), ("1+", "0-", 2)}
    assert sorted(map(tuple, S.gfa_to_fasta(spark, [str(tmp_path / "g")] * 2).collect())) == [("0", "ACGT")] * 2 + [("1", "GTT")] * 2


def test_fuzzy_graph_of_several_files(spark, tmp_path):
    (tmp_path / "x.3.nodes").write_text("N1\t2\tr1_NC_1_0_5120_F_1_4\tr2_NC_1_5120_0_R_2_4*\n")
    (tmp_path / "x.3.reads").write_text("r1\t5120\tN1_F\tN2_R\n")
    (tmp_path / "x.dot").write_text('digraph {\nN1 -> N2 [label="+-:3"]\n}\n')
    (tmp_path / "x.fa").write_text(">r1\nACGT\n")
    paths = [str(p) for p in tmp_path.iterdir()]
    g = S.read_fuzzy_graph(spark, paths)
    assert g["nodes"].count() == 2 and g["sequences"].count() == 1 and tuple(g["reads"].first()) == ("r1", 5120, ["N1_F", "N2_R"])
    assert {(r.src, r.dst) for r in g["arcs"].collect()} == {("N1+", "N2-"), ("N2+", "N1-")}
    with pytest.raises(ValueError, match="3.nodes"):
        S.read_fuzzy_graph(spark, [p for p in paths if not p.endswith("nodes")])
    assert "sequences" not in S.read_fuzzy_graph(spark, [p for p in paths if not p.endswith(".fa")], need_sequences=False)


def test_documents_and_metrics(spark, tmp_path):
    m = spark.createDataFrame([(1, "b", ["3", "4"]), (0, "a", ["1", "2"])], "ord int, key string, values array<string>")
    S.write_metrics(m, str(tmp_path / "m"))
    lines = spark.read.text(str(tmp_path / "m")).collect()
    assert [r.value for r in lines] == [r"a & 1 & 2 \\", r"b & 3 & 4 \\"]
    text = [r"\hline x"] * 2 + [r"\# contigs & 5 \\ \hline", r"N50 & 7 \\"] + ["end"]
    rows = spark.createDataFrame([("p", i, t) for i, t in enumerate(text)], "path string, ord int, line string")
    assert [(r.key, r["values"]) for r in S.report_rows(rows, 2, 1, {"contigs": "tigs"}).orderBy("ord").collect()] == [(r"\# tigs", ["5"]), ("N50", ["7"])]
    doc = S.latex_document("T", [("one", [("a", 1)], "lr")])
    assert doc.count("tabular") == 2 and r"a & 1 \\" in doc


def test_yaml(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yml").write_text("reports:\n  a: [1, {b: null}]\n")
    assert P.expand_matrix(S.read_yaml(str(tmp_path / "c.yml"))["reports"]) == [{"a": 1}, {"a": "b"}]


def test_metric_of_lines_at_one_place_is_that_of_the_first(spark, tmp_path):
    from braidwork.plans import catalog

    rows = [(i, 1, 5, "A", float(q)) for i in range(50) for q in ((7, 9) if i % 2 else (9, 7))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.source: r.value for r in catalog.queries()["r15_metric_pairs"](spark, str(tmp_path)).filter("title = 'A/R'").collect()}
    assert got == {i: "7/N/A" if i % 2 else "9/N/A" for i in range(50)}


def test_of_lines_at_the_same_place_the_first_file_by_name_counts(spark, tmp_path):
    from braidwork.plans import catalog

    line = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_returnflag string, l_quantity double"
    files = ([(9, 1, 1, "A", 1.0), (7, 1, 5, "A", 20.0), (7, 2, 1, "R", 3.0)], [(7, 1, 5, "A", 30.0), (7, 2, 0, "R", 4.0), (9, 1, 1, "A", 2.0), (9, 1, 1, "A", 5.0)])
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, line).coalesce(1).write.parquet(str(tmp_path / f"{k}"))
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        next((tmp_path / f"{k}").glob("part-*.parquet")).rename(tmp_path / "lineitem.parquet" / f"part-{k}.parquet")
    got = {(r.source, r.title): r.value for r in catalog.queries()["r15_metric_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(7, "A/R"): "20/3", (7, "N/A"): "N/A/20", (9, "A/R"): "1/N/A", (9, "N/A"): "N/A/1"}
