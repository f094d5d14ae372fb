"""Readers and writers of the text formats. All go through Spark's own readers, so any file system works."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidwork.operators.records import with_ordinal

c = F.col


def marked_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, value): the text from one > at the start of a line to the next, without it; file, block and place give the order. Text before the first is an error."""
    # records are told apart by the line break before their >; only the first of a file still has its own
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    raw = raw.filter(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    raw = raw.withColumn("first", F.row_number().over(Window.partitionBy("file").orderBy("block", "place")) == 1)
    orphan = F.when(c("first") & ~F.regexp_replace("value", r"^\s+", "").startswith(">"), F.raise_error(F.lit("text before the first record")).cast("string")).otherwise(c("value"))
    return raw.select("file", "block", "place", F.when(c("first"), F.regexp_replace(orphan, r"^\s*>", "")).otherwise(c("value")).alias("value"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(rec_ix, id, desc, seq): multi-line records; rec_ix ascends with the order of the records, files in the order of their names.

    A record starts with > at the start of a line; descriptions may hold one. Text before the first record, and a
    record without a sequence, are errors.
    """
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")
    checked = F.when(seq == "", F.raise_error(F.concat(F.lit("empty record: "), head)).cast("string")).otherwise(seq)
    desc = F.regexp_extract(head, r"^\S+\s+(.*)$", 1)
    parsed = marked_records(spark, path).select("file", "block", "place", F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.when(desc != "", desc).alias("desc"), checked.alias("seq"))
    return with_ordinal(parsed, "file", "block", "place").select(c("ordinal").alias("rec_ix"), "id", "desc", "seq")


def write_fasta(records: DataFrame, path: str) -> None:
    line = F.concat(F.lit(">"), "id", F.when(c("desc").isNotNull() & (c("desc") != ""), F.concat(F.lit(" "), "desc")).otherwise(""), F.lit("\n"), "seq")
    records.select(line.alias("value")).write.text(path)


def fastq_to_fasta(lines: DataFrame) -> DataFrame:
    """(id, seq) of FASTQ lines (ix, value) of one file, four to a record."""
    q = lines.withColumns({"rec": F.floor(c("ix") / 4), "k": c("ix") % 4}).filter("k < 2")
    return q.groupBy("rec").agg(F.max(F.when(c("k") == 0, F.regexp_extract("value", r"^@(\S*)", 1))).alias("id"), F.max(F.when(c("k") == 1, c("value"))).alias("seq"))


def link_key(link: Column) -> Column:
    p = F.split(link, ":")
    return F.struct((F.get(p, F.lit(1)) == "-").cast("int").alias("a"), F.get(p, F.lit(2)).cast("bigint").alias("b"), (F.get(p, F.lit(3)) == "+").cast("int").alias("d"), link.alias("link"))


def canonical_links(links: Column) -> Column:
    """Link tokens by own sign (+ first), target, other sign (- first)."""
    return F.transform(F.array_sort(F.transform(links, link_key)), lambda x: x["link"])


def canonical_header(line: Column) -> Column:
    """The first four tokens of a compacted-graph header, then its links in canonical order."""
    t = F.split(line, " ")
    links = F.filter(F.slice(t, F.lit(5), F.greatest(F.size(t) - 4, F.lit(0))), lambda x: x != "")
    return F.array_join(F.concat(F.slice(t, 1, 4), canonical_links(links)), " ")


def read_compacted(spark: SparkSession, path: str) -> DataFrame:
    """(unitig, seq, links ARRAY<STRUCT<own, target, other>>) of a compacted de Bruijn graph in FASTA with L:sign:target:sign tokens."""
    r = read_fasta(spark, path)
    tokens = F.filter(F.split(F.coalesce("desc", F.lit("")), " "), lambda x: x.startswith("L:"))
    parts = lambda x: F.split(x, ":")
    links = F.transform(tokens, lambda x: F.struct(F.get(parts(x), F.lit(1)).alias("own"), F.get(parts(x), F.lit(2)).cast("bigint").alias("target"), F.get(parts(x), F.lit(3)).alias("other")))
    return r.select(c("id").cast("bigint").alias("unitig"), "seq", links.alias("links"))


def edge_centric(unitigs: DataFrame, k: int) -> DataFrame:
    """(edge, src, dst, mirror, unitig, forward, seq): each unitig as an edge of both orientations between its first and last k-1 letters. An edge is 2 * unitig, its mirror 2 * unitig + 1."""
    from braidwork.functions.seq import reverse_complement

    both = unitigs.select("unitig", F.explode(F.array(F.struct(F.lit(True).alias("forward"), c("seq").alias("s")), F.struct(F.lit(False).alias("forward"), reverse_complement(c("seq")).alias("s")))).alias("o"))
    s, ahead = c("o.s"), c("o.forward")
    edge = 2 * c("unitig") + F.when(ahead, 0).otherwise(1)
    return both.select(edge.alias("edge"), F.substring(s, 1, k - 1).alias("src"), F.substring(s, F.length(s) - (k - 2), F.lit(k - 1)).alias("dst"), (4 * c("unitig") + 1 - edge).alias("mirror"), "unitig", ahead.alias("forward"), s.alias("seq"))


def node_centric(unitigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (node, mirror, seq) and edges (src, dst): two nodes for each unitig, an edge for each link and its mirror."""
    from braidwork.functions.seq import reverse_complement

    u = c("unitig")
    nodes = unitigs.select((2 * u).alias("node"), (2 * u + 1).alias("mirror"), "seq").unionByName(unitigs.select((2 * u + 1).alias("node"), (2 * u).alias("mirror"), reverse_complement(c("seq")).alias("seq")))
    l = unitigs.select("unitig", F.explode("links").alias("l"))
    a = 2 * u + F.when(c("l.own") == "+", 0).otherwise(1)
    b = 2 * c("l.target") + F.when(c("l.other") == "+", 0).otherwise(1)
    ahead = l.select(a.alias("src"), b.alias("dst"))
    flip = lambda x: F.when(x % 2 == 0, x + 1).otherwise(x - 1)
    return nodes, ahead.unionByName(ahead.select(flip(c("dst")).alias("src"), flip(c("src")).alias("dst"))).distinct()


def write_compacted(unitigs: DataFrame, path: str) -> None:
    links = F.array_join(canonical_links(F.transform("links", lambda x: F.concat_ws(":", F.lit("L"), x["own"], x["target"].cast("string"), x["other"]))), " ")
    n = F.length("seq").cast("string")
    head = F.concat_ws(" ", F.concat(F.lit(">"), c("unitig").cast("string")), F.concat(F.lit("LN:i:"), n), F.lit("KC:i:0"), F.lit("km:f:0.0"), F.when(F.size("links") > 0, links))
    unitigs.select(F.concat(head, F.lit("\n"), "seq").alias("value")).write.text(path)


def gfa_lines(unitigs: DataFrame, k: int) -> DataFrame:
    """(kind, line) of a compacted graph (unitig, seq, links) as GFA: the header, S lines, and an L line per link, with an overlap of k - 1."""
    spark = unitigs.sparkSession
    head = spark.createDataFrame([("H", "H\tVN:Z:1.0")], "kind string, line string")
    u = c("unitig").cast("string")
    segments = unitigs.select(F.lit("S").alias("kind"), F.concat_ws("\t", F.lit("S"), u, "seq").alias("line"))
    links = unitigs.select(u.alias("u"), F.explode("links").alias("l")).select(F.lit("L").alias("kind"), F.concat_ws("\t", F.lit("L"), "u", "l.own", c("l.target").cast("string"), "l.other", F.lit(f"{k - 1}M")).alias("line"))
    return head.unionByName(segments).unionByName(links)


def write_gfa(unitigs: DataFrame, path: str, k: int) -> None:
    """The header stands in the first file, segments before links in each."""
    order = F.when(c("kind") == "H", 0).when(c("kind") == "S", 1).otherwise(2)
    gfa_lines(unitigs, k).orderBy(order, "line").select(c("line").alias("value")).write.text(path)


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """segments (name, seq) and links (src, own, dst, other, overlap)."""
    t = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    f = lambda i: F.get("f", F.lit(i))
    segments = t.filter(f(0) == "S").select(f(1).alias("name"), f(2).alias("seq"))
    links = t.filter(f(0) == "L").select(f(1).alias("src"), f(2).alias("own"), f(3).alias("dst"), f(4).alias("other"), F.regexp_extract(f(5), r"(\d+)M", 1).try_cast("int").alias("overlap"))
    return segments, links


def read_dot(spark: SparkSession, path: str) -> DataFrame:
    """(src, own, dst, other): arrows `N1 -> N2 [label="+-…"]`."""
    v, pattern = c("value"), r'^\s*"?(\w+)"?\s*->\s*"?(\w+)"?\s*(?:\[.*?label="?([+-])\s*:?([+-]))?'
    return spark.read.text(path).filter(v.contains("->")).select(F.regexp_extract(v, pattern, 1).alias("src"), F.regexp_extract(v, pattern, 3).alias("own"), F.regexp_extract(v, pattern, 2).alias("dst"), F.regexp_extract(v, pattern, 4).alias("other"))


PAF = "qname string, qlen bigint, qstart bigint, qend bigint, strand string, tname string, tlen bigint, tstart bigint, tend bigint, matches bigint, block bigint, mapq int"


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """The twelve columns, and tags as an array."""
    f = F.split("value", "\t")
    names = [x.strip().split(" ") for x in PAF.split(",")]
    return spark.read.text(path).select(*(F.get(f, F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(names)), F.slice(f, F.lit(13), F.greatest(F.size(f) - 12, F.lit(0))).alias("tags"))


def read_node_alignments(spark: SparkSession, path: str) -> DataFrame:
    """(node, alignment struct) of a .nodes table: tab-separated, empty fields dropped, alignments from the third field on."""
    from braidwork.operators.intervals import decode_alignment

    f = F.filter(F.split("value", "\t"), lambda x: x != "")
    t = spark.read.text(path).select(F.get(f, F.lit(0)).alias("node"), F.explode(F.slice(f, F.lit(3), F.greatest(F.size(f) - 2, F.lit(0)))).alias("token"))
    return t.select("node", decode_alignment(c("token")).alias("alignment"))


def layout_lines(spark: SparkSession, path: str) -> DataFrame:
    """(contig, nodes, length, pos, line) of a layout; a contig is read as one row, so its lines stay together."""
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    number = lambda name: F.regexp_extract(head, rf"\b{name}=(\d+)", 1).try_cast("bigint")
    return marked_records(spark, path).select(F.regexp_extract(head, r"^(\S+)", 1).alias("contig"), number("nodes").alias("nodes"), number("len").alias("length"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))


def read_layout_heads(spark: SparkSession, path: str) -> DataFrame:
    """(contig, nodes, length)."""
    return layout_lines(spark, path).filter("pos = 0").select("contig", "nodes", "length")


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """(contig, edge, offset, n1, d1, n2, d2, place, read, dir, at, len, seq) of S lines, each with the edge (numbered from 1) and contig it stands under; an edge without S lines has one row with nulls."""
    w = Window.partitionBy("contig").orderBy("pos")
    is_e, is_s = c("line").startswith("E\t"), c("line").startswith("S\t")
    e = layout_lines(spark, path).withColumn("edge", F.sum(is_e.cast("int")).over(w)).withColumn("head", F.last(F.when(is_e, c("line")), ignorenulls=True).over(w)).filter(is_e | is_s)
    e = e.withColumn("slices", F.count_if(is_s).over(Window.partitionBy("contig", "edge"))).filter(is_s | (c("slices") == 0))
    h, s = F.split("head", "\t"), F.split(F.when(is_s, c("line")), "\t")
    g = lambda a, i: F.get(a, F.lit(i))
    return e.select("contig", c("edge").cast("bigint").alias("edge"), g(h, 1).cast("bigint").alias("offset"), g(h, 2).alias("n1"), g(h, 3).alias("d1"), g(h, 4).alias("n2"), g(h, 5).alias("d2"), c("pos").alias("place"), g(s, 1).alias("read"), g(s, 2).alias("dir"), g(s, 3).cast("bigint").alias("at"), g(s, 4).cast("bigint").alias("len"), g(s, 5).alias("seq"))


def write_layout(rows: DataFrame, heads: DataFrame, path: str) -> None:
    """rows as read_layout() gives them and heads (contig, nodes, length) as a layout: a record per contig, fields of its header tab-separated."""
    s_line = F.when(c("read").isNotNull(), F.concat_ws("\t", F.lit("S"), "read", "dir", c("at").cast("string"), c("len").cast("string"), "seq"))
    lines = rows.groupBy("contig", "edge").agg(F.first(F.concat_ws("\t", F.lit("E"), c("offset").cast("string"), "n1", "d1", "n2", "d2")).alias("e"), F.transform(F.sort_array(F.collect_list(F.struct("place", s_line.alias("s")))), lambda x: x["s"]).alias("s"))
    whole = lines.select("contig", "edge", F.array_join(F.concat(F.array("e"), "s"), "\n").alias("text")).groupBy("contig").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("edge", "text"))), lambda x: x["text"]), "\n").alias("text"))
    head = F.concat_ws("\t", F.concat(F.lit(">"), "contig"), F.concat(F.lit("nodes="), c("nodes").cast("string")), F.concat(F.lit("len="), c("length").cast("string")))
    heads.join(whole, "contig", "left").select(F.concat_ws("\n", head, "text").alias("value")).write.text(path)


def layout_walks(rows: DataFrame) -> DataFrame:
    """(walk, items): the nodes of each contig of read_layout(), with their directions: the first node of every edge and the second of the last."""
    edges = rows.select("contig", "edge", F.concat("n1", "d1").alias("a"), F.concat("n2", "d2").alias("b")).distinct()
    ordered = F.sort_array(F.collect_list(F.struct("edge", "a", "b")))
    grouped = edges.groupBy(c("contig").alias("walk")).agg(ordered.alias("l"))
    return grouped.select("walk", F.concat(F.transform("l", lambda x: x["a"]), F.array(F.element_at("l", -1)["b"])).alias("items"))


def by_suffix(paths: list[str], suffix: str) -> str:
    """The first path with that ending."""
    found = [p for p in paths if p.endswith(suffix)]
    if not found:
        raise ValueError(f"no input ends in {suffix}")
    return found[0]


def read_fuzzy_graph(spark: SparkSession, paths: list[str], need_sequences: bool = True) -> dict[str, DataFrame]:
    """A fuzzy de Bruijn graph of several files, told apart by their endings: node alignments (.3.nodes), reads (.3.reads: read, length, fields), arcs (.dot, each with its mirror; nodes are names with + or -), and sequences (.fa), without which nothing is read unless need_sequences is false."""
    nodes, reads, dot = (by_suffix(paths, x) for x in (".3.nodes", ".3.reads", ".dot"))
    fasta = by_suffix(paths, ".fa") if need_sequences else None
    f = F.split("value", "\t")
    out = {
        "nodes": read_node_alignments(spark, nodes),
        "reads": spark.read.text(reads).select(F.get(f, F.lit(0)).alias("read"), F.get(f, F.lit(1)).try_cast("bigint").alias("length"), F.slice(f, F.lit(3), F.greatest(F.size(f) - 2, F.lit(0))).alias("fields")),
        "arcs": both_strands(read_dot(spark, dot).withColumn("overlap", F.lit(0))),
    }
    return out | ({"sequences": read_fasta(spark, fasta)} if fasta else {})


def flipped(node: Column) -> Column:
    """The other strand of a node name with its sign behind."""
    name = F.substring(node, F.lit(1), F.length(node) - 1)
    return F.concat(name, F.when(node.endswith("+"), "-").otherwise("+"))


def both_strands(links: DataFrame) -> DataFrame:
    """(src, dst, overlap) of links (src, own, dst, other, overlap): an arc between signed nodes, and its mirror."""
    ahead = links.select(F.concat("src", "own").alias("src"), F.concat("dst", "other").alias("dst"), "overlap")
    return ahead.unionByName(ahead.select(flipped(c("dst")).alias("src"), flipped(c("src")).alias("dst"), "overlap")).distinct()


def gfa_bigraph(segments: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (node, mirror, seq) and arcs (src, dst, overlap): both strands of every segment and link of read_gfa()."""
    from braidwork.functions.seq import reverse_complement

    node = lambda sign, other, seq: segments.select(F.concat("name", F.lit(sign)).alias("node"), F.concat("name", F.lit(other)).alias("mirror"), seq.alias("seq"))
    return node("+", "-", c("seq")).unionByName(node("-", "+", reverse_complement(c("seq")))), both_strands(links)


def gfa_to_fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(id, seq) of the segments of GFA files, one after the other."""
    return functools.reduce(DataFrame.unionByName, [read_gfa(spark, p)[0] for p in paths]).select(c("name").alias("id"), "seq")


def read_yaml(path: str) -> dict:
    """A configuration file as a tree; small by nature, and read by the driver alone."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def read_tsplib(spark: SparkSession, path: str) -> DataFrame:
    """(row, values) of the full matrix of one instance file."""
    text = F.regexp_extract("value", r"(?s)EDGE_WEIGHT_SECTION\s+(.*?)\s*(?:EOF|$)", 1)
    n = F.regexp_extract("value", r"DIMENSION\s*:?\s*(\d+)", 1).try_cast("int")
    raw = spark.read.text(path, wholetext=True).filter("value <> ''").select(n.alias("n"), F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.cast("int")).alias("all"))
    return raw.select("n", "all", F.explode(F.sequence(F.lit(0), c("n") - 1)).alias("row")).select(c("row").cast("bigint").alias("row"), F.slice("all", c("row") * c("n") + 1, c("n")).alias("values"))


def write_tsplib(matrix: DataFrame, path: str, name: str = "instance") -> None:
    """One file of one instance: the matrix is the size of a TSP solver's input."""
    n = matrix.count()
    head = f"NAME: {name}\nTYPE: ATSP\nDIMENSION: {n}\nEDGE_WEIGHT_TYPE: EXPLICIT\nEDGE_WEIGHT_FORMAT: FULL_MATRIX\nEDGE_WEIGHT_SECTION\n"
    rows = matrix.groupBy().agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "values"))), lambda x: F.array_join(x["values"], " ")), "\n").alias("m"))
    rows.select(F.concat(F.lit(head), "m", F.lit("\nEOF")).alias("value")).write.text(path)


def read_labelled_xy(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(label, x, y) of headerless CSV files of pairs, by label."""
    one = lambda label, path: spark.read.schema("x double, y double").csv(path).select(F.lit(label).alias("label"), "x", "y")
    return functools.reduce(DataFrame.unionByName, [one(k, v) for k, v in paths.items()])


def read_breakpoints(spark: SparkSession, path: str) -> DataFrame:
    """(name, start, end) of a JSON object of lists of pairs."""
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<array<bigint>>>")).alias("name", "l"))
    return m.select("name", F.explode("l").alias("p")).select("name", F.get("p", F.lit(0)).alias("start"), F.get("p", F.lit(1)).alias("end"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of all log files under path."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), c("value").alias("line"))


def time_log(lines: DataFrame) -> DataFrame:
    """(path, time, mem) of GNU time's verbose reports: elapsed seconds summed, resident size (KiB) at its largest."""
    from braidwork.functions.seq import elapsed_seconds

    t = F.regexp_extract("line", r"Elapsed \(wall clock\) time.*: (\d[\d:.]*)", 1)
    m = F.regexp_extract("line", r"Maximum resident set size \(kbytes\): (\d+)", 1)
    return lines.groupBy("path").agg(F.sum(elapsed_seconds(F.nullif(t, F.lit("")))).alias("time"), F.max(m.try_cast("bigint")).alias("mem"))


def metric_rows(lines: DataFrame) -> DataFrame:
    """(path, ord, key, values) of table rows `key & v1 & v2 \\\\`; rules are skipped."""
    t = F.trim(F.regexp_replace("line", r"\\\\\s*(\\hline)?\s*$", ""))
    f = F.transform(F.split(t, "&"), lambda x: F.trim(x))
    return lines.filter(c("line").contains("&")).select("path", "ord", F.get(f, F.lit(0)).alias("key"), F.slice(f, F.lit(2), F.size(f) - 1).alias("values"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Rows (ord, key, values ARRAY) as `key & v1 & v2 \\\\` lines in their order, in one file: a command's metrics are few."""
    line = F.concat(F.concat_ws(" & ", "key", "values"), F.lit(" \\\\"))
    metrics.repartition(1).sortWithinPartitions("ord").select(line.alias("value")).write.text(path)


def latex_document(title: str, tables: list[tuple[str, list[tuple], str]]) -> str:
    """A whole document of captioned tables (caption, rows, columns)."""
    body = "\n".join(f"\\begin{{table}}[ht]\n\\centering\n\\caption{{{caption}}}\n{latex_table(rows, columns)}\\end{{table}}" for caption, rows, columns in tables)
    return f"\\documentclass{{article}}\n\\title{{{title}}}\n\\begin{{document}}\n\\maketitle\n{body}\n\\end{{document}}\n"


def report_rows(lines: DataFrame, skip: int = 8, drop: int = 4, renamed: dict[str, str] | None = None) -> DataFrame:
    """(path, ord, key, values) of evaluation reports in LaTeX, lines (path, ord, line): rules go, then the first `skip` and last `drop` lines of each; phrases are renamed. A report that isn't there has no rows."""
    text = F.trim(F.replace(F.trim("line"), F.lit("\\hline"), F.lit("")))
    for old, new in (renamed or {}).items():
        text = F.replace(text, F.lit(old), F.lit(new))
    w = Window.partitionBy("path")
    placed = lines.withColumns({"line": text, "_i": F.row_number().over(w.orderBy("ord")), "_n": F.count("*").over(w)})
    return metric_rows(placed.filter((c("_i") > skip) & (c("_i") <= c("_n") - drop)).drop("_i", "_n"))


def latex_table(rows: list[tuple], columns: str) -> str:
    """A finished, small table as LaTeX."""
    body = "\n".join(" & ".join(map(str, r)) + r" \\" for r in rows)
    return f"\\begin{{tabular}}{{{columns}}}\n\\hline\n{body}\n\\hline\n\\end{{tabular}}\n"
