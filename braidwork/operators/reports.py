"""Configuration and report operators."""

from __future__ import annotations

import itertools
import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidwork.functions import seq as S

c = F.col


# argument trees: plain Python, small by nature


def merge_arguments(base: dict, over: dict) -> dict:
    """base with what `over` fills in or selects: missing and None values are filled, a scalar over a tree selects that key, `select_` keys prune their siblings. An empty selection is an error."""
    out = dict(base)
    for key, value in over.items():
        mine = out.get(key)
        if isinstance(mine, dict) and isinstance(value, dict):
            out[key] = merge_arguments(mine, value)
        elif isinstance(mine, dict) and value is not None:
            if str(value) not in mine:
                raise ValueError(f"nothing to select: {key} has no {value}")
            out[key] = {str(value): mine[str(value)]}
        elif mine is None or not isinstance(mine, dict):
            out[key] = mine if value is None else value
    chosen = {k.removeprefix("select_"): v for k, v in out.items() if k.startswith("select_")}
    if chosen:
        rest = {k: out[k] for k in chosen if k in out} | {k: v for k, v in chosen.items() if k not in out}
        if not rest:
            raise ValueError("empty selection")
        return rest
    return out


def expand_matrix(matrix) -> list:
    """All combinations: a dict is the product of its values, a list the union of its items; a scalar is itself. A dict of one key whose value is None is that key."""
    if isinstance(matrix, dict):
        if len(matrix) == 1 and None in matrix.values():
            return list(matrix)
        values = [[(k, v) for v in expand_matrix(m)] for k, m in matrix.items()]
        return [dict(x) for x in itertools.product(*values)]
    if isinstance(matrix, list):
        return [x for m in matrix for x in expand_matrix(m)]
    return [matrix]


def matrix_size(matrix) -> int:
    """How many combinations: products over dicts, sums over lists."""
    if isinstance(matrix, dict):
        return math.prod(matrix_size(m) for m in matrix.values())
    return sum(map(matrix_size, matrix)) if isinstance(matrix, list) else 1


def matrix_rows(spark: SparkSession, matrix) -> DataFrame:
    """(ix, arguments MAP<STRING,STRING>): a row for each combination of a matrix of plain dicts."""
    rows = [(i, {k: None if v is None else str(v) for k, v in x.items()}) for i, x in enumerate(expand_matrix(matrix))]
    return spark.createDataFrame(rows, "ix bigint, arguments map<string,string>")


def columns_of_experiments(columns: DataFrame, experiments: DataFrame) -> DataFrame:
    """Report columns (column, arguments MAP) with the experiments (experiment, arguments MAP) of the same arguments, in whatever order those stand: (column, experiment)."""
    key = lambda x: F.to_json(F.array_sort(F.map_entries(x)))
    return columns.select("column", key(c("arguments")).alias("k")).join(experiments.select("experiment", key(c("arguments")).alias("k")), "k").select("column", "experiment")


def argument_string(arguments: dict) -> str:
    """`--k v` for each; None and True give the flag alone, False nothing."""
    out = []
    for k, v in arguments.items():
        if v is None or v is True:
            out.append(k)
        elif v is not False:
            out += [k, str(v)]
    return " ".join(out)


def argument_name(arguments: dict) -> str:
    """JSON with a /_/ after every 200 characters that others follow; argument_of is its inverse."""
    return re.sub("(.{200})(?=.)", r"\1/_/", json.dumps(arguments, separators=(",", ":")), flags=re.S)


def argument_of(name: str) -> dict:
    return json.loads(name.replace("/_/", ""))


def short_name(arguments: dict) -> str:
    """The set values of a tree, joined by _: keys of flags, values of others, depth first; nothing for False and None-valued leaves under a named key."""
    out = []
    for k, v in arguments.items():
        if isinstance(v, dict):
            out.append(short_name(v))
        elif v is True or v is None:
            out.append(str(k))
        elif v is not False:
            out.append(str(v))
    return "_".join(re.sub(r"[^\w.+-]", "", x) for x in out if x)


def format_product(template: str, **values: list) -> list[str]:
    """The template once for each combination of the given lists, in their order; other names are left as they are."""
    return [format_partial(template, **dict(zip(values, x))) for x in itertools.product(*values.values())]


def format_partial(template: str, **values) -> str:
    """The template with the given names filled in, others left as they are."""
    return re.sub(r"\{(\w+)\}", lambda m: str(values[m[1]]) if m[1] in values else m[0], template)


def numeric_argument(arguments: list[str]) -> str:
    """The one part of digits; none or two are an error."""
    found = [x for a in arguments for x in a.split() if x.isdigit()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} numeric arguments")
    return found[0]


# tables


def merge_metrics(tables: list[DataFrame], by: str = "report") -> DataFrame:
    """(report, ord, key, values ARRAY): tables (report, ord, key, value) of metrics side by side, rows in the order of all of them.

    Keys that both have stand once. A key that only the further table has is put in where it stands there, with blanks
    before it; one that it lacks gets N/A. Tables that differ on both sides of the same place, or name common keys in
    another order, can't be merged: an error.
    """
    out = tables[0].select(by, "ord", "key", F.array("value").alias("values"))
    for n, table in enumerate(tables[1:], 1):
        out = _merge_two(out, table.select(by, "ord", "key", "value"), by, n)
    return out


def _merge_two(left: DataFrame, right: DataFrame, by: str, width: int) -> DataFrame:
    keys = lambda df, flag: df.select(by, "key", F.lit(True).alias(flag))
    w = Window.partitionBy(by).orderBy("ord")
    # a row's gap: how many common keys stand before it, itself included
    l = left.join(keys(right, "both"), [by, "key"], "left").withColumn("gap", F.count("both").over(w))
    r = right.join(keys(left, "both"), [by, "key"], "left").withColumn("gap", F.count("both").over(w))
    common = l.filter("both").select(by, "key", c("gap").alias("gap_l"), c("ord").alias("i"), "values").join(r.filter("both").select(by, "key", c("gap").alias("gap_r"), "value"), [by, "key"])
    ordered = F.when(c("gap_l") == c("gap_r"), c("gap_l")).otherwise(F.raise_error(F.concat(F.lit("keys in another order: "), "key")).cast("bigint"))
    met = common.select(by, "key", ordered.alias("gap"), F.lit(0).alias("side"), c("i").alias("place"), F.concat("values", F.array("value")).alias("values"))
    lacks = l.filter("both IS NULL").select(by, "key", "gap", F.lit(1).alias("side"), c("ord").alias("place"), F.concat("values", F.array(F.lit("N/A"))).alias("values"))
    blanks = F.array(*[F.lit("")] * width)
    extra = r.filter("both IS NULL").select(by, "key", "gap", F.lit(2).alias("side"), c("ord").alias("place"), F.concat(blanks, F.array("value")).alias("values"))
    rows = met.unionByName(lacks).unionByName(extra)
    g = Window.partitionBy(by, "gap")
    clash = (F.max(F.when(c("side") == 1, 1).otherwise(0)).over(g) == 1) & (F.max(F.when(c("side") == 2, 1).otherwise(0)).over(g) == 1)
    key = F.when(clash, F.raise_error(F.concat(F.lit("mismatching keys at "), "key")).cast("string")).otherwise(c("key"))
    checked = rows.withColumn("name", key)
    place = F.row_number().over(Window.partitionBy(by).orderBy("gap", "side", "place")) - 1
    return checked.select(by, place.cast("bigint").alias("ord"), c("name").alias("key"), "values")


def section(ord_: Column) -> Column:
    """Sections of the merged table by place: 0 to 6, 7 to 12, 13 to 29, the rest."""
    return F.when(ord_ < 7, 0).when(ord_ < 13, 1).when(ord_ < 30, 2).otherwise(3)


def resources(runs: DataFrame) -> DataFrame:
    """(step, time, mem): time summed and memory at its largest per step, and a total over all (step null is 'total')."""
    rolled = runs.rollup("step").agg(F.sum("time").alias("time"), F.max("mem").alias("mem"), F.grouping("step").alias("g"))
    return rolled.select(F.when(c("g") == 1, "total").otherwise(c("step")).alias("step"), "time", "mem")


def gibibytes(kib: Column) -> Column:
    return F.round(kib / 1024**2, 2)


def last_metric(rows: DataFrame) -> DataFrame:
    """(source, header, value) of tables of lines (source, ord, kind, text): the last value line, and the last header before it."""
    w = Window.partitionBy("source").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("header", F.last(F.when(c("kind") == "header", c("text")), ignorenulls=True).over(w)).filter("kind = 'value'")
    return seen.groupBy("source").agg(F.max_by("header", "ord").alias("header"), F.max_by("text", "ord").alias("value"))


def folder_of(path: Column) -> Column:
    """What stands before the last slash, without slashes at its end (unless it is nothing else); empty where there is no slash."""
    head = F.regexp_extract(path, "^(.*/)", 1)
    return F.when(F.rtrim(head, F.lit("/")) == "", head).otherwise(F.rtrim(head, F.lit("/")))


def superfluous(files: DataFrame, required: DataFrame) -> DataFrame:
    """Files (path) that don't begin with the folder of a required file, as plain text: a/b covers a/bc too, and the empty folder of a bare name covers all. Empty paths don't count.

    A path is cut at the lengths that folders have (no more than the longest path has characters) and looked up: an
    equi-join instead of all pairs.
    """
    wanted = required.filter("path <> ''").select(folder_of(c("path")).alias("folder")).distinct()
    lengths = wanted.agg(F.collect_set(F.length("folder")).alias("lengths"))  # one row
    files = files.filter("path <> ''").select("path").distinct()
    cuts = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(c("path"), F.lit(1), n))
    kept = files.crossJoin(lengths).select("path", F.explode(cuts).alias("folder")).join(wanted, "folder", "left_semi").select("path").distinct()
    return files.join(kept, "path", "left_anti")


def tagged(lines: DataFrame, tag: str) -> DataFrame:
    """Lines of the logs whose path holds the tag; of all where it is empty."""
    return lines.filter(c("path").contains(tag)) if tag else lines


def unsuccessful(lines: DataFrame, done: str = "1 of 1 steps (100%) done", tag: str = "") -> DataFrame:
    """Logs (path) with the tag in their name but without a line that says the job is done; lines (path, line)."""
    return tagged(lines, tag).groupBy("path").agg(F.coalesce(F.bool_or(c("line").contains(done)), F.lit(False)).alias("ok")).filter("NOT ok").select("path")


def unfinished_outputs(lines: DataFrame, tag: str = "") -> DataFrame:
    """(path, output, folder) of jobs that named their outputs and id but didn't end; lines (path, ord, line) of logs with the tag in their name. folder is what would have to go: reports only, nothing is deleted."""
    w = Window.partitionBy("path").orderBy("ord")
    first = lambda cond, col: F.min(F.when(cond, c(col)))
    whole = Window.partitionBy("path")
    a = tagged(lines, tag).withColumn("done", F.bool_or(c("line").contains("1 of 1 steps (100%) done")).over(whole)).withColumn("s1", first(c("line").contains("Select jobs to execute..."), "ord").over(whole))
    b = a.withColumn("s2", first((c("ord") >= c("s1")) & c("line").contains("output:"), "ord").over(whole))
    d = b.withColumn("s3", first((c("ord") >= c("s2")) & c("line").contains("jobid:"), "ord").over(whole))
    named = d.filter(~c("done") & c("s3").isNotNull() & (c("ord") == c("s2")))
    out = named.select("path", F.explode(F.split(F.trim(F.element_at(F.split("line", "output:"), 2)), ", ")).alias("output"))
    return out.withColumn("folder", folder_of(F.trim("output")))


def edge_coverage(lines: DataFrame) -> DataFrame:
    """(path, ord, coverage) of the lines (path, ord, line) that set the edge coverage."""
    return lines.filter(c("line").contains("Set --edge-cov to ")).select("path", "ord", F.regexp_extract("line", ".*Set --edge-cov to (.*)$", 1).alias("coverage"))


#: Job states.
RUNNING = ["PENDING", "CONFIGURING", "COMPLETING", "RUNNING", "SUSPENDED", "REVOKED", "REQUEUED", "RESIZING"]
FAILED = ["FAILED", "CANCELLED", "BOOT_FAIL", "DEADLINE", "NODE_FAIL", "OUT_OF_MEMORY", "PREEMPTED", "TIMEOUT"]


def job_status(states: DataFrame) -> DataFrame:
    """(job, status) of (job, state): success if all are completed, else running if any is, failed if all are, else error."""
    s = c("state")
    status = F.when(F.bool_and(s == "COMPLETED"), "success").when(F.bool_or(s.isin(RUNNING)), "running").when(F.bool_and(s.isin(FAILED)), "failed").otherwise("error")
    return states.groupBy("job").agg(status.alias("status"))


#: What a report needs, by the name of the log.
REQUIRED = (
    ("preprocessing_time", "preprocess", r"Preprocessing took\s*([\d.]+)\s*seconds"),
    ("raw_nodes", "raw", r"Number of Nodes: \s*([\d.]+)"),
    ("raw_optimum", "raw", r"Optimal Solution: \s*([\d.]+)"),
    ("raw_time", "raw", r"Total Running Time:\s*([\d.]+) \(seconds\)"),
    ("preprocessed_nodes", "preprocessed", r"Number of Nodes: \s*([\d.]+)"),
    ("preprocessed_optimum", "preprocessed", r"Optimal Solution: \s*([\d.]+)"),
    ("preprocessed_time", "preprocessed", r"Total Running Time:\s*([\d.]+) \(seconds\)"),
)
#: What a preprocessing log may tell besides.
OPTIONAL = (
    ("removed_nodes", r"Preprocessing removed.*?([\d.]+)%"),
    ("removed_arcs", r"Preprocessing removed.*?%.*?([\d.]+)%"),
    ("safe_walks", r"Found (\d+) safe walks(?! of length)"),
    ("long_safe_walks", r"Found (\d+) safe walks of length > 2"),
    ("non_trivial_safe_walks", r"Found (\d+) non-trivial safe walks"),
)


def hamiltonian_report(lines: DataFrame, strict: bool = True) -> DataFrame:
    """A row for each run of lines (run, log, ord, line), log being preprocess, raw or preprocessed: the seven required values, what preprocessing found, and whether the graph is hamiltonian.

    It is where the optimum is five times the number of nodes; raw and preprocessed graph have to agree. A missing
    value or a disagreement is an error; where not strict, it stands in the column error and hamiltonian is null. The
    last line of a kind counts.
    """
    last = lambda log, pattern: F.max_by(F.when(c("log") == log, F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))).try_cast("double"), F.when((c("log") == log) & c("line").rlike(pattern), c("ord")))
    solved = F.coalesce(F.bool_or((c("log") == "preprocess") & c("line").contains("Preprocessing the graph revealed that it is not hamiltonian")), F.lit(False))
    found = lines.groupBy("run").agg(*(last(log, p).alias(name) for name, log, p in REQUIRED), *(last("preprocess", p).alias(name) for name, p in OPTIONAL), solved.alias("solved"))
    whole = [name for name, *_ in REQUIRED if name.endswith(("nodes", "optimum"))]
    found = found.withColumns({x: F.round(x).cast("bigint") for x in whole})
    missing = F.coalesce(*(F.when(c(name).isNull(), F.lit(f"missing {name}")) for name, *_ in REQUIRED))
    raw, less = c("raw_nodes") * 5 == c("raw_optimum"), c("preprocessed_nodes") * 5 == c("preprocessed_optimum")
    error = F.coalesce(missing, F.when(raw != less, F.lit("raw and preprocessed graph disagree")))
    found = found.withColumn("error", error).withColumn("hamiltonian", F.when(c("error").isNull(), raw))
    if strict:
        told = F.raise_error(F.concat(F.lit("run "), c("run").cast("string"), F.lit(": "), "error")).cast("boolean")
        found = found.withColumn("hamiltonian", F.when(c("error").isNotNull(), told).otherwise(c("hamiltonian")))
    return found


def hamiltonian_averages(reports: DataFrame) -> DataFrame:
    """One row of averages over the runs of hamiltonian_report(): shares in percent, times in seconds, removed nodes and arcs over the unsolved runs only, and safe walks by kind."""
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    mean = lambda x: F.try_divide(total(x), F.count("*"))
    unsolved = F.count_if(~c("solved"))
    return reports.agg(
        F.count("*").alias("runs"),
        (mean(F.coalesce("hamiltonian", F.lit(False)).cast("double")) * 100).alias("hamiltonian"),
        mean("preprocessing_time").alias("preprocessing_time"),
        mean("preprocessed_time").alias("preprocessed_time"),
        mean(c("preprocessing_time") + c("preprocessed_time")).alias("preprocessed_total_time"),
        mean("raw_time").alias("raw_time"),
        (mean(c("solved").cast("double")) * 100).alias("solved"),
        F.try_divide(total("removed_nodes"), unsolved).alias("removed_nodes"),
        F.try_divide(total("removed_arcs"), unsolved).alias("removed_arcs"),
        F.try_divide(total("safe_walks") - total("long_safe_walks"), F.count("*")).alias("strong_bridges"),
        F.try_divide(total("long_safe_walks") - total("non_trivial_safe_walks"), F.count("*")).alias("trivial_safe_walks"),
        mean("non_trivial_safe_walks").alias("non_trivial_safe_walks"),
    )


#: Arguments of the assembly evaluation by mode; a mode with _hoco behind has HOCO besides.
EVALUATION = {
    "hicanu": "-s",
    "hicanu_alignments": "--skip-unaligned-mis-contigs --min-alignment 10000 --min-identity 98.0 --extensive-mis-size 5000 --min-contig 50000",
    "hicanu_misassemblies": "--min-alignment 20000 --extensive-mis-size 500000 --min-identity 90",
    "hicanu_misassemblies_strict": "--min-alignment 20000 --extensive-mis-size 100000 --min-identity 90",
    "normal": "--fragmented",
}
HOCO = "--minimap-hoco"
#: Metrics that an aggregated report shows together.
METRIC_PAIRS = [*((x, f"Strict {x}") for x in ("EA50max", "EA75max", "EAmeanmax", "P5k", "P10k", "P15k", "P20k")), ("EAmeanmax", "\\# unique misassemblies"), ("\\# unique misassemblies", "\\# misassemblies"), ("\\# unique local misassemblies", "\\# local misassemblies")]


def evaluation_arguments(mode: str) -> str:
    base = mode.removesuffix("_hoco")
    if base not in EVALUATION:
        raise ValueError(f"unknown evaluation mode: {mode}")
    return EVALUATION[base] + (f" {HOCO}" if mode != base else "")


def metric_pairs(rows: DataFrame, pairs: list[tuple[str, ...]] = METRIC_PAIRS) -> DataFrame:
    """(source, title, value): of rows (source, ord, key, value) the last value of each metric of a group, joined by /; a metric that a source lacks is N/A."""
    last = rows.groupBy("source", "key").agg(F.max_by("value", "ord").alias("value")).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    shown = lambda keys: F.array_join(F.array(*(F.coalesce(F.try_element_at("m", F.lit(k)), F.lit("N/A")) for k in keys)), "/")
    each = F.array(*(F.struct(F.lit("/".join(keys)).alias("title"), shown(keys).alias("value")) for keys in pairs))
    return last.select("source", F.explode(each).alias("p")).select("source", "p.title", "p.value")


def resource_inputs(runs: DataFrame) -> DataFrame:
    """(run, step): the logs whose resources a run's report sums, by assembler (run, assembler, tig, frg, hodeco, contigs): injections take two assembly steps, homopolymer decompression two more logs."""
    named = lambda x: F.coalesce(c(x), F.lit("none")) != "none"
    injected = named("tig") | named("frg")
    long = F.array_compact(F.array(
        F.when(named("hodeco"), F.lit("hoco")), F.when(named("hodeco"), F.lit("hodeco")), F.when(injected, F.lit("trivial_omnitigs")),
        F.lit("assembly"), F.lit("wtdbg2_extract"), F.when(injected, F.lit("contig_assembly")), F.lit("wtdbg2_consensus"),
    ))
    short = F.array_compact(F.array(F.lit("assembly"), F.when(c("contigs").startswith("trivial_omnitigs_"), F.lit("trivial_omnitigs"))))
    steps = F.when(c("assembler") == "wtdbg2", long).when(c("assembler") == "hifiasm", short).otherwise(F.array(F.lit("assembly")))
    return runs.select("run", F.explode(steps).alias("step"))


def elapsed(text: Column) -> Column:
    return S.elapsed_seconds(text)
