"""Omnitigs and macro structures of strong components, as tables of walks that grow by joins.

A walk is an omnitig if no pair of its edges e ... f has a detour: a way from where f starts to where e ends that uses
neither. So a pair's verdict doesn't depend on the walk, and a walk is one if all its pairs are free of detours.
Walks of k + 1 edges come from two of k that overlap in k - 1: only the pair of their outer edges is new.

Edges that follow one another without a choice are one letter (a unitig) first, so rounds count branchings. Pairs
of which e is the only way into its end, or f the only way out of its start, have no detour; the others are searched.
The letters of a component of up to TASK_LETTERS are a row that meets its pairs of a round, dealt by component and, for
longer rows, by e; a search ends as soon as it arrives, and the nodes it reaches are never rows. In larger components
the nodes reached without e and f are spread by joins, all pairs of a round at once. No component is refused. The work
is the pairs met times the nodes that their search reaches. Nodes are numbered first; their names come back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork import session
from braidwork.operators import graph as G
from braidwork.operators.records import with_ordinal

c = F.col
#: Letters of a component up to which its searches take them as one row.
TASK_LETTERS = 2_000
#: Letters e whose pairs are one row of a larger component, about.
ROW_LETTERS = 64


def numbered(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edge, scc, src, dst) and (no, node): the distinct arcs (src, dst) inside strong components, numbered by component, start and end, with numbers for nodes and components (a component's is that of its least node); and the nodes of the numbers, in the same order."""
    arcs = session.stored(arcs.select("src", "dst").distinct(), "arcs")
    nodes = arcs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    names = session.stored(with_ordinal(nodes, "node").select(c("ordinal").alias("no"), "node"), "nodes")
    no = lambda end: names.select(c("node").alias(end), c("no").alias(f"{end}_no"))
    plain = session.stored(arcs.join(no("src"), "src").join(no("dst"), "dst").select(c("src_no").alias("src"), c("dst_no").alias("dst")), "plain")
    inside = G.induced(plain, session.stored(G.strong_components(plain).select("node", "scc"), "scc"), "scc").select("scc", "src", "dst")
    return session.stored(with_ordinal(inside, "scc", "src", "dst").select(c("ordinal").alias("edge"), "scc", "src", "dst"), "numbered"), names


def named(df: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """df with the nodes of the numbers in the columns."""
    order = df.columns
    for x in columns:
        df = df.join(names.select(c("no").alias(x), c("node").alias("_name")), x).drop(x).withColumnRenamed("_name", x)
    return df.select(*order)


def letters(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(letter, edge, pos), and (letter, scc, src, dst, join, split): unitigs named by their first edge; whether there are other ways into their ends, and other ways out of their starts. A component that is one circle is a letter from a node to itself with neither."""
    placed = session.stored(G.unitigs(edges).select(c("unitig").alias("letter"), "edge", "pos"), "letters")
    ends = placed.join(edges, "edge").groupBy("letter").agg(F.first("scc").alias("scc"), F.min_by("src", "pos").alias("src"), F.max_by("dst", "pos").alias("dst"))
    deg = session.stored(G.degrees(edges), "degrees")
    into, out = deg.select(c("node").alias("dst"), (c("n_in") > 1).alias("join")), deg.select(c("node").alias("src"), (c("n_out") > 1).alias("split"))
    return placed, session.stored(ends.join(into, "dst").join(out, "src").select("letter", "scc", "src", "dst", "join", "split"), "ends")


def by_component(ends: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(scc, n, letters): the letters of every component of up to TASK_LETTERS; and (scc) of the larger ones, or None."""
    sizes = session.stored(ends.groupBy("scc").agg(F.count("*").alias("n")), "sizes")
    large = sizes.filter(c("n") > TASK_LETTERS).select("scc")
    small = ends.select("scc", F.struct("letter", "src", "dst").alias("x")).join(sizes.filter(c("n") <= TASK_LETTERS), "scc").groupBy("scc", "n").agg(F.collect_list("x").alias("letters"))
    return session.stored(small, "components"), large if large.limit(1).count() else None


def arrives(ways: dict[int, list[tuple[int, int]]], e: int, f: int, goal: int, start: int) -> bool:
    """Whether there is a way of a letter or more from start to goal without e and f; ways has the (letter, end) out of each node."""
    seen, left = set(), [start]
    while left:
        for letter, to in ways[left.pop()]:
            if letter != e and letter != f and to not in seen:
                if to == goal:
                    return True
                seen.add(to)
                left.append(to)
    return False


def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(e, f) of the pairs of rows (letters, pairs) that have no detour."""
    for batch in batches:
        letters, pairs = batch.column(0), batch.column(1)
        a, b = letters.offsets.to_pylist(), pairs.offsets.to_pylist()
        letter, src, dst = (letters.values.field(x).to_pylist() for x in ("letter", "src", "dst"))
        e, f, goal, start = (pairs.values.field(x).to_pylist() for x in ("e", "f", "goal", "start"))
        free = []
        for i in range(batch.num_rows):
            ways: dict[int, list[tuple[int, int]]] = {}
            for j in range(a[i], a[i + 1]):
                ways.setdefault(src[j], []).append((letter[j], dst[j]))
            free += [j for j in range(b[i], b[i + 1]) if not arrives(ways, e[j], f[j], goal[j], start[j])]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for j in free], pa.int64()) for x in (e, f)], names=["e", "f"])


def without_detour(pairs: DataFrame, ends: DataFrame, small: DataFrame, large: DataFrame | None) -> DataFrame:
    """The pairs (e, f) of letters that have none; small and large as of by_component()."""
    first, last = ends.select(c("letter").alias("e"), "scc", c("dst").alias("goal"), "join"), ends.select(c("letter").alias("f"), c("src").alias("start"), "split")
    asked = session.stored(pairs.select("e", "f").distinct().join(first, "e").join(last, "f"), "asked")
    sure, open_ = asked.filter("NOT join OR NOT split").select("e", "f"), asked.filter("join AND split")
    row = F.pmod(c("e"), F.ceil(c("n") / ROW_LETTERS))
    rows = open_.join(small.select("scc", "n"), "scc").groupBy("scc", row.alias("row")).agg(F.collect_list(F.struct("e", "f", "goal", "start")).alias("pairs"))
    found = sure.unionByName(rows.join(small, "scc").select("letters", "pairs").mapInArrow(searched, "e bigint, f bigint"))
    return found if large is None else found.unionByName(searched_by_tables(open_.join(large, "scc", "left_semi"), ends.join(large, "scc", "left_semi")))


def searched_by_tables(asked: DataFrame, ends: DataFrame) -> DataFrame:
    """The pairs asked (e, f, goal, start) that have no detour, by tables of the nodes reached."""
    steps = ends.select(c("letter").alias("by"), c("src").alias("at"), c("dst").alias("to"))
    go = lambda front: front.join(steps, "at").filter((c("by") != c("e")) & (c("by") != c("f"))).select("e", "f", "goal", c("to").alias("at")).distinct()
    front = session.stored(go(asked.select("e", "f", "goal", c("start").alias("at"))), "front")
    seen = front
    while True:
        arrived = front.filter(c("at") == c("goal")).select("e", "f")
        once = go(front.join(arrived, ["e", "f"], "left_anti"))
        twice = go(once.filter(c("at") != c("goal")))  # two steps a round
        front = session.stored(once.unionByName(twice).distinct().join(seen, ["e", "f", "at"], "left_anti"), "front")
        if not front.limit(1).count():
            return asked.select("e", "f").join(seen.filter(c("at") == c("goal")).select("e", "f"), ["e", "f"], "left_anti")
        seen = seen.unionByName(front)


def grown(ends: DataFrame) -> DataFrame:
    """(items): omnitigs of letters that can't be made longer by one letter on either side; circles of their own left out."""
    walks = session.stored(ends.filter("join OR split OR src <> dst").select(F.array("letter").alias("items"), "src", "dst"), "walks")
    small, large = by_component(ends)
    done, k = None, 1
    while walks.limit(1).count():
        whole = c("items")
        if k == 1:
            left = walks.select(whole.alias("a"), c("dst").alias("over"))
            right = walks.select(c("src").alias("over"), whole.alias("b"))
        else:
            left = walks.select(whole.alias("a"), F.slice("items", 2, k - 1).alias("over"))
            right = walks.select(F.slice("items", 1, k - 1).alias("over"), whole.alias("b"))
        met = session.stored(left.join(right, "over").select("a", "b", F.get("a", F.lit(0)).alias("e"), F.element_at("b", -1).alias("f")), "met")
        longer = session.stored(met.join(without_detour(met, ends, small, large), ["e", "f"]), "longer")
        inner = longer.select(c("a").alias("items")).unionByName(longer.select(c("b").alias("items")))
        rest = walks.select("items").join(inner, "items", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        walks, k = longer.select(F.concat("a", F.array("f")).alias("items")), k + 1
    return done


def maximal_omnitigs(edges: DataFrame) -> DataFrame:
    """(scc, walk, items) of numbered edges (edge, scc, src, dst): maximal omnitigs of every component as arrays of edges, numbered from 0 by component in ascending order of their edges. A component that is one circle has its once-around walk from its least edge."""
    placed, ends = letters(edges)
    found = grown(ends)
    alone = ends.filter("NOT join AND NOT split AND src = dst").select(F.array("letter").alias("items"))
    whole_walks = session.stored((alone if found is None else found.unionByName(alone)).select(F.get("items", F.lit(0)).alias("letter"), "items").join(ends.select("letter", "scc"), "letter"), "grown")
    # what can't grow by one letter isn't in a longer one: omnitigs are closed under parts
    order = whole_walks.select("scc", "items").withColumn("walk", F.row_number().over(Window.partitionBy("scc").orderBy("items")).cast("bigint") - 1)
    order = session.stored(order, "walks")
    spread = order.select("scc", "walk", F.posexplode("items").alias("place", "letter")).join(placed, "letter")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("place", "pos", "edge"))), lambda x: x["edge"])
    return session.stored(spread.groupBy("scc", "walk").agg(parts.alias("items")), "omnitigs")


def steps_of(walks: DataFrame, edges: DataFrame) -> DataFrame:
    """(scc, walk, pos, edge, src, dst, joins, splits): the edges of walks (scc, walk, items), and whether several edges lead into, and out of, where each starts."""
    deg = G.degrees(edges).select(c("node").alias("src"), (c("n_in") > 1).alias("joins"), (c("n_out") > 1).alias("splits"))
    return walks.select("scc", "walk", F.posexplode("items").alias("pos", "edge")).join(edges.select("edge", "src", "dst"), "edge").join(deg, "src")


def non_trivial(walks: DataFrame, edges: DataFrame) -> DataFrame:
    """The walks with a join before a split inside."""
    inner = steps_of(walks, edges).filter("pos > 0").groupBy("scc", "walk").agg(F.max(F.when(c("splits"), c("pos"))).alias("last_split"), F.min(F.when(c("joins"), c("pos"))).alias("first_join"))
    return walks.join(inner.filter("last_split > first_join").select("scc", "walk"), ["scc", "walk"], "left_semi")


def macronodes(edges: DataFrame) -> DataFrame:
    """(scc, centre, node): bivalent nodes (several edges in and out) with the nodes that reach them while they have one edge out, and those they reach while they have one edge in."""
    deg = session.stored(G.degrees(edges), "degrees")
    centres = deg.filter("n_in > 1 AND n_out > 1").select(c("node").alias("centre"))
    one_out, one_in = deg.filter("n_out = 1").select(c("node").alias("src")), deg.filter("n_in = 1").select(c("node").alias("dst"))
    ahead = edges.join(one_out, "src", "left_semi").select(c("src").alias("x"), c("dst").alias("y"))
    back = edges.join(one_in, "dst", "left_semi").select(c("dst").alias("x"), c("src").alias("y"))
    own = centres.select("centre", c("centre").alias("node"))
    for step in (ahead, back):
        own = own.unionByName(followed(session.stored(step, "step"), centres))
    scc = edges.select(c("src").alias("centre"), "scc").distinct()
    return own.distinct().join(scc, "centre").select("scc", "centre", "node")


def followed(step: DataFrame, goals: DataFrame) -> DataFrame:
    """(centre, node): of each x of step (x, y), one y per x, the goal (centre) that following the steps ends at, where it does. Pointers double; circles without a goal stop when all else has."""
    at = session.stored(step.select(c("x").alias("node"), c("y").alias("cur")), "at")
    before = -1
    while True:
        further = at.select(c("node").alias("cur"), c("cur").alias("to"))
        after = session.stored(at.join(further, "cur", "left").select("node", F.coalesce("to", "cur").alias("cur"), c("to").isNull().alias("ended")), "at")
        session.drop_stored(at)
        at = after
        ended = after.filter("ended").count()
        if ended == before:
            return after.filter("ended").join(goals, c("cur") == c("centre"), "left_semi").select(c("cur").alias("centre"), "node")
        before = ended


def microtigs(edges: DataFrame, walks: DataFrame, macro: DataFrame) -> DataFrame:
    """(scc, centre, piece, items), pieces numbered by component, edges and centre: per macronode the longest pieces, of two edges or more, of the non-trivial omnitigs walks inside it."""
    steps = session.stored(steps_of(walks, edges), "steps")
    inside = steps.join(macro.select("centre", c("node").alias("src")), "src").select("scc", "walk", "pos", "edge", "centre").unionByName(steps.join(macro.select("centre", c("node").alias("dst")), "dst").select("scc", "walk", "pos", "edge", "centre")).distinct()
    run = c("pos") - F.row_number().over(Window.partitionBy("scc", "centre", "walk").orderBy("pos"))
    pieces = inside.withColumn("run", run).groupBy("scc", "centre", "walk", "run").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "edge"))), lambda x: x["edge"]).alias("items")).filter(F.size("items") > 1)
    numbers = session.stored(with_ordinal(pieces.select("scc", "centre", "items").distinct(), "scc", "items", "centre").withColumnRenamed("ordinal", "walk"), "named")
    # pieces of other macronodes don't count: their edges have other names
    tagged = session.stored(numbers.withColumn("items", F.transform("items", lambda x: F.struct(c("centre"), x.alias("edge")))), "pieces")
    longest = G.remove_subwalks(tagged.select("walk", "items")).select("walk")
    return session.stored(numbers.join(longest, "walk", "left_semi").select("scc", "centre", c("walk").alias("piece"), "items"), "microtigs")


def macrotigs(micro: DataFrame) -> DataFrame:
    """(scc, macrotig, items): microtigs joined where one ends with the edge that the next starts with, while there is no choice; circles open at their least piece. Those in others are left out; numbered from 0 by component in ascending order."""
    ends = session.stored(micro.select("scc", "piece", F.get("items", F.lit(0)).alias("first"), F.element_at("items", -1).alias("last"), "items"), "pieces")
    only = lambda key: ends.groupBy("scc", key).agg(F.count("*").alias("n"), F.first("piece").alias("piece")).filter("n = 1").select("scc", c(key).alias("edge"), "piece")
    links = only("last").withColumnRenamed("piece", "prev").join(only("first"), ["scc", "edge"]).select(c("piece").alias("edge"), "prev")
    links = session.stored(ends.select(c("piece").alias("edge")).join(links, "edge", "left"), "prev")
    straight, round_ = G.ranked(links)
    if round_.limit(1).count():
        straight = straight.unionByName(G.circles(round_.select("edge", "prev")))
    placed = straight.select(c("edge").alias("piece"), c("head").alias("walk"), "pos").join(ends.select("scc", "piece", "items"), "piece")
    tail = F.when(c("pos") == 0, c("items")).otherwise(F.slice("items", F.lit(2), F.size("items")))
    whole = placed.groupBy("scc", "walk").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", tail.alias("part")))), lambda x: x["part"])).alias("items"))
    whole = session.stored(whole, "macrotigs")
    left = G.remove_subwalks(whole.select("walk", "items")).select("walk")
    return session.stored(whole.join(left, "walk", "left_semi").select("scc", F.row_number().over(Window.partitionBy("scc").orderBy("items")).cast("bigint").alias("macrotig"), "items").withColumn("macrotig", c("macrotig") - 1), "macrotigs")


def omnitigs(arcs: DataFrame) -> DataFrame:
    """(scc, walk, n, nodes): maximal omnitigs of every strong component of arcs (src, dst) with an arc; nodes joined by blanks."""
    edges, nodes = numbered(arcs)
    steps = maximal_omnitigs(edges).select("scc", "walk", F.posexplode("items").alias("pos", "edge")).join(edges.select("edge", "src", "dst"), "edge")
    starts = named(steps.filter("pos = 0").select("scc", "walk", "src"), nodes, "src")
    steps = named(steps.select("scc", "walk", "pos", "dst"), nodes, "dst")
    names = F.transform(F.sort_array(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"].cast("string"))
    whole = steps.groupBy("scc", "walk").agg(F.count("*").alias("n"), F.array_join(names, " ").alias("rest")).join(starts, ["scc", "walk"])
    return named(whole.select("scc", "walk", "n", F.concat_ws(" ", c("src").cast("string"), "rest").alias("nodes")), nodes, "scc")


def structures(arcs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Edges and nodes as of numbered(), non-trivial omnitigs, macronodes, microtigs and macrotigs of arcs (src, dst)."""
    edges, nodes = numbered(arcs)
    hard = session.stored(non_trivial(maximal_omnitigs(edges), edges), "hard")
    macro = session.stored(macronodes(edges), "macronodes")
    micro = microtigs(edges, hard, macro)
    return edges, nodes, hard, macro, micro, macrotigs(micro)


def macro_counts(arcs: DataFrame) -> DataFrame:
    """(scc, macronodes, with_microtigs, macrotigs, edges, most, least) of every strong component with an arc: counts of macro structures, and of the edges of macrotigs."""
    edges, nodes, _, macro, micro, tigs = structures(arcs)
    n = F.size("items").cast("bigint")
    parts = (
        macro.groupBy("scc").agg(F.count_distinct("centre").alias("macronodes")),
        micro.groupBy("scc").agg(F.count_distinct("centre").alias("with_microtigs")),
        tigs.groupBy("scc").agg(F.count("*").alias("macrotigs"), F.sum(n).alias("edges"), F.max(n).alias("most"), F.min(n).alias("least")),
    )
    out = edges.select("scc").distinct()
    for part in parts:
        out = out.join(part, "scc", "left")
    return named(out.na.fill(0), nodes, "scc")


def omnitigs_per_macrotig(arcs: DataFrame) -> DataFrame:
    """(scc, macrotig, omnitigs): non-trivial omnitigs that share a step of two edges with each macrotig."""
    _, nodes, hard, _, _, tigs = structures(arcs)
    steps = lambda w, key: w.select("scc", key, F.explode(F.arrays_zip(F.slice("items", F.lit(1), F.size("items") - 1).alias("a"), F.slice("items", F.lit(2), F.size("items") - 1).alias("b"))).alias("s")).distinct()
    shared = steps(tigs, "macrotig").join(steps(hard, "walk"), ["scc", "s"]).groupBy("scc", "macrotig").agg(F.count_distinct("walk").alias("omnitigs"))
    return named(tigs.select("scc", "macrotig").join(shared, ["scc", "macrotig"], "left").na.fill(0), nodes, "scc")


def node_safe_walks(edges: DataFrame) -> DataFrame:
    """(scc, walk, nodes) of numbered edges (edge, scc, src, dst): maximal node walks that are in every node-covering circular walk: of the node sequences of omnitigs what is left without the steps at either end that some covering walk avoids, which are those between a split and a join."""
    deg = session.stored(G.degrees(edges), "degrees")
    steps = maximal_omnitigs(edges).select("scc", "walk", F.posexplode("items").alias("pos", "edge")).join(edges.select("edge", "src", "dst"), "edge")
    steps = steps.join(deg.select(c("node").alias("src"), (c("n_out") > 1).alias("split")), "src").join(deg.select(c("node").alias("dst"), (c("n_in") > 1).alias("join")), "dst")
    steps = session.stored(steps.withColumn("needed", ~(c("split") & c("join"))), "steps")
    span = steps.groupBy("scc", "walk").agg(F.min(F.when(c("needed"), c("pos"))).alias("a"), F.max(F.when(c("needed"), c("pos"))).alias("b"), F.max_by("dst", "pos").alias("last"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "src", "dst")))
    own = steps.join(span, ["scc", "walk"]).filter(c("pos").between(c("a"), c("b"))).groupBy("scc", "walk").agg(ordered.alias("s"))
    own = own.select("scc", "walk", F.concat(F.transform(F.slice("s", 1, 1), lambda x: x["src"]), F.transform("s", lambda x: x["dst"])).alias("items"))
    own = own.unionByName(span.filter("a IS NULL").select("scc", "walk", F.array("last").alias("items")))
    placed = session.stored(with_ordinal(own.select("scc", "items").distinct(), "scc", "items").withColumnRenamed("ordinal", "walk"), "node_walks")
    return placed.join(G.remove_subwalks(placed.select("walk", "items")).select("walk"), "walk", "left_semi").select("scc", "walk", c("items").alias("nodes"))


def node_safe_counts(arcs: DataFrame) -> DataFrame:
    """(scc, walks, longer, non_trivial): node-safe walks, those of over 2 nodes, those with a join before a split inside."""
    edges, names = numbered(arcs)
    walks = session.stored(node_safe_walks(edges), "safe")
    inside = G.degrees(edges)  # ways within components alone
    inner = walks.select("walk", F.size("nodes").alias("n"), F.posexplode("nodes").alias("pos", "node")).filter((c("pos") > 0) & (c("pos") < c("n") - 1))
    hard = inner.join(inside, "node").groupBy("walk").agg(F.max(F.when(c("n_out") > 1, c("pos"))).alias("last_split"), F.min(F.when(c("n_in") > 1, c("pos"))).alias("first_join")).filter("last_split >= first_join").select("walk", F.lit(1).alias("hard"))
    counts = walks.join(hard, "walk", "left").groupBy("scc").agg(F.count("*").alias("walks"), F.count_if(F.size("nodes") > 2).alias("longer"), F.count("hard").alias("non_trivial"))
    return named(counts, names, "scc")
