"""Near-duplicates by an inverted join over the coordinates of MinHash signatures.

Equal shingle sets are one node. A node's signature has K coordinates; each coordinate with its value is a token,
and nodes are posted under their tokens. Pairs with T equal coordinates or more are candidates (a pair at the
similarity threshold misses that with a probability under 1e-6), and links are confirmed on the full sets.

Merging is pruned in three ways, none of which loses a candidate:
- skip: tokens that one node alone has are never joined, and nodes with fewer than T shared tokens are skipped;
- prefix: of a node's s shared tokens only the s - T + 1 rarest are posted. Two nodes with T common tokens have
  one of those in common in both prefixes;
- pivots: within a posting list all nodes meet its most central node first (the one whose tokens are the most
  frequent). What that connects is one component; only nodes outside the list's main component (stragglers) meet
  the rest of the list, in blocks of bounded size. Pairs within a component need no link, so a list of m copies
  costs about m meetings, not m * m.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from braidwork.llm import common
from braidwork.operators.components import components

SHINGLE, PERCENT = 4, 80
#: Coordinates, and how many have to agree.
K, T = 48, 24
#: Held nodes of a block, and the asking nodes that one task takes to it, about.
BLOCK, ASKING = 256, 2048
_odd = np.random.RandomState(20200101)
MULTIPLIERS = (_odd.randint(0, 1 << 62, K, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0x85EBCA77C2B2AE63, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of the whole text; A-Z lower-cased, words between [\\x20\\x09-\\x0D]. With fewer words than size the whole sequence is one; without words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    k = min(n, size)
    s = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        s += (h[j : n - k + 1 + j] ^ (h[j : n - k + 1 + j] >> np.uint64(33))) * PLACES[j % len(PLACES)] * np.uint64(2 * (j // len(PLACES)) + 1)
    return np.unique(mixed(s))


def signature(s: np.ndarray) -> list[int]:
    """Tokens: coordinate and 32 bits of its minimum, as one integer."""
    least = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1 << 14):  # long texts in slices
        m = s[None, i : i + (1 << 14)] * MULTIPLIERS[:, None]
        m ^= m >> np.uint64(32)
        np.minimum(least, m.min(1), out=least)
    low = mixed(least) >> np.uint64(32)
    return (low | np.arange(K, dtype=np.uint64) << np.uint64(32)).astype(np.int64).tolist()


def sets_of(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n, s1, s2, tokens) of every row: set size, the 128-bit hash of the set, its signature (empty for an empty set)."""

    def make():
        def each(rows):
            out = {k: [] for k in ("n", "s1", "s2", "tokens")}
            for text in rows["text"]:
                s = shingles(text, size)
                h = np.frombuffer(xxh3_128_digest(s.tobytes()), "<i8")
                out["n"].append(len(s))
                out["s1"].append(int(h[0]))
                out["s2"].append(int(h[1]))
                out["tokens"].append(signature(s) if len(s) else [])
            return {"doc_id": rows["doc_id"]} | out

        return each

    return common.map_rows(docs.select("doc_id", "text"), make, "doc_id bigint, n bigint, s1 bigint, s2 bigint, tokens array<bigint>")


def candidates(nodes: DataFrame) -> DataFrame:
    """(node, prefix, score) of the nodes (node, tokens) with T shared tokens or more."""
    posted = nodes.select("node", F.explode("tokens").alias("t"))
    shared = posted.groupBy("t").agg(F.count("*").alias("c")).filter("c > 1")
    return (
        posted.join(shared, "t")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("own"), F.sum(F.log2("c")).alias("score"))
        .filter(F.size("own") >= T)
        .select("node", F.expr(f"transform(slice(own, 1, size(own) - {T - 1}), x -> x.t)").alias("prefix"), "score")
    )


def meet(held: DataFrame, asking: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes asking (g, node, comp) and nodes held (g, node, comp) of the same g, of different comp, confirmed on full sets. Of a group the held nodes are in memory (the caller bounds them), the asking ones are a stream; where many ask, they are dealt to several copies of the held ones."""
    cols = ["g", "kind", "node", "comp"]
    many = asking.groupBy("g").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("parts"))
    copies = held.join(many, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", "comp").select(F.xxhash64("g", "part").alias("g"), F.lit(0).alias("kind"), "node", "comp")
    dealt = asking.join(many, "g").select(F.xxhash64("g", F.pmod(F.xxhash64("node"), "parts").cast("int")).alias("g"), F.lit(1).alias("kind"), "node", "comp")
    rows = copies.unionByName(dealt)
    full = rows.join(sets, "node").select(*cols, "s").repartition("g").sortWithinPartitions("g", "kind", "node")
    arrow = common.arrow_schema(common.T._parse_datatype_string("a bigint, b bigint"))

    def run(batches):
        group, nodes, comps, sets, index = None, [], [], [], None
        for batch in common.pieces(batches):
            a, b = [], []
            for g, kind, node, comp, cell in zip(*(batch.column(i) for i in range(5))):
                g, kind, node, comp, s = g.as_py(), kind.as_py(), node.as_py(), comp.as_py(), np.frombuffer(cell.as_py(), "<u8")
                if g != group:
                    group, nodes, comps, sets, index = g, [], [], [], None
                if not kind:
                    nodes.append(node)
                    comps.append(comp)
                    sets.append(s)
                    continue
                if not nodes:
                    continue
                if index is None:
                    values = np.concatenate(sets)
                    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                    order = np.argsort(values, kind="stable")
                    index = values[order], owner[order], np.array([len(x) for x in sets]), np.array(comps)
                values, owner, sizes, of = index
                low, high = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
                n = high - low
                at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(sizes))
                linked = np.flatnonzero((100 * both >= percent * (sizes + len(s) - both)) & (of != comp))
                for k in {int(of[i]): i for i in linked}.values():
                    a.append(node)
                    b.append(nodes[k])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=arrow)

    return full.mapInArrow(run, "a bigint, b bigint")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, s): the sorted hashes of the documents in wanted (node)."""

    def make():
        return lambda rows: {"node": rows["doc_id"], "s": [shingles(t, size).tobytes() for t in rows["text"]]}

    return common.map_rows(docs.select("doc_id", "text").join(wanted.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), make, "node bigint, s binary")


def links(docs: DataFrame, nodes: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(node, root) of all nodes that have a link."""
    cands = common.stored(candidates(nodes), "cands")
    sets = common.stored(full_sets(docs, cands, size), "sets")
    posted = cands.select("node", "score", F.explode("prefix").alias("t"))
    lists = posted.groupBy("t").agg(F.max(F.struct("score", -F.col("node"))).alias("top"), F.count("*").alias("m")).filter("m > 1").select("t", (-F.col("top.col2")).alias("pivot"), "m")
    stars = posted.join(lists, "t").filter("node <> pivot").groupBy("node", "pivot").agg(F.max("m").alias("m"))
    signed = nodes.select("node", "tokens")
    stars = stars.join(signed, "node").join(signed.select(F.col("node").alias("pivot"), F.col("tokens").alias("pivot_tokens")), "pivot").filter(F.size(F.array_intersect("tokens", "pivot_tokens")) >= T)
    stars = common.stored(stars.select("node", "pivot", "m"), "stars")
    first = components(met_pivots(stars, sets, percent))
    return linked(posted, lists, first, sets, percent, (cands, stars))


def met_pivots(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the nodes and pivots of stars (node, pivot, m). A pivot of many is held once in each part of its star; the length m of a node's list says how many parts (as a power of two) without counting by pivot."""
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("m") / BLOCK, F.lit(1.0))))).cast("bigint")
    salted = stars.select("node", "pivot", F.xxhash64("pivot", parts, F.pmod(F.xxhash64("node"), parts)).alias("g"))
    return meet(salted.select("g", F.col("pivot").alias("node")).distinct().withColumn("comp", F.col("node")), salted.select("g", "node", F.col("node").alias("comp")), sets, percent)


def linked(posted: DataFrame, lists: DataFrame, first: DataFrame, sets: DataFrame, percent: int, spent: tuple[DataFrame, ...]) -> DataFrame:
    """(node, root) of all nodes that have a link: the components `first` (node, root), joined where the posting lists posted (t, node) of lists (t, pivot, m) still hold linked nodes apart. Tables in `spent` are deleted once read."""
    comp = F.coalesce(F.col("root"), F.col("node"))
    placed = posted.select("t", "node").join(first, "node", "left").select("t", "node", comp.alias("comp"))
    split = placed.groupBy("t", "comp").agg(F.count("*").alias("c")).groupBy("t").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).filter("comps > 1").select("t", F.col("top.comp").alias("main"))
    apart = common.stored(placed.join(split, "t").join(lists, "t").select("t", "node", "comp", "main", "pivot", "m"), "apart")
    # a node's group is its component, if that is large, or the pivot of its longest list, so the nodes of a list share few groups; groups fall into blocks
    home = apart.groupBy("node", "comp").agg(F.max(F.struct("m", "pivot")).alias("longest")).select("node", "comp", F.col("longest.pivot").alias("pivot"))
    sized = home.groupBy("comp").agg(F.count("*").alias("c")).filter(F.col("c") >= BLOCK // 2).select("comp", F.lit(True).alias("grown"))
    home = home.join(sized, "comp", "left").select("node", "comp", F.when(F.col("grown"), F.col("comp")).otherwise(F.col("pivot")).alias("home"), F.coalesce("grown", F.lit(False)).alias("grown"))
    blocks = home.groupBy("home", "grown").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    home = common.stored(home.join(blocks, ["home", "grown"]).select("node", "comp", F.xxhash64("home", "grown", F.pmod(F.xxhash64("node"), "parts")).alias("g")), "home")
    straggling = apart.filter("comp <> main").select("t", "node", "comp")
    there = apart.select("t", "node").join(home.select("node", "g"), "node").select("t", "g").distinct()
    asking = straggling.join(there, "t").select("g", "node", "comp").distinct()
    more = meet(home, asking, sets, percent)
    of = first.select(F.col("node").alias("a"), F.col("root").alias("x")), first.select(F.col("node").alias("b"), F.col("root").alias("y"))
    contracted = more.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    second = components(contracted).select(F.col("node").alias("root"), F.col("root").alias("higher"))
    common.drop_stored(*spent, sets, apart, home)  # all that follows reads the two tables of components
    return first.join(second, "root", "full").select(F.coalesce("node", "root").alias("node"), F.coalesce("higher", "root").alias("root")).unionByName(second.select(F.col("root").alias("node"), F.col("higher").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text).

    Texts that are null, empty or without words have an empty set and are linked with nothing. Rows with a null
    doc_id get a null component and are not kept. Rows that share a doc_id count as linked. An empty table gives no
    rows; other columns than doc_id and text are not read.
    """
    return grouped(docs, common.stored(sets_of(docs, size), "sets_of"), size, percent)


def grouped(docs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """near_duplicates() of the rows (doc_id, n, s1, s2, tokens) of docs."""
    docs = docs.select("doc_id", "text")
    nodes = common.stored(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("tokens").alias("tokens")), "nodes")
    root = links(docs, nodes.select("node", "tokens"), size, percent)
    named = nodes.select("s1", "s2", "node").join(root, "node", "left").select("s1", "s2", F.coalesce("root", "node").alias("component_id"))
    whole = rows.select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def dedup(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; columns as in docs, of any name and type.

    Rows with a null doc_id stay. Of rows that repeat a doc_id and text one stays. A doc_id that stands for texts of
    different sets names no document: its rows are compared with nothing and stay, each text once. Texts that are
    null, empty or without words stay.
    """
    rows = common.stored(sets_of(docs, size), "sets_of")
    unclear = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_distinct("s1", "s2").alias("k")).filter("k > 1").select("doc_id")
    near = grouped(docs, rows.join(unclear, "doc_id", "left_anti"), size, percent)
    gone = near.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    named = docs.filter("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti")
    return named.dropDuplicates(["doc_id", "text"]).unionByName(docs.filter("doc_id IS NULL")).select(*(f"`{x}`" for x in docs.columns))


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.load(spark, sf_dir, "documents", "doc_id", "text"))


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS root, doc_id AS node FROM d UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.node),
c AS (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
