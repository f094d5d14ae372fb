"""Sets at a Jaccard similarity or above, exactly, by PartEnum signatures.

Sets fall into bands of sizes, each as wide as the similarity allows: linked sets are of one band or of two that
follow one another. A band i has a bound k of how many shingles two sets can differ in that are linked and of which
the smaller one is in it. The domain of shingles is dealt by hash to n1 partitions of PARTS parts each; with
n1 = k // 2 + 1 + spare partitions, at least 1 + spare of them hold one difference at most, and in such a partition
two of its three parts are the same. So the signatures of a band are, for each partition, what the set has in each
two of its three parts; a set has those of its own band and those of the band below, in which its smaller partners
are. Linked sets share a signature for certain.

A signature that tells nothing, as it holds none of a set's shingles or only very common ones, would be that of
many. Sets with at most `spare` partitions that have such a signature leave those signatures out: of the partitions that
such a set agrees on with any partner, one is left of which all signatures tell something. The others (open sets) post
them too; a pair that needs one is open on both sides. Which shingles count as common is read from a sample of
the sets; it has no bearing on the result, only on the work.

Equal sets are one node. Signatures that several nodes share give candidates: all that share one meet its largest
node first, and links are confirmed on the full sets. What that connects is one component. Only nodes that are apart
after that meet the others of their signature, in blocks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm import common, minhash
from braidwork.operators.components import components

SHINGLE, PERCENT = 4, 85
#: Parts of a partition; a signature holds all but one of them.
PARTS = 3
#: Of so many sets at most, by hash of their id, shingles in at least this share count as common.
SAMPLE_SETS, COMMON_SHARE = 4096, 0.01
#: Sets that a task remembers to have posted.
REMEMBERED = 1 << 20


def bands(largest: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(least, most) sizes of each band, from 1 up to the one that holds `largest`; a set's partners are at most 100 / percent times its size."""
    out, low = [], 1
    while low <= largest:
        high = low * 100 // percent
        out.append((low, high))
        low = high + 1
    return out


def difference(high: int, percent: int = PERCENT) -> int:
    """In how many elements linked sets differ at most of which the smaller has up to `high`: of sizes a and b, at most (a + b) * (100 - percent) / (100 + percent)."""
    return (high + high * 100 // percent) * (100 - percent) // (100 + percent)


def spare(k: int) -> int:
    """Partitions that a set may leave out."""
    return (k + 1) // 16


@lru_cache
def _bands(percent: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = zip(*bands(1 << 40, percent))
    return np.array(low), np.array(high)


def of_band(s: np.ndarray, rare: np.ndarray, band: int, k: int) -> np.ndarray:
    """The signatures in a band of bound k of a set of hashes, of which `rare` tells the shingles that aren't common."""
    extra = spare(k)
    n1 = k // 2 + 1 + extra
    part = (minhash.mixed(s ^ np.uint64(0x5851F42D4C957F2D + band)) % np.uint64(n1 * PARTS)).astype(np.int64)
    value = np.zeros(n1 * PARTS, np.uint64)
    np.add.at(value, part, minhash.mixed(s + np.uint64(0x9E3779B97F4A7C15)))
    value = value.reshape(n1, PARTS)
    subset = value.sum(1, dtype=np.uint64)[:, None] - value  # all parts but one
    has = np.bincount(part[rare], minlength=n1 * PARTS).reshape(n1, PARTS)
    mute = has.sum(1)[:, None] == has  # tells nothing; that is a property of what the signature holds, so the same in both sets of a pair
    open_ = int(mute.any(1).sum()) > extra
    place = (np.arange(n1 * PARTS, dtype=np.uint64).reshape(n1, PARTS) << np.uint64(16)) | np.uint64(band << 1) | mute.astype(np.uint64)
    out = minhash.mixed(subset + minhash.mixed(place))
    return out.ravel() if open_ else out[~mute]


def signatures(s: np.ndarray, commons: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """All signatures of a set of sorted hashes: of its own band, and of the one below. Sets that can't be linked with any other have none."""
    n = len(s)
    if not n:
        return np.zeros(0, np.uint64)
    rare = np.ones(n, bool)
    if len(commons):
        rare = commons[np.minimum(np.searchsorted(commons, s), len(commons) - 1)] != s
    low, high = _bands(percent)
    band = int(np.searchsorted(low, n, "right")) - 1
    bound = [(b, difference(int(high[b]), percent)) for b in (band, band - 1) if b >= 0]
    return np.concatenate([np.zeros(0, np.uint64), *(of_band(s, rare, b, k) for b, k in bound if k)])


def set_hash(s: np.ndarray) -> tuple[int, int]:
    h = np.frombuffer(minhash.xxh3_128_digest(s.tobytes()), "<i8")
    return int(h[0]), int(h[1])


def sets_of(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n, s1, s2, key) of every row: set size, the 128-bit hash of the set, and its key."""

    def make():
        def each(rows):
            sets = [minhash.shingles(t, size) for t in rows["text"]]
            hashes = [set_hash(s) for s in sets]
            return {"doc_id": rows["doc_id"], "n": [len(s) for s in sets], "s1": [h[0] for h in hashes], "s2": [h[1] for h in hashes], "key": [key_of(h[0], len(x)) for h, x in zip(hashes, sets)]}

        return each

    return common.map_rows(docs.select("doc_id", "text"), make, "doc_id bigint, n bigint, s1 bigint, s2 bigint, key bigint")


def common_shingles(docs: DataFrame, nodes: DataFrame, size: int) -> np.ndarray:
    """Hashes of the shingles that COMMON_SHARE of a sample of the nodes have; at most the average size of a set / COMMON_SHARE of them."""
    n = nodes.count()
    share = max(1, -(-n // SAMPLE_SETS))
    some = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).select("node")

    def make():
        return lambda rows: {"h": [minhash.shingles(t, size).view(np.int64).tolist() for t in rows["text"]]}

    sampled = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).join(some.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    hashes = common.map_rows(sampled.select("text"), make, "h array<bigint>").select(F.explode("h").alias("h"))
    found = hashes.groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") >= max(2, int(COMMON_SHARE * min(n, SAMPLE_SETS)))).select("h").collect()
    return np.sort(np.array([r.h for r in found], np.int64).view(np.uint64))


def key_of(s1: int, n: int) -> int:
    """What stands for a set of n shingles among signatures: 56 bits of its hash and 8 of its size. Sets that share a key are told apart later."""
    return (s1 & ~255) | (min(255, int(8 * np.log2(n))) if n else 0)


def posted(docs: DataFrame, commons: np.ndarray, size: int, percent: int) -> DataFrame:
    """(key, t): every signature of every set that can have a link, once or more. Of equal sets a task posts one, so texts needn't be dealt by set."""

    def make():
        seen: set[int] = set()

        def each(rows):
            out = {"key": [], "ts": []}
            for text in rows["text"]:
                s = minhash.shingles(text, size)
                if not len(s):
                    continue
                key = key_of(set_hash(s)[0], len(s))
                if key in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
                out["key"].append(key)
                out["ts"].append(signatures(s, commons, percent).view(np.int64).tolist())
            return out

        return each

    return common.map_rows(docs.filter("doc_id IS NOT NULL").select("text"), make, "key bigint, ts array<bigint>").select("key", F.explode("ts").alias("t"))


def links(docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root) of the nodes (node, key, n) that have a link."""
    every = posted(docs, common_shingles(docs, nodes, size), size, percent)
    of = Window.partitionBy("t")
    bucket = F.pmod("key", F.lit(256))
    middle = F.min(F.struct(F.abs(bucket - F.col("mean")), "key")).over(of)  # the pivot: a set of about the middle size
    shared = every.withColumns({"m": F.count("*").over(of), "mean": F.avg(bucket).over(of), "low": F.min("key").over(of), "high": F.max("key").over(of)}).filter("low <> high")
    shared = common.stored(shared.withColumn("pivot", middle["key"]).select("t", "key", "m", "pivot").distinct(), "shared")
    of_pivot = nodes.select(F.col("key").alias("pivot_key"), F.col("node").alias("pivot"), F.col("n").alias("pivot_n"))
    pairs = shared.filter(F.col("key") != F.col("pivot")).groupBy("key", F.col("pivot").alias("pivot_key")).agg(F.max("m").alias("m"))
    fit = 100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")
    stars = common.stored(pairs.join(nodes, "key").join(of_pivot, "pivot_key").filter(fit).select("node", "pivot", "m"), "stars")
    wanted = nodes.join(shared.select("key").distinct(), "key", "left_semi").select("node")
    sets = common.stored(minhash.full_sets(docs, wanted, size), "sets")
    first = components(minhash.met_pivots(stars, sets, percent))
    lists = shared.filter(F.col("key") == F.col("pivot")).select("t", F.col("pivot").alias("pivot_key"), "m").join(of_pivot, "pivot_key").groupBy("t").agg(F.min("pivot").alias("pivot"), F.max("m").alias("m"))
    return minhash.linked(shared.join(nodes, "key").select("t", "node"), lists, first, sets, percent, (shared, stars))


def similar_sets(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs (doc_id, text).

    Texts that are null, empty or without words have an empty set and are linked with nothing. Rows with a null
    doc_id get a null component. Rows that share a doc_id count as linked. An empty table gives no rows; other columns
    than doc_id and text are not read.
    """
    docs = docs.select("doc_id", "text")
    rows = common.stored(sets_of(docs, size), "sets_of")
    nodes = common.stored(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("key").alias("key")), "nodes")
    root = links(docs, nodes.select("node", "key", "n"), size, percent)
    named = nodes.join(root, "node", "left").select("s1", "s2", F.coalesce("root", "node").alias("of_set"))
    whole = rows.join(named, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("of_set")).otherwise(F.col("doc_id"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def op13_partenum(spark, sf_dir: str) -> DataFrame:
    return similar_sets(common.load(spark, sf_dir, "documents", "doc_id", "text"))


OP13_SQL = minhash.OP3_SQL.replace("80 *", f"{PERCENT} *").replace(", d.doc_id = c.component_id AS kept", "")
