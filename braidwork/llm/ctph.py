"""Context-triggered piecewise hashing.

A rolling hash over 7 bytes marks positions; a position whose hash has k trailing zero bits is a boundary at block
size 2**k. Chunks end at the first boundary that is a quarter of a block away or more; where none comes for four
blocks, as in text that repeats itself, at the position of most zero bits there, so that such text has chunks as well
and the same ones each time. Each chunk gives one of 64 signs. A fingerprint is `block:signature:signature of twice
the block`; the block is the largest of which the text has LEAST, so texts of about the same length can always be
compared. Fingerprints are compared, where their block sizes are equal or one is twice the other, by the edit distance
(insertions and deletions) of the signatures of the same block size.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm import common

WINDOW, LEAST, LEVELS = 7, 64, 32
SIGNS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
ROLL = np.uint64(0x9E3779B97F4A7C15)
STEP = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP**i and its inverse, modulo 2**64, for i < n at least; grown by doubling."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        up = np.full(size, STEP, np.uint64)
        up[0] = 1
        down = np.full(size, pow(STEP, -1, 1 << 64), np.uint64)
        down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def levels(b: np.ndarray) -> np.ndarray:
    """Trailing zero bits of the rolling hash at each byte, LEVELS - 1 at most."""
    h = np.zeros(len(b), np.uint64)
    mixed = (b.astype(np.uint64) + np.uint64(1)) * ROLL
    m = np.uint64(0x2545F4914F6CDD1D)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(min(WINDOW, len(b))):
            h[j:] += mixed[: len(b) - j] * factor
            factor = factor * m
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    low = (h & (~h + np.uint64(1))) & np.uint64((1 << (LEVELS - 1)) - 1)
    return np.where(low == 0, LEVELS - 1, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int8)).astype(np.int8)


def cut(level: np.ndarray, size: int) -> np.ndarray:
    """Positions after the chunks' last bytes at block size 2**size."""
    n, least, block, most = len(level), max(1, (1 << size) // 4), 1 << size, 4 << size
    bounds = (np.flatnonzero(level >= size) + 1).tolist()
    ends, at, i = [], 0, 0
    while at < n:
        i = bisect_left(bounds, at + least, i)
        end = bounds[i] if i < len(bounds) else n
        if end - at > most:
            window = level[at + block : at + most]
            end = at + block + len(window) - int(window[::-1].argmax())
        ends.append(end)
        at = end
    return np.array(ends)


def signature(prefix: np.ndarray, down: np.ndarray, ends: np.ndarray) -> str:
    """prefix[i] is the sum of (byte + 1) * STEP**i before i."""
    starts = np.concatenate([[0], ends[:-1]])
    h = (prefix[ends] - prefix[starts]) * down[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return SIGNS[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str | None) -> str:
    """Of the whole text in UTF-8; null and empty texts have '1::'."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return "1::"
    b = np.frombuffer(data, np.uint8)
    up, down = powers(n + 1)
    level = levels(b)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
        k = max(0, (n // LEAST).bit_length() - 1)
        own, twice = (signature(prefix, down, cut(level, size)) for size in (k, k + 1))
    return f"{1 << k}:{own}:{twice}"


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    get = where.get
    for c in b:
        u = v & get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def likeness_of(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if len(a) > 16 and len(b) > 16:
        grams = {a[i : i + 4] for i in range(len(a) - 3)}
        if not any(b[i : i + 4] in grams for i in range(len(b) - 3)):
            return 0.0  # signatures of unrelated texts share signs, not runs of them
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: 1 for equal fingerprints, 0 for incompatible block sizes; two empty texts are alike."""
    if a == b:
        return 1.0
    (x, x1, x2), (y, y1, y2) = a.split(":"), b.split(":")
    if x == y:
        return max(likeness_of(x1, y1), likeness_of(x2, y2))
    if int(x) == 2 * int(y):
        return likeness_of(x1, y2)
    if int(y) == 2 * int(x):
        return likeness_of(x2, y1)
    return 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row of docs."""

    def make():
        return lambda rows: {"doc_id": rows["doc_id"], "fingerprint": [fingerprint(t) for t in rows["text"]]}

    return common.map_rows(docs.select("doc_id", "text"), make, "doc_id bigint, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """(part, ahead, doc_id, text): rows dealt by ranges of doc_id, the first document of a range also sent to the range before it (ahead), the first of all to the last."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    at = common.cuts(docs, "doc_id", common.parts_of(docs.sparkSession))
    dealt = docs.withColumn("part", common.range_index(F.col("doc_id"), at))
    firsts = [(r["part"], r["low"]["doc_id"]) for r in dealt.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("low")).orderBy("part").collect()]  # a row per range
    back = [(part, low, firsts[i - 1][0]) for i, (part, low) in enumerate(firsts)]
    where = F.broadcast(docs.sparkSession.createDataFrame(back, "part int, low bigint, back int"))  # a row per range
    own, ahead = F.struct(F.col("part").alias("part"), F.lit(False).alias("ahead")), F.struct(F.col("back").alias("part"), F.lit(True).alias("ahead"))
    copies = F.when(F.col("doc_id").eqNullSafe(F.col("low")), F.array(own, ahead)).otherwise(F.array(own))
    sent = dealt.join(where, "part").select("doc_id", "text", F.explode(copies).alias("c")).select("c.part", "c.ahead", "doc_id", "text")
    # a range is a partition: its number is the partition's
    return sent.repartitionById(max(1, len(at) + 1), "part").sortWithinPartitions("part", "ahead", "doc_id", "text")


def edit_study(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every row.

    The next document follows by doc_id (nulls first), then text; rows that repeat a doc_id follow each other. A
    sole document follows itself. Texts are shuffled once; a partition is read as a sorted stream that holds one
    document back.
    """
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    arrow = common.arrow_schema(common.T._parse_datatype_string(schema))
    rows = with_next(docs)

    def finish(held, text, mark):
        doc_id, own, own_mark = held
        n = len(own)
        k = n // 4
        edited = own[: n - k] + text[:k]
        edited_mark = own_mark if edited == own else fingerprint(edited)
        return (doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own_mark, edited_mark, likeness(own_mark, edited_mark), likeness(own_mark, mark))

    def run(batches):
        part, held = None, None
        for batch in common.pieces(batches):
            out = []
            for p, ahead, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if p != part:
                    part, held = p, None
                if ahead and held is None:
                    continue  # rows that repeat the first id: the one before took the next row
                mark = fingerprint(text)
                if held is not None:
                    out.append(finish(held, text, mark))
                held = None if ahead else (doc_id, text, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edit_study(common.load(spark, sf_dir, "documents", "doc_id", "text"))
