"""Line dedup over levelled sorted runs of line hashes.

Batches of documents arrive newest first. A batch's lines become 128-bit hashes of their keys. They meet the sorted
runs so far in an anti-join: a key that no run holds is new, and the batch's largest doc_id with it is its last one of
all; a known key only counts further. Both go into a run of the batch's own. When a level holds more than `fanout`
runs they are compacted into one run of the next level, as in a log-structured merge tree. Runs are tables in the
shared folder, bucketed by key and sorted within a bucket, so joins and merges of runs move no rows between tasks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xxhash import xxh3_128_digest

from braidwork.llm import common

MIN_CHARS, MIN_DOCS = 20, 3
#: What is stripped at both ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"


def keys(text: str | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """The 128-bit hash of each line's key, None where the key has fewer code points. A null or empty text is one empty line."""
    if not text:
        return [None]
    out: list[bytes | None] = []
    for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n"):  # bytes.lower() changes A-Z only
        line = line.strip(BLANKS)
        n = len(line)
        if n >= min_chars and n < 4 * min_chars and not line.isascii():
            n = len(line.decode("utf-8", "surrogatepass"))
        out.append(xxh3_128_digest(line) if n >= min_chars else None)
    return out


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, h1, h2): each key of a document once."""
    schema = "doc_id bigint, h1 bigint, h2 bigint"
    arrow = common.arrow_schema(common.T._parse_datatype_string(schema))

    def run(batches):
        for batch in common.pieces(batches, 1024):
            ids, sizes, found = batch.column(0), [], []
            for cell in batch.column(1):
                own = {k for k in keys(cell.as_py(), min_chars) if k is not None}
                sizes.append(len(own))
                found.extend(own)
            at = np.repeat(np.arange(len(sizes)), sizes)
            h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(h[:, 0]), pa.array(h[:, 1])], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class LineRuns:
    """Runs (h1, h2, n, last): in how many documents of some batches a key is; last, the largest doc_id with it, stands in the run that saw the key first."""

    def __init__(self, spark: SparkSession, fanout: int = 2, min_chars: int = MIN_CHARS):
        self.spark, self.fanout, self.min_chars = spark, fanout, min_chars
        self.buckets = common.parts_of(spark)
        self.levels: list[list[str]] = [[]]
        self.retired: list[str] = []
        self.paths: dict[str, str] = {}

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _write(self, run: DataFrame, level: int) -> DataFrame:
        name = f"braidwork_run_{uuid.uuid4().hex}"
        self.paths[name] = common.scratch_path(self.spark, f"run{level}")
        run.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("compression", "none").option("path", self.paths[name]).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return self.spark.table(name)

    def _merge(self, runs: list[str]) -> DataFrame:
        """One row per key. Tables of the same buckets are joined in pairs without a shuffle (a union would lose the buckets)."""
        out = self.spark.table(runs[0])
        for name in runs[1:]:
            other = self.spark.table(name).select("h1", "h2", F.col("n").alias("n2"), F.col("last").alias("last2"))
            out = out.join(other, ["h1", "h2"], "full").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"), F.coalesce("last", "last2").alias("last"))
        return out

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds a batch whose doc_ids are all under those of earlier batches. The result: (h1, h2, n, last) of its keys that no earlier run holds, readable until release()."""
        batch = line_hashes(docs, self.min_chars).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        for name in self.names():
            # an anti-join that keeps the known keys too, for their counts: only what no run holds keeps its last
            held = self.spark.table(name).select("h1", "h2", F.lit(True).alias("held"))
            batch = batch.join(held, ["h1", "h2"], "left").select("h1", "h2", "n", F.when(F.col("held").isNull(), F.col("last")).alias("last"))
        own = self._write(batch, 0)
        self.compact()
        return own.filter(F.col("last").isNotNull())

    def compact(self) -> None:
        """Merges every level of more than fanout runs into one run of the next. What was merged is deleted by release()."""
        for level in range(len(self.levels)):
            if len(self.levels[level]) > self.fanout:
                old, self.levels[level] = self.levels[level], []
                self._write(self._merge(old), level + 1)
                self.retired += old

    def totals(self) -> DataFrame | None:
        """(h1, h2, n, last) of all keys."""
        return self._merge(self.names()) if self.names() else None

    def pairs(self) -> int:
        """Of all documents the numbers of distinct keys, summed."""
        return sum(self.spark.table(name).agg(F.sum("n")).first()[0] or 0 for name in self.names())

    def release(self) -> None:
        """Deletes the runs that were merged into others: no frame of add() may be read after it."""
        self._drop(self.retired)
        self.retired = []

    def drop(self) -> None:
        """Deletes all runs, tables and files."""
        self.release()
        self._drop(self.names())
        self.levels = [[]]

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            common.discard(self.spark, self.paths.pop(name))


#: A key in more than 1 / HOT of all (document, key) pairs is hot. There are at most HOT such keys, so they can be broadcast at any size of the corpus.
HOT = 10_000


def gone_lines(found: DataFrame, repeated: DataFrame, pairs: int) -> DataFrame:
    """(doc_id, h1, h2) of the found lines that are in repeated (h1, h2, n, last) and not in the last document. Hot keys meet their lines by a broadcast of HOT rows at most; the others by a merge join, where no key has many rows."""
    hot = repeated.filter(F.col("n") > F.lit(pairs / HOT)).select("h1", "h2", F.col("last").alias("hot_last"))
    met = found.join(F.broadcast(hot), ["h1", "h2"], "left")
    # what is hot takes no part in the second join: its key becomes one that no run has, dealt by document
    away = F.col("hot_last").isNotNull()
    met = met.select("doc_id", "h1", "h2", "hot_last", F.when(away, F.xxhash64("doc_id", "h1")).otherwise(F.col("h1")).alias("k1"), F.when(~away, F.col("h2")).alias("k2"))
    rest = repeated.filter(F.col("n") <= F.lit(pairs / HOT)).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "last")
    last = F.coalesce("hot_last", "last")
    return met.join(rest, ["k1", "k2"], "left").filter(F.col("doc_id") < last).select("doc_id", "h1", "h2")


def drop_lines(docs: DataFrame, runs: LineRuns, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (text) of every row: lines in min_docs documents or more go, but for those of the largest doc_id."""
    docs = docs.select("doc_id", "text")
    repeated = common.stored(runs.totals().filter(F.col("n") >= min_docs), "repeated")
    gone = gone_lines(line_hashes(docs, runs.min_chars), repeated, runs.pairs()).groupBy("doc_id").agg(F.flatten(F.collect_set(F.array("h1", "h2"))).alias("gone"))
    schema = "doc_id bigint, n_lines bigint, n_dropped bigint, kept string"
    min_chars = runs.min_chars

    def make():
        def each(rows):
            out = {k: [] for k in ("n_lines", "n_dropped", "kept")}
            for text, gone in zip(rows["text"], rows["gone"]):
                lines = (text or "").split("\n")
                kept = lines
                if gone:
                    data = np.array(gone, "<i8").tobytes()
                    gone = {data[i : i + 16] for i in range(0, len(data), 16)}
                    kept = [x for x, k in zip(lines, keys(text, min_chars)) if k is None or k not in gone]
                out["n_lines"].append(len(lines))
                out["n_dropped"].append(len(lines) - len(kept))
                out["kept"].append("\n".join(kept))
            return {"doc_id": rows["doc_id"]} | out

        return each

    return common.map_rows(docs.join(gone, "doc_id", "left").select("doc_id", "text", "gone"), make, schema)


def dedup(docs: DataFrame, batches: int = 4, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, fanout: int = 2) -> DataFrame:
    """All documents in batches of descending doc_id through the runs, then without their repeated lines.

    Null and empty texts are one empty line, which is too short to go. Documents with a null doc_id keep all
    lines. Rows that repeat a doc_id count as documents of their own and, if that is the largest, all keep the line.
    An empty table gives no rows; other columns than doc_id and text are not read.
    """
    docs = docs.select("doc_id", "text")
    runs = LineRuns(docs.sparkSession, fanout, min_chars)
    at = common.cuts(docs, "doc_id", batches)
    bounds = [None, *at, None]
    for low, high in reversed(list(zip(bounds, bounds[1:]))):
        part = docs.filter(F.col("doc_id").isNotNull())
        part = part if low is None else part.filter(F.col("doc_id") >= low)
        runs.add(part if high is None else part.filter(F.col("doc_id") < high))
        runs.release()
    out = drop_lines(docs, runs, min_docs)
    runs.drop()  # what is repeated has been written by now
    return out


def op6_lines(spark, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents", "doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, 1 + len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
t AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, t.last IS NOT NULL AND k.doc_id <> t.last AS gone FROM k LEFT JOIN t USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
