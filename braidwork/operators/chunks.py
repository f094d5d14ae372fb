"""Sequences that are longer than a row should be: (rec_ix, chunk, before, seq, after).

A record is cut into chunks of `size` characters, the last one shorter; chunk i starts at i * size. `before` and
`after` repeat up to `overlap` characters of the record on either side, so what looks at neighbouring characters needs
no other row. What reaches further (gaps between pieces, runs, places in the compressed sequence) is settled by tables
of a row or two per chunk; the sequences themselves are shuffled only where the result puts them together anew.
Results don't depend on the size of the chunks, 1 included. Null sequences are empty; an empty record has no chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidwork import session
from braidwork.functions import seq as S
from braidwork.operators import records as R

c = F.col
SIZE, OVERLAP = 1 << 20, 64
SCHEMA = "rec_ix bigint, chunk bigint, before string, seq string, after string"
#: Rows and characters (places) of a batch that a task hands back: short chunks go many at a time, long ones don't fill its memory.
BATCH_ROWS, BATCH_SIZE = 8192, 1 << 22


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _batched(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows as batches; the last column of a row tells its size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) >= BATCH_ROWS or size >= BATCH_SIZE:
            yield _batch(held, names, kinds)
            held, size = [], 0
    if held:
        yield _batch(held, names, kinds)


def chunked(records: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The chunks of records (rec_ix, seq). One scan of each."""
    names, kinds = ["rec_ix", "chunk", "before", "after", "seq"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def cut(batches):
        for batch in batches:
            for rec, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = cell.as_py() or ""
                for a in range(0, len(text), size):
                    yield rec, a // size, text[max(a - overlap, 0) : a], text[a + size : a + size + overlap], text[a : a + size]

    def run(batches):
        for batch in _batched(cut(batches), names, kinds):
            yield batch.select(["rec_ix", "chunk", "before", "seq", "after"])

    return records.select(c("rec_ix").cast("bigint"), "seq").mapInArrow(run, SCHEMA)


def rechunked(fragments: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The chunks of records given as fragments (rec_ix, offset, seq) of any lengths that cover each record once. A group is put together from what lies in one chunk and its overlaps."""

    def cut(batches):
        for batch in batches:
            for rec, at, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = cell.as_py() or ""
                first, last = max(at - overlap, 0) // size, (at + len(text) - 1 + overlap) // size
                for i in range(first, last + 1) if text else ():
                    low, high = max(i * size - overlap, at), min((i + 1) * size + overlap, at + len(text))
                    if low < high:
                        yield rec, i, low, text[low - at : high - at]

    def run(batches):
        return _batched(cut(batches), ["rec_ix", "chunk", "at", "part"], [pa.int64(), pa.int64(), pa.int64(), pa.string()])

    parts = fragments.select(c("rec_ix").cast("bigint"), c("offset").cast("bigint"), "seq").mapInArrow(run, "rec_ix bigint, chunk bigint, at bigint, part string")
    whole = parts.groupBy("rec_ix", "chunk").agg(F.min("at").alias("low"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("text"))
    lead = (c("chunk") * size - c("low")).cast("int")
    cut = lambda start, n: F.substring(c("text"), start, n)
    return whole.filter(F.length("text") > lead).select("rec_ix", "chunk", cut(F.lit(1), lead).alias("before"), cut(lead + 1, F.lit(size)).alias("seq"), cut(lead + 1 + size, F.lit(overlap)).alias("after"))


def read_fasta_chunks(spark: SparkSession, path: str, size: int = SIZE, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """(rec_ix, id, desc) and the chunks of the records of FASTA files of any size, numbered from 0 in the order of the files' names and of their lines.

    Files are read by lines in splits, so a chromosome is read by many tasks. What a split holds before its first
    header belongs to a record of an earlier split: how many headers and characters the splits before hold is summed
    over a row per split. Characters before the first header of a file belong to no record.
    """
    lines = spark.read.text(path).select("value", c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("block"))
    names = ["file", "block", "own", "offset", "header", "seq"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        split, own, at, held, start, n, out = None, 0, 0, [], 0, 0, []

        def piece(header=None):
            return (*split, own, start, header, "".join(held))

        for batch in batches:
            for value, file, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (file, block) != split:
                    if held:
                        out.append(piece())
                    split, own, at, held, start, n = (file, block), 0, 0, [], 0, 0
                if value.startswith(">"):
                    if held:
                        out.append(piece())
                    own, at, held, start, n = own + 1, 0, [], 0, 0
                    out.append((*split, own, 0, value[1:].rstrip(), ""))
                    continue
                value = value.strip()
                held.append(value)
                n += len(value)
                at += len(value)
                if n >= size:
                    out.append(piece())
                    held, start, n = [], at, 0
            if out:
                yield _batch(out, names, kinds)
                out = []
        if held:
            yield _batch([piece()], names, kinds)

    parts = lines.mapInArrow(run, "file string, block bigint, own bigint, offset bigint, header string, seq string")
    lead = F.sum(F.when(c("own") == c("last"), F.length("seq")).otherwise(0))
    last = parts.groupBy("file", "block").agg(F.max("own").alias("last"))
    splits = parts.join(last, ["file", "block"]).groupBy("file", "block", "last").agg(lead.alias("tail"))
    order = Window.orderBy("file", "block")  # a row per split
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # characters since the last header before the split: those of the splits since the last one with a header
    splits = splits.withColumn("headers", F.coalesce(F.sum("last").over(before), F.lit(0))).withColumn("run", F.sum(F.when(c("last") > 0, 1).otherwise(0)).over(order))
    since = F.sum("tail").over(Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.withColumn("since", since).withColumn("open", F.sum("last").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    carried = Window.partitionBy("file").orderBy("block")
    # a split that has a header of its own still starts in the run before
    splits = splits.withColumn("through", F.coalesce("since", F.lit(0)) + c("tail"))
    splits = splits.withColumn("shift", F.when(c("last") > 0, F.lag("through").over(carried)).otherwise(c("since")))
    placed = parts.join(F.broadcast(splits.select("file", "block", "headers", "open", F.coalesce("shift", F.lit(0)).alias("shift"))), ["file", "block"])
    rec = (c("headers") + c("own") - 1).alias("rec_ix")
    of_record = placed.filter((c("own") > 0) | (c("open") > 0))
    fragments = of_record.filter("header IS NULL").select(rec, (c("offset") + F.when(c("own") == 0, c("shift")).otherwise(0)).alias("offset"), "seq")
    heads = placed.filter("header IS NOT NULL").select(rec, F.regexp_extract("header", r"^(\S*)", 1).alias("id"), F.nullif(F.regexp_extract("header", r"^\S*\s+(.*)$", 1), F.lit("")).alias("desc"))
    return heads, rechunked(fragments, size, overlap)


def joined(chunks: DataFrame) -> DataFrame:
    """(rec_ix, seq): whole records again, for where they are known to fit a row."""
    return chunks.groupBy("rec_ix").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "seq"))), lambda x: x["seq"]), "").alias("seq"))


def lengths(chunks: DataFrame) -> DataFrame:
    """(rec_ix, length)."""
    return chunks.groupBy("rec_ix").agg(F.sum(F.length("seq")).alias("length"))


def is_dna(chunks: DataFrame) -> DataFrame:
    """(rec_ix, valid): nothing but ACGT."""
    return chunks.groupBy("rec_ix").agg(F.bool_and(S.is_dna(c("seq"))).alias("valid"))


def mapped(chunks: DataFrame, of) -> DataFrame:
    """Chunks through a function of single characters (S.complement, S.ascii_upper), the overlaps too."""
    return chunks.withColumns({x: of(c(x)) for x in ("before", "seq", "after")})


def reverse_complement(chunks: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The chunks of the reverse complements: what was last comes first, so borders move."""
    end = chunks.select("rec_ix", "chunk", "seq").join(lengths(chunks), "rec_ix")
    turned = end.select("rec_ix", (c("length") - c("chunk") * size - F.length("seq")).alias("offset"), S.reverse_complement(c("seq")).alias("seq"))
    return rechunked(turned, size, overlap)


def kmer_pieces(chunks: DataFrame, k: int, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(rec_ix, seq): pieces that together hold each k-mer of each record as often as the record does, for any of the k-mer operators.

    With an overlap of k - 1 or more a chunk and what follows it; else the windows over borders are put together from
    the ends of chunks alone.
    """
    if overlap >= k - 1:
        return chunks.select("rec_ix", F.concat("seq", F.substring("after", 1, k - 1)).alias("seq"))
    if k == 1:
        return chunks.select("rec_ix", "seq")
    reach = -(-(k - 1) // size)
    tail = chunks.select("rec_ix", "chunk", F.lit(0).alias("place"), F.expr(f"right(seq, {k - 1})").alias("part"))
    heads = chunks.select("rec_ix", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("place"), "chunk", F.substring("seq", 1, k - 1).alias("part"))
    heads = heads.select("rec_ix", (c("chunk") - c("place")).alias("chunk"), "place", "part").filter("chunk >= 0")
    met = tail.unionByName(heads).groupBy("rec_ix", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "part"))).alias("parts"))
    own = F.get("parts", F.lit(0))["part"]
    over = met.select("rec_ix", F.substring(F.array_join(F.transform("parts", lambda x: x["part"]), ""), F.lit(1), F.length(own) + k - 1).alias("seq"))
    return chunks.select("rec_ix", "seq").unionByName(over)


def homopolymer_compress(chunks: DataFrame) -> DataFrame:
    """(rec_ix, chunk, seq): each chunk's part of the record with every run of a character as one; a run belongs to the chunk it starts in, and a leading run of N vanishes. Needs an overlap of 1."""
    one = F.regexp_replace("seq", r"(?s)(.)\1+", "$1")
    goes_on = (F.length("before") > 0) & (F.expr("right(before, 1)") == F.substring("seq", 1, 1))
    cut = F.when(goes_on, F.substring(one, 2, 1 << 30)).when(c("chunk") == 0, F.regexp_replace(one, "^N", "")).otherwise(one)
    return chunks.select("rec_ix", "chunk", cut.alias("seq"))


def runs(chunks: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(rec_ix, chunk, first, n, places) and (rec_ix, chunk, starts), both written: how many runs start before each chunk and in it, and the sum of their 0-based places in the raw record; and their places in the chunk, so that the compressed place `first` + i is `starts[i]` of that chunk. A leading run of N counts. Needs an overlap of 1."""
    def each(batches):
        for batch in batches:
            rows, held, n = [], [], 0
            for i in range(batch.num_rows + 1):
                if held and (n >= BATCH_SIZE or i == batch.num_rows):
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32)
                    starts = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))
                    at = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), starts], names=["rec_ix", "chunk", "starts"])
                    rows, held, n = [], [], 0
                if i < batch.num_rows:
                    last, text = batch.column(2)[i].as_py()[-1:], batch.column(3)[i].as_py()
                    points = np.frombuffer((last + text).encode("utf-32-le", "surrogatepass"), "<u4")
                    own = np.flatnonzero(points[1:] != points[:-1]) + (0 if last else 1)
                    own = own if last or not text else np.concatenate([[0], own])
                    rows.append(i)
                    held.append(own.astype(np.int32))
                    n += len(own)

    found = session.stored(chunks.select("rec_ix", "chunk", "before", "seq").mapInArrow(each, "rec_ix bigint, chunk bigint, starts array<int>"), "starts")
    n = F.size("starts").cast("bigint")
    counts = found.select("rec_ix", "chunk", n.alias("n"), (F.aggregate("starts", F.lit(0).cast("bigint"), lambda a, x: a + x) + n * c("chunk") * size).alias("places"))
    first = F.sum("n").over(Window.partitionBy("rec_ix").orderBy("chunk")) - c("n")
    return session.stored(counts.select("rec_ix", "chunk", first.alias("first"), "n", "places"), "runs"), found


def to_raw(places: DataFrame, found: tuple[DataFrame, DataFrame], raw: DataFrame, size: int = SIZE) -> DataFrame:
    """places (rec_ix, place, any others), 0-based in compressed records, with raw_place, through runs() and lengths(); a place after the last run is the raw length. Chunks and places meet in blocks of `size` compressed places, of which a chunk touches two at most; only a place's own chunk meets its starts."""
    counts, starts = found
    last = c("_first") + c("_n") - 1
    held = counts.filter("n > 0").select("rec_ix", c("chunk").alias("_chunk"), c("first").alias("_first"), c("n").alias("_n"))
    held = held.withColumn("_block", F.explode(F.array_distinct(F.array(F.floor(c("_first") / size), F.floor(last / size)))))
    hit = places.withColumn("_block", F.floor(c("place") / size)).join(held, ["rec_ix", "_block"]).filter(c("place").between(c("_first"), last))
    at = F.get("_starts", (c("place") - c("_first")).cast("int")) + c("_chunk") * size
    # places beyond the last run have no chunk, in a block that others may have
    known = hit.join(starts.select("rec_ix", c("chunk").alias("_chunk"), c("starts").alias("_starts")), ["rec_ix", "_chunk"]).select(*places.columns, at.alias("raw_place"))
    total = counts.groupBy("rec_ix").agg(F.sum("n").alias("_total")).join(raw, "rec_ix")
    beyond = places.join(total, "rec_ix").filter(c("place") >= c("_total")).select(*places.columns, c("length").alias("raw_place"))
    return known.unionByName(beyond)


def gap_parts(chunks: DataFrame, min_length: int, size: int = SIZE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rec_ix, offset, part) of the pieces that lie inside a chunk; (rec_ix, offset, length) of those over borders, and (rec_ix, offset, at, part), their parts. Pieces are what break_at_gaps() tells. Parts are found once and written.

    A part that starts right at its chunk's border goes on a piece where the character before is no gap; which one is
    told by the last part that starts anew, over the parts at borders alone. Another character than ACGTN- fails the
    query. Needs an overlap of 1.
    """
    piece = re.compile("[^N-]+")
    names, kinds = ["rec_ix", "at", "end", "anew", "ends", "part"], [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]

    unknown = re.compile("[^ACGTN-]")

    def cut(batches):
        for batch in batches:
            for rec, chunk, before, text, after in zip(*(batch.column(i).to_pylist() for i in range(5))):
                text = text.upper()
                if unknown.search(text):
                    raise ValueError("unknown character")
                at = chunk * size
                left, right = before[-1:].upper() not in ("", "N", "-"), after[:1].upper() not in ("", "N", "-")
                for m in piece.finditer(text):
                    anew, ends = not (m.start() == 0 and left), not (m.end() == len(text) and right)
                    if not (anew and ends) or m.end() - m.start() >= min_length:
                        yield rec, at + m.start(), at + m.end(), anew, ends, m[0]

    def run(batches):
        return _batched(cut(batches), names, kinds)

    parts = session.stored(chunks.mapInArrow(run, "rec_ix bigint, at bigint, end bigint, anew boolean, ends boolean, part string"), "parts")
    whole = c("anew") & c("ends")
    on_border = parts.filter(~whole).select("rec_ix", "at", "end", "anew")
    start = F.last(F.when(c("anew"), c("at")), ignorenulls=True).over(Window.partitionBy("rec_ix").orderBy("at"))
    named = on_border.withColumn("offset", start)
    pieces = named.groupBy("rec_ix", "offset").agg(F.sum(c("end") - c("at")).alias("length")).filter(c("length") >= min_length)
    border_parts = parts.filter(~whole).join(named.select("rec_ix", "at", "offset").join(pieces.select("rec_ix", "offset"), ["rec_ix", "offset"], "left_semi"), ["rec_ix", "at"])
    return parts.filter(whole).select("rec_ix", c("at").alias("offset"), "part"), pieces, border_parts.select("rec_ix", "offset", "at", "part")


def break_at_gaps(chunks: DataFrame, min_length: int, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(rec_ix, offset, length) of the pieces between runs of N or -, upper case, of min_length or more, and (rec_ix, offset, at, part): their parts, chunk by chunk, with their places in the record."""
    own, pieces, parts = gap_parts(chunks, min_length, size)
    every = own.select("rec_ix", "offset", F.length("part").cast("bigint").alias("length")).unionByName(pieces)
    return every, own.select("rec_ix", "offset", c("offset").alias("at"), "part").unionByName(parts)


def gap_pieces(chunks: DataFrame, min_length: int, size: int = SIZE) -> DataFrame:
    """(rec_ix, offset, piece) of break_at_gaps(): only pieces over borders are put together from parts."""
    own, _, parts = gap_parts(chunks, min_length, size)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])
    return own.withColumnRenamed("part", "piece").unionByName(parts.groupBy("rec_ix", "offset").agg(F.array_join(ordered, "").alias("piece")))


def kmer_counts(chunks: DataFrame, k: int, size: int = SIZE, overlap: int = OVERLAP, symmetric: bool = False) -> DataFrame:
    """(kmer, n) as of whole records."""
    return R.kmer_counts(kmer_pieces(chunks, k, size, overlap), k, symmetric)


def resolve_iupac(chunks: DataFrame, seed_column: str = "rec_ix", size: int = SIZE) -> DataFrame:
    """(rec_ix, chunk, seq) with each ambiguous code as one of its bases, drawn by seed and place in the record as for whole records."""
    return chunks.select("rec_ix", "chunk", S.resolve_iupac(c("seq"), c(seed_column), c("chunk") * size).alias("seq"))


def slices(chunks: DataFrame, wanted: DataFrame, size: int = SIZE) -> DataFrame:
    """wanted (rec_ix, start, end, any others) with text: the characters from start to before end, as far as the record goes (null where it has none of them). A slice meets only the chunks it lies in."""
    first, last = F.floor(c("start") / size), F.floor((c("end") - 1) / size)
    asked = session.stored(wanted.withColumn("_slice", F.monotonically_increasing_id()), "wanted")
    places = asked.filter("end > start").select("_slice", "rec_ix", "start", "end", F.explode(F.sequence(first, last)).alias("chunk"))
    low, high = F.greatest(c("start") - c("chunk") * size, F.lit(0)), F.least(c("end") - c("chunk") * size, F.lit(size))
    part = F.substring(c("seq"), (low + 1).cast("int"), (high - low).cast("int"))
    met = places.join(chunks.select("rec_ix", "chunk", "seq"), ["rec_ix", "chunk"]).groupBy("_slice").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", part.alias("part")))), lambda x: x["part"]), "").alias("text"))
    return asked.join(met, "_slice", "left").select(*wanted.columns, F.nullif("text", F.lit("")).alias("text"))
