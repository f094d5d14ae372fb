"""Operators on sequence records (rec_ix, id, desc, seq)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork import session
from braidwork.functions import seq as S


def retain(records: DataFrame, id_: str | None) -> DataFrame:
    """The record with that id; all where none is given."""
    return records if id_ is None else records.filter(F.col("id") == id_)


def filter_summary(records: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: n_read, n_kept and the outcome."""
    counts = records.agg(F.count("*").alias("n_read")).crossJoin(kept.agg(F.count("*").alias("n_kept")))  # one row each
    outcome = F.when(F.col("n_read") == 0, "no records read").when(F.col("n_kept") == 0, "no records left").when(F.col("n_kept") == F.col("n_read"), "no records removed").otherwise("some records removed")
    return counts.withColumn("outcome", outcome)


def verify_genome(records: DataFrame) -> DataFrame:
    """One row: n_records, n_invalid (an empty or null sequence, or another character than ACGT) and the verdict."""
    counts = records.agg(F.count("*").alias("n_records"), F.count_if(~S.is_dna(F.col("seq"))).alias("n_invalid"))
    verdict = F.when(F.col("n_records") == 0, "no records").when(F.col("n_invalid") > 0, "invalid").when(F.col("n_records") == 1, "single record").otherwise("multiple records")
    return counts.withColumn("verdict", verdict)


def uniquify(records: DataFrame) -> DataFrame:
    """Ids with the 0-based ordinal of file order in front. Ordinals are counted per range of rec_ix, then shifted, so no task sees all rows."""
    return with_ordinal(records, "rec_ix").withColumn("id", F.concat(F.col("ordinal").cast("string"), F.lit("_"), F.col("id")))


def with_ordinal(df: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """df with ordinal, the 0-based position in ascending order: range partitions are counted first, then numbered within. They are written once: dealt again, ranges would be cut by another sample."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    # the id holds the partition number above bit 33; ids ascend with the order
    dealt = dealt.withColumns({"_part": F.shiftright("_place", 33), "_at": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))})
    dealt = session.stored(dealt, "dealt")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))  # a row per partition
    return dealt.join(F.broadcast(before), "_part").withColumn("ordinal", F.col("_before") + F.col("_at")).drop("_place", "_part", "_at", "_before")


def downsample(records: DataFrame, fraction: float, seed: int = 3252457) -> DataFrame:
    """Exactly int(n * fraction) records, the same for the same seed, in file order: those with the smallest hashes."""
    n = records.count()
    wanted = int(n * fraction)
    key = F.md5(F.concat(F.col("rec_ix").cast("string"), F.lit(f":{seed}")))
    return with_ordinal(records.withColumn("_key", key), "_key", "rec_ix").filter(F.col("ordinal") < wanted).drop("_key", "ordinal")


def break_at_gaps(records: DataFrame, min_length: int) -> DataFrame:
    """(rec_ix, offset, piece): the pieces between runs of N or -, upper case, of min_length or more, with their 0-based offsets. Another character than ACGTN- fails the query. One scan of each sequence."""
    piece = re.compile("[^N-]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rec, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                seq = (cell.as_py() or "").upper()
                if re.search("[^ACGTN-]", seq):
                    raise ValueError("unknown character")
                found = [(m.start(), m[0]) for m in piece.finditer(seq) if m.end() - m.start() >= min_length]
                yield pa.RecordBatch.from_arrays([pa.array([rec] * len(found), pa.int64()), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())], names=["rec_ix", "offset", "piece"])

    return records.select("rec_ix", "seq").mapInArrow(run, "rec_ix bigint, offset bigint, piece string")


def cut_reads(records: DataFrame, coverage: float, shortest: int, longest: int, seed: int = 0) -> DataFrame:
    """(id, seq): simulated error-free reads. Each of int(coverage) repetitions of a record starts up to shortest - 1 bases before it and is cut into pieces of hash-drawn lengths; pieces are clipped, those of at least shortest stay, half are reverse-complemented (start and end swap places in the name)."""
    rounds = F.explode(F.sequence(F.lit(1), F.lit(max(int(coverage), 1)))).alias("round")
    base = records.select("rec_ix", "id", "seq", rounds).filter(F.lit(int(coverage) >= 1))
    draw = lambda name, n, *more: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "rec_ix", "id", "round", *more), F.lit(n))
    most = F.ceil((F.length("seq") + shortest) / F.lit(shortest)).cast("int") + 1
    sizes = F.transform(F.sequence(F.lit(1), most), lambda i: F.lit(shortest) + draw("size", longest - shortest + 1, i))
    lengths = base.select("rec_ix", "id", "round", F.posexplode(sizes).alias("k", "size"))
    ends = F.sum("size").over(Window.partitionBy("rec_ix", "id", "round").orderBy("k")) - draw("first", shortest)
    placed = lengths.withColumn("b", ends).withColumn("a", F.col("b") - F.col("size"))
    pieces = placed.join(base, ["rec_ix", "id", "round"])
    start, end = F.greatest(F.col("a"), F.lit(0)), F.least(F.col("b"), F.length("seq"))
    cut = pieces.withColumns({"start": start, "end": end}).filter((F.col("end") - F.col("start")).between(shortest, longest))
    back = draw("strand", 2, F.col("k")) == 1
    piece = F.substring(F.col("seq"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    name = F.concat_ws("_", F.concat_ws(".", "rec_ix", "round", "k"), "id", F.when(back, F.col("end")).otherwise(F.col("start")), F.when(back, F.col("start")).otherwise(F.col("end")))
    return cut.select(name.alias("id"), F.when(back, S.reverse_complement(piece)).otherwise(piece).alias("seq"))


#: Places of a sequence that are counted together: bounds a task's memory where sequences are long.
SLICE = 1 << 20
#: Bits of a packed window up to which counts are an array of all windows.
DENSE_BITS = 20
#: k-mers with counts that are sent to the records' tasks as a table, at most.
PROFILE_KMERS = 1 << 17


def coded_letters(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct code points in ascending order, and the place of each point among them."""
    if points.dtype != np.uint8:
        return np.unique(points, return_inverse=True)
    letters = np.flatnonzero(np.bincount(points, minlength=256)).astype(np.uint8)
    place = np.zeros(256, np.uint8)
    place[letters] = np.arange(len(letters))
    return letters, place[points]


def distinct_windows(points: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct windows of k code points that start at `starts`, as rows, and how often each comes. Where the letters there allow, a window is packed into one integer."""
    letters, coded = coded_letters(points)
    bits = max(1, (len(letters) - 1).bit_length())
    if bits * k <= 64:
        if bits * k <= 62:
            packed = packed_windows(coded[starts[0] : starts[-1] + k], bits, k)[starts - starts[0]].astype(np.uint64)
        else:
            packed = np.zeros(len(starts), np.uint64)
            for j in range(k):
                packed = packed << np.uint64(bits) | coded[starts + j].astype(np.uint64)
        if bits * k <= DENSE_BITS:
            every = np.bincount(packed.astype(np.int64))
            values = np.flatnonzero(every).astype(np.uint64)
            n = every[every > 0]
        else:
            values, n = np.unique(packed, return_counts=True)
        shifts = np.array([bits * (k - 1 - j) for j in range(k)], np.uint64)
        return letters[(values[:, None] >> shifts & np.uint64((1 << bits) - 1)).astype(np.int64)], n
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(points, k)[starts])
    values, n = np.unique(windows.view(f"V{windows.itemsize * k}").ravel(), return_counts=True)
    return np.frombuffer(values.tobytes(), points.dtype).reshape(-1, k), n


def strings_of(rows: np.ndarray) -> pa.Array:
    """Rows of code points as strings, by one encoding of all of them."""
    data = rows.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    sizes = (1 + (rows >= 0x80).astype(np.int32) + (rows >= 0x800) + (rows >= 0x10000)).sum(1)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def kmer_table(records: DataFrame, k: int) -> DataFrame:
    """(kmer, n): the distinct k-mers of each batch of records with their counts there, to be summed. Windows are counted as integers where they fit, so no k-mer becomes a string before it is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for cell in [*batch.column(0), None]:
                seq = cell.as_py() if cell is not None else None
                if seq and len(seq) >= k:
                    held.append(seq)
                    size += len(seq)
                if held and (size >= SLICE or cell is None):
                    text = "".join(held)
                    points = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                    good = np.ones(len(points), bool)
                    for end in np.cumsum([len(x) for x in held]):
                        good[max(end - k + 1, 0) : end] = False  # windows that would reach into the next sequence
                    places = np.flatnonzero(good)
                    for i in range(0, len(places), SLICE):
                        kmers, n = distinct_windows(points, places[i : i + SLICE], k)
                        yield pa.RecordBatch.from_arrays([strings_of(kmers), pa.array(n, pa.int64())], names=["kmer", "n"])
                    held, size = [], 0

    return records.select("seq").mapInArrow(run, "kmer string, n bigint")


def record_kmers(records: DataFrame, k: int) -> DataFrame:
    """(rec_ix, kmer, m): the distinct k-mers of each record and how often it has them; no row where it is shorter than k. A long record gives a k-mer once for each SLICE of its places.

    Records of a batch are counted together: letters are coded, and record and window are one integer where they fit.
    """
    kind = dict(records.dtypes)["rec_ix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows + 1):
                seq = batch.column(1)[i].as_py() if i < batch.num_rows else None
                if seq and len(seq) >= k:
                    held.append((i, seq))
                    size += len(seq)
                if not held or size < SLICE and i < batch.num_rows:
                    continue
                text = "".join(x for _, x in held)
                points = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                lengths = np.array([len(x) for _, x in held])
                good = np.ones(len(points), bool)
                for end in np.cumsum(lengths):
                    good[max(end - k + 1, 0) : end] = False  # windows that would reach into the next record
                owner = np.repeat(np.arange(len(held)), lengths)
                places = np.flatnonzero(good)
                rows = pa.array([j for j, _ in held], pa.int64())
                for a in range(0, len(places), SLICE):
                    of, kmers, m = owned_windows(points, owner, places[a : a + SLICE], k)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows.take(pa.array(of))), strings_of(kmers), pa.array(m, pa.int64())], names=["rec_ix", "kmer", "m"])
                held, size = [], 0

    return records.select("rec_ix", "seq").mapInArrow(run, f"rec_ix {kind}, kmer string, m bigint")


def owned_windows(points: np.ndarray, owner: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """distinct_windows() by owner of their start: (owner, window, count)."""
    letters, coded = coded_letters(points)
    bits = max(1, (len(letters) - 1).bit_length())
    who = owner[starts].astype(np.uint64)
    if bits * k + int(who.max()).bit_length() > 64:
        # windows get numbers first
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(points, k)[starts])
        values, code = np.unique(windows.view(f"V{windows.itemsize * k}").ravel(), return_inverse=True)
        packed, n = np.unique(who * np.uint64(len(values)) + code.astype(np.uint64), return_counts=True)
        return (packed // len(values)).astype(np.int64), np.frombuffer(values.tobytes(), points.dtype).reshape(-1, k)[(packed % len(values)).astype(np.int64)], n
    packed = who
    for j in range(k):
        packed = packed << np.uint64(bits) | coded[starts + j].astype(np.uint64)
    values, n = np.unique(packed, return_counts=True)
    shifts = np.array([bits * (k - 1 - j) for j in range(k)], np.uint64)
    return (values >> np.uint64(bits * k)).astype(np.int64) if bits * k < 64 else np.zeros(len(values), np.int64), letters[(values[:, None] >> shifts & np.uint64((1 << bits) - 1)).astype(np.int64)], n


def kmer_counts(records: DataFrame, k: int, symmetric: bool = False) -> DataFrame:
    """(kmer, n); symmetric counts a k-mer and its reverse complement as one: after counting, so each distinct k-mer is turned once."""
    counts = kmer_table(records, k).groupBy("kmer").agg(F.sum("n").alias("n"))
    return counts.groupBy(S.canonical(F.col("kmer")).alias("kmer")).agg(F.sum("n").alias("n")) if symmetric else counts


def kmer_histogram(counts: DataFrame, cap: int = 10_000, weighted: bool = False) -> DataFrame:
    """(multiplicity, n): k-mers by count, counts over the cap as the cap; weighted by occurrences where asked."""
    m = F.least(F.col("n"), F.lit(cap)).alias("multiplicity")
    return counts.groupBy(m).agg((F.sum("n") if weighted else F.count("*")).alias("kmers"))


def packed_windows(coded: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The windows of k codes that start at every place, as integers."""
    out = np.zeros(max(len(coded) - k + 1, 0), np.int64)
    for j in range(k):
        out = out << bits | coded[j : j + len(out)]
    return out


def looked_up(records: DataFrame, few: pa.Table, letters: str, bits: int, k: int) -> DataFrame:
    """(rec_ix, n_kmers, total) of records with k-mers in the table few (kmer, n) over `letters`; bits tell a letter."""
    kind = dict(records.dtypes)["rec_ix"]
    known = np.frombuffer("".join(few["kmer"].to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, k)
    alphabet = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32)
    keys = np.zeros(len(known), np.int64)
    for j in range(k):
        keys = keys << bits | np.searchsorted(alphabet, known[:, j])
    order = np.argsort(keys)
    keys, counts = keys[order], few["n"].to_numpy()[order]
    if bits * k <= DENSE_BITS:
        every = np.zeros(1 << bits * k, np.int64)
        every[keys] = counts
        keys, counts = None, every  # 0 where a window has none
    sent = records.sparkSession.sparkContext.broadcast((keys, counts, alphabet))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, alphabet = sent.value
        ascii_place = np.full(256, 255, np.uint8)
        ascii_place[alphabet[alphabet < 128]] = np.flatnonzero(alphabet < 128)
        for batch in batches:
            n_kmers, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            held, size = [], 0
            for i in range(batch.num_rows + 1):
                seq = batch.column(1)[i].as_py() if i < batch.num_rows else None
                if seq and len(seq) >= k:
                    held.append((i, seq))
                    size += len(seq)
                if not held or not len(alphabet) or size < SLICE and i < batch.num_rows:
                    continue
                text = "".join(x for _, x in held)
                narrow = text.isascii() and len(alphabet) < 255
                points = np.frombuffer(text.encode("ascii"), np.uint8) if narrow else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                lengths = np.array([len(x) for _, x in held])
                owner = np.repeat(np.array([j for j, _ in held]), lengths)
                ends = np.repeat(np.cumsum(lengths), lengths)
                for a in range(0, len(points) - k + 1, SLICE):
                    part = points[a : a + SLICE + k - 1]
                    at = ascii_place[part] if narrow else np.minimum(np.searchsorted(alphabet, part), len(alphabet) - 1)
                    strange = at == 255 if narrow else alphabet[at] != part
                    windows = packed_windows(np.where(strange, 0, at), bits, k)
                    good = np.arange(a + k, a + k + len(windows)) <= ends[a : a + len(windows)]
                    if strange.any():
                        before = np.concatenate([[0], np.cumsum(strange)])
                        good &= before[k:] == before[:-k]
                    if keys is None:
                        value = np.where(good, counts[windows], 0)
                    else:
                        place = np.minimum(np.searchsorted(keys, windows), len(keys) - 1)
                        value = np.where(good & (keys[place] == windows), counts[place], 0)
                    own = owner[a : a + len(windows)]
                    first = np.flatnonzero(np.diff(own, prepend=-1))
                    n_kmers[own[first]] += np.add.reduceat((value > 0).astype(np.int64), first)
                    total[own[first]] += np.add.reduceat(value, first)
                held, size = [], 0
            some = np.flatnonzero(n_kmers)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(n_kmers[some]), pa.array(total[some])], names=["rec_ix", "n_kmers", "total"])

    return records.select("rec_ix", "seq").mapInArrow(run, f"rec_ix {kind}, n_kmers bigint, total bigint")


def kmer_profile(records: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """(rec_ix, n_kmers, total): of each record's k-mers the number and the sum of their counts. Counts are written first: up to PROFILE_KMERS of them go to the records' tasks as a table, where windows are looked up, so no k-mer becomes a row; more are joined."""
    counts = session.stored(counts, "counts")
    few = counts.select("kmer", "n").limit(PROFILE_KMERS + 1).toArrow()
    letters = sorted({x for kmer in few["kmer"].to_pylist() for x in kmer})
    bits = max(1, (len(letters) - 1).bit_length())
    if few.num_rows <= PROFILE_KMERS and bits * k <= 62:
        return looked_up(records, few, "".join(letters), bits, k).groupBy("rec_ix").agg(F.sum("n_kmers").alias("n_kmers"), F.sum("total").alias("total"))
    own = record_kmers(records, k)
    return own.join(counts, "kmer").groupBy("rec_ix").agg(F.sum("m").alias("n_kmers"), F.sum(F.col("m") * F.col("n")).alias("total"))


def kmer_bands(counts: DataFrame, error_at: int, low: int, high: int) -> DataFrame:
    """(band, kmers): counts under error_at are errors, low to high are single-copy, above are repeats, the rest between."""
    band = F.when(F.col("n") < error_at, "error").when(F.col("n").between(low, high), "single").when(F.col("n") > high, "repeat").otherwise("between")
    return counts.groupBy(band.alias("band")).agg(F.count("*").alias("kmers"))


def kmer_validation(contigs: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """One row: distinct k-mers of each side, common ones, precision and recall. Both sides are one aggregation over flagged k-mers."""
    both = kmer_table(contigs, k).select("kmer", F.lit(True).alias("a")).unionByName(kmer_table(reference, k).select("kmer", F.lit(False).alias("a")))
    flags = both.groupBy("kmer").agg(F.bool_or("a").alias("a"), F.bool_or(~F.col("a")).alias("b"))
    sums = flags.agg(F.count_if("a").alias("n_contigs"), F.count_if("b").alias("n_reference"), F.count_if(F.col("a") & F.col("b")).alias("n_common"))
    return sums.withColumns({"precision": F.try_divide("n_common", "n_contigs"), "recall": F.try_divide("n_common", "n_reference")})


def contig_shares(contigs: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """One row: n_contigs, and in percent exact (contigs all of whose k-mers are in the reference) and aligned (contigs of which some are). Contigs shorter than k count as neither."""
    known = session.stored(kmer_table(reference, k).select("kmer").distinct().withColumn("known", F.lit(True)), "known")
    # a k-mer that comes once for each slice of a long record is either known each time or not
    own = record_kmers(contigs, k)
    per = own.join(known, "kmer", "left").groupBy("rec_ix").agg(F.count("*").alias("n"), F.count("known").alias("m"))
    met = per.agg(F.count_if(F.col("m") == F.col("n")).alias("e"), F.count_if(F.col("m") > 0).alias("al"))
    every = contigs.agg(F.count("*").alias("n_contigs"))
    return every.crossJoin(met).select("n_contigs", F.try_divide(F.col("e") * 100.0, "n_contigs").alias("exact"), F.try_divide(F.col("al") * 100.0, "n_contigs").alias("aligned"))  # one row each


def assembly_stats(contigs: DataFrame, genome_length: int | None = None) -> DataFrame:
    """One row: n_contigs, total, longest, n50, n75, e_size. N50 comes from a histogram of lengths, so the running sum is over distinct lengths."""
    by_length = contigs.groupBy(F.length("seq").alias("len")).agg(F.count("*").alias("c"))
    running = by_length.withColumn("sum", F.sum(F.col("len") * F.col("c")).over(Window.orderBy(F.desc("len")))).withColumn("total", F.sum(F.col("len") * F.col("c")).over(Window.partitionBy()))
    base = F.lit(genome_length) if genome_length else F.col("total")
    at = lambda share: F.max(F.when(F.col("sum") >= F.lit(share) * base, F.col("len")))
    return running.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_contigs"),
        F.max("total").alias("total"),
        F.max("len").alias("longest"),
        at(0.5).alias("n50"),
        at(0.75).alias("n75"),
        F.try_divide(F.sum(F.col("c") * F.col("len").cast("double") * F.col("len")), F.max(base)).alias("e_size"),
    )


def nx_curve(contigs: DataFrame, genome_length: int | None = None) -> DataFrame:
    """(x, length) for x from 1 to 100 percent: the length of the contig that, longest first, reaches x percent of the genome length (of all contigs, where none is given); percentages that aren't reached are left out."""
    by_length = contigs.filter(F.length("seq") > 0).groupBy(F.length("seq").alias("length")).agg(F.count("*").alias("c"))
    own = F.col("length") * F.col("c")
    running = by_length.withColumn("sum", F.sum(own).over(Window.orderBy(F.desc("length")))).withColumn("total", F.sum(own).over(Window.partitionBy()))  # a row per length
    base = F.lit(genome_length) if genome_length else F.col("total")
    percent = lambda x: F.least(F.floor(x * 100 / base), F.lit(100))
    first, last = percent(F.col("sum") - own) + 1, percent(F.col("sum"))
    return running.filter(first <= last).select(F.explode(F.sequence(first, last)).alias("x"), F.col("length").cast("bigint").alias("length"))
