import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from braidwork.functions import seq as S
from braidwork.operators import chunks as C
from braidwork.operators import intervals as I
from braidwork.operators import records as R

SCHEMA = "rec_ix long, seq string"


def rows(r):
    texts = ["", "N", "NNNNNNN", "A", "ACGT", "-NN-ACGTNNAC", "A" * 40, "NNAAACCNNNNGGGGGGGGGGT--", None]
    texts += ["".join(r.choice("ACGTN-") * r.choice([1, 1, 2, 7]) for _ in range(r.randrange(60))) for _ in range(12)]
    return list(enumerate(texts))


@pytest.fixture(scope="module", params=[(1, 1), (2, 3), (5, 1), (64, 9)])
def setting(request, spark):
    size, overlap = request.param
    data = rows(random.Random(size))
    df = spark.createDataFrame(data, SCHEMA).cache()
    return size, overlap, data, df, C.chunked(df, size, overlap).cache()


def whole(df, chunks):
    return {x.rec_ix: x.seq or "" for x in df.join(C.joined(chunks).withColumnRenamed("seq", "s"), "rec_ix", "left").select("rec_ix", F.col("s").alias("seq")).collect()}


def test_chunks_hold_the_record_and_its_overlaps(setting):
    size, overlap, data, df, chunks = setting
    assert whole(df, chunks) == {i: t or "" for i, t in data}
    texts = dict(data)
    for x in chunks.collect():
        a, t = x.chunk * size, texts[x.rec_ix]
        assert (x.before, x.seq, x.after) == (t[max(0, a - overlap) : a], t[a : a + size], t[a + size : a + size + overlap])


def test_fragments_of_any_lengths_become_chunks(setting, spark):
    size, overlap, data, df, chunks = setting
    r = random.Random(9)
    parts = []
    for i, t in data:
        at = 0
        while t and at < len(t):
            n = r.randint(1, 9)
            parts.append((i, at, t[at : at + n]))
            at += n
    r.shuffle(parts)
    got = C.rechunked(spark.createDataFrame(parts, "rec_ix long, offset long, seq string"), size, overlap)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunks.collect()))


def test_record_operators_give_the_same_rows(setting):
    size, overlap, data, df, chunks = setting
    at = lambda d: {x.rec_ix: x.seq or "" for x in d.select("rec_ix", "seq").collect()}
    assert whole(df, C.homopolymer_compress(chunks)) == at(df.withColumn("seq", S.homopolymer_compress(F.col("seq"))))
    assert whole(df, C.reverse_complement(chunks, size, overlap)) == at(df.withColumn("seq", S.reverse_complement(F.col("seq"))))
    assert whole(df, C.mapped(chunks, S.complement)) == at(df.withColumn("seq", S.complement(F.col("seq"))))
    assert whole(df, C.resolve_iupac(chunks, size=size)) == at(df.withColumn("seq", S.resolve_iupac(F.col("seq"), F.col("rec_ix"))))
    assert {x.rec_ix: x.length for x in C.lengths(chunks).collect()} == {i: len(t) for i, t in data if t}
    assert {x.rec_ix: x.valid for x in C.is_dna(chunks).collect()} == {i: bool(re.fullmatch("[ACGT]+", t)) for i, t in data if t}


@pytest.mark.parametrize("k", [1, 2, 4, 9])
def test_kmers_over_borders(setting, k):
    size, overlap, data, df, chunks = setting
    got = {x.kmer: x.n for x in C.kmer_counts(chunks, k, size, overlap).collect()}
    assert got == {x.kmer: x.n for x in R.kmer_counts(df, k).collect()}
    assert C.kmer_counts(chunks, k, size, overlap, symmetric=True).count() == R.kmer_counts(df, k, symmetric=True).count()


@pytest.mark.parametrize("least", [1, 4])
def test_pieces_between_gaps(setting, least):
    size, overlap, data, df, chunks = setting
    pieces, parts = C.break_at_gaps(chunks, least, size)
    want = sorted((x.rec_ix, x.offset, x.piece) for x in R.break_at_gaps(df, least).collect())
    assert sorted(map(tuple, pieces.collect())) == [(i, a, len(p)) for i, a, p in want]
    text = {}
    for x in sorted(parts.collect(), key=lambda x: (x.rec_ix, x.offset, x.at)):
        text[x.rec_ix, x.offset] = text.get((x.rec_ix, x.offset), "") + x.part
    assert sorted((i, a, p) for (i, a), p in text.items()) == want


def test_compressed_places(setting, spark):
    size, overlap, data, df, chunks = setting
    full = df.filter("seq <> ''").select("rec_ix", "seq", I.run_starts(F.col("seq")).alias("s"))
    places = full.select("rec_ix", F.explode(F.sequence(F.lit(0), F.size("s") + 1)).alias("place"), "s", "seq").select("rec_ix", F.col("place").cast("long").alias("place"), I.to_raw(F.col("s"), F.col("place"), F.length("seq")).alias("want"))
    got = C.to_raw(places, C.runs(chunks, size), C.lengths(chunks), size).collect()
    assert len(got) == places.count() and all(x.want == x.raw_place for x in got)


@pytest.mark.parametrize("split", [40, 1000, 1 << 20])
def test_fasta_in_splits(spark, tmp_path, split):
    r = random.Random(split)
    texts = ["".join(r.choice("ACGT") for _ in range(r.choice([1, 30, 700]))) for _ in range(9)]
    lines = [";before any record"]
    for i, t in enumerate(texts):
        lines += [f">r{i} the > {i}" if i % 2 else f">r{i}", *(t[a : a + 13] for a in range(0, len(t), 13))]
    (tmp_path / "a.fa").write_text("\n".join(lines[:60]) + "\n")
    (tmp_path / "b.fa").write_text("\n".join([*lines[60:], ">empty"]) + "\n")
    dropped = next(i for i, x in enumerate(lines[60:]) if x.startswith(">"))  # the second file starts within a record
    owner = sum(x.startswith(">") for x in lines[:60]) - 1
    want = dict(enumerate(texts))
    want[owner] = "".join(x for x in lines[max(i for i, x in enumerate(lines[:60]) if x.startswith(">")) + 1 : 60])
    assert dropped >= 0
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        heads, chunks = C.read_fasta_chunks(spark, str(tmp_path), 50, 4)
        assert sorted(map(tuple, heads.collect())) == [*((i, f"r{i}", f"the > {i}" if i % 2 else None) for i in range(9)), (9, "empty", None)]
        assert {x.rec_ix: x.seq for x in C.joined(chunks).collect()} == {k: v for k, v in want.items() if v}
        assert {len(x.seq) for x in chunks.filter("length(after) > 0").collect()} <= {50}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_short_chunks_go_back_many_at_a_time():
    """A batch per chunk costs more than the chunk's work."""
    rows = [(1, k, "A" * 97) for k in range(10_000)]
    names, kinds = ["rec_ix", "chunk", "seq"], [pa.int64(), pa.int64(), pa.string()]
    assert [b.num_rows for b in C._batched(iter(rows), names, kinds)] == [C.BATCH_ROWS, 10_000 - C.BATCH_ROWS]
    long = [(1, k, "A" * C.BATCH_SIZE) for k in range(3)]
    assert [b.num_rows for b in C._batched(iter(long), names, kinds)] == [1, 1, 1]


@pytest.mark.parametrize("size", [1, 2, 5])
def test_gap_pieces_are_those_of_whole_records(spark, size):
    r = spark.createDataFrame([(1, "ACGTNNACG-TTTT"), (2, "NNN"), (3, ""), (4, "acgtacgtacgt")], "rec_ix long, seq string")
    got = C.gap_pieces(C.chunked(r, size, 1), 3, size)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, R.break_at_gaps(r, 3).collect()))


def test_runs_are_counted_apart_from_their_starts(spark):
    chunks = C.chunked(spark.createDataFrame([(1, "AACCA"), (2, "NNA")], "rec_ix long, seq string"), 2, 1)
    counts, starts = C.runs(chunks, 2)
    assert sorted(map(tuple, counts.select("rec_ix", "chunk", "first", "n", "places").collect())) == [(1, 0, 0, 1, 0), (1, 1, 1, 1, 2), (1, 2, 2, 1, 4), (2, 0, 0, 1, 0), (2, 1, 1, 1, 2)]
    assert all(r.starts == [0] for r in starts.collect()) and dict(starts.dtypes)["starts"] == "array<int>"
    plan = C.to_raw(counts.selectExpr("rec_ix", "first AS place").distinct(), (counts, starts), C.lengths(chunks), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("array<int>") == 1  # starts are read once
