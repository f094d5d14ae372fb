from collections import Counter

import random

import pytest
from pyspark.sql import functions as F

from braidwork.functions import seq as S
from braidwork.operators import records as R

c = F.col


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_homopolymer_goldens(spark):
    assert values(spark, ["AACCGT", "NNAACN", "aAA", "NN", "", None], S.homopolymer_compress(c("s"))) == ["ACGT", "ACN", "aA", "", "", None]


def test_reverse_complement_is_an_involution(spark):
    texts = ["".join(random.Random(i).choices("ACGT", k=i)) for i in range(30)]
    assert values(spark, texts, S.reverse_complement(S.reverse_complement(c("s")))) == texts


def test_circularise(spark):
    assert values(spark, ["ACGT"], S.circularise(c("s"), 2)) == ["ACGTAC"]
    with pytest.raises(Exception, match="shorter than the circularisation size"):
        values(spark, ["A"], S.circularise(c("s"), 2))


def test_verify_genome(spark):
    of = lambda rows: R.verify_genome(spark.createDataFrame(rows, "rec_ix int, seq string")).first()["verdict"]
    assert of([(1, "ACGT")]) == "single record"
    assert of([(1, "ACGT"), (2, "A")]) == "multiple records"
    assert of([(1, "ACGT"), (2, "")]) == "invalid"
    assert of([(1, None)]) == "invalid"
    assert of([]) == "no records"


def test_break_at_gaps(spark):
    df = spark.createDataFrame([(1, "acNNgtaN-c"), (2, ""), (3, "NN"), (4, None)], "rec_ix long, seq string")
    got = sorted(map(tuple, R.break_at_gaps(df, 1).collect()))
    assert got == [(1, 0, "AC"), (1, 4, "GTA"), (1, 9, "C")]
    assert [tuple(x) for x in R.break_at_gaps(df, 3).collect()] == [(1, 4, "GTA")]
    with pytest.raises(Exception, match="unknown character"):
        R.break_at_gaps(spark.createDataFrame([(1, "ACX")], "rec_ix long, seq string"), 1).collect()


def test_kmer_counts_match_slices(spark):
    texts = ["", "A", "ACGTACGT", "é\nxyzé\nxyz", None, "AC", "TTT"]
    df = spark.createDataFrame(list(enumerate(texts)), "rec_ix long, seq string")
    want = Counter(t[i : i + 3] for t in texts if t for i in range(len(t) - 2))
    assert {r.kmer: r.n for r in R.kmer_counts(df, 3).collect()} == want
    dna = df.filter("rec_ix IN (2, 6)")
    turned = Counter()
    for k, n in Counter({"ACG": 2, "CGT": 2, "GTA": 1, "TAC": 1, "TTT": 1}).items():
        turned[min(k, k[::-1].translate(str.maketrans("ACGT", "TGCA")))] += n
    assert {r.kmer: r.n for r in R.kmer_counts(dna, 3, symmetric=True).collect()} == turned
    got = R.contig_shares(df, df.filter("rec_ix = 2"), 3).first()
    assert (got.n_contigs, round(got.exact, 4), round(got.aligned, 4)) == (7, round(100 / 7, 4), round(100 / 7, 4))


def test_kmers_match_slices(spark):
    texts = ["", "A", "ACGTAC", "é\nxyz"]
    assert values(spark, texts, S.kmers(c("s"), 3)) == [[t[i : i + 3] for i in range(len(t) - 2)] for t in texts]


def test_urls(spark):
    url = "http://a.b/c?d=e&f" * 30
    (name,), (back,) = values(spark, [url], S.escape_url(c("s"))), values(spark, [url], S.unescape_url(S.escape_url(c("s"))))
    assert back == url and max(map(len, name.split("/"))) == 200
    assert values(spark, ["http://x/y/z.fa.gz?a=1/2", "https://hgdownload.soe.ucsc.edu/goldenPath/hg38/bigZips/hg38.fa"], S.checksum_url(c("s"))) == ["http://x/y/md5checksums.txt?a=1/2", "http://hgdownload.soe.ucsc.edu/goldenPath/hg38/bigZips/md5sum.txt"]


def test_elapsed_and_format(spark):
    assert values(spark, ["1:02:03", "2:03.5", "7", None], S.elapsed_seconds(c("s"))) == [3723.0, 123.5, None, None]
    assert values(spark, ["1234567", "1234.5", "N/A", ""], S.formatted(c("s"))) == ["1,234,567", "1,234.50", "N/A", ""]


def test_ordinals_and_downsampling(spark):
    df = spark.range(1000).select(c("id").alias("rec_ix"), c("id").cast("string").alias("id"))
    got = R.with_ordinal(df.repartition(7), "rec_ix").collect()
    assert all(r.ordinal == r.rec_ix for r in got) and len(got) == 1000
    a, b = R.downsample(df, 0.1234).collect(), R.downsample(df.repartition(3), 0.1234).collect()
    assert len(a) == 123 and {r.rec_ix for r in a} == {r.rec_ix for r in b}


def test_ordinals_of_more_rows_than_a_sample_holds(spark):
    df = spark.range(60_000).select(c("id").alias("rec_ix"), c("id").cast("string").alias("id")).repartition(5)
    got = R.with_ordinal(df, "rec_ix")
    assert (got.count(), got.filter("ordinal <> rec_ix").count()) == (60_000, 0)
    assert R.uniquify(df).filter("id <> concat(rec_ix, '_', rec_ix)").count() == 0


def test_cut_reads_come_from_the_reference(spark):
    text = "".join(random.Random(3).choices("ACGT", k=2000))
    df = spark.createDataFrame([(0, "ref", text)], "rec_ix long, id string, seq string")
    rows = R.cut_reads(df, 3.7, 50, 90, seed=1).collect()
    back = str.maketrans("ACGT", "TGCA")
    assert rows
    for r in rows:
        *_, a, b = r.id.split("_")
        a, b = int(a), int(b)
        assert 50 <= len(r.seq) <= 90
        assert r.seq == (text[a:b] if a < b else text[b:a].translate(back)[::-1])


def test_resolve_iupac(spark):
    (got,) = values(spark, ["RYKMSWBDHVACGT"], S.resolve_iupac(c("s"), 5))
    assert len(got) == 14 and all(g in S.IUPAC.get(x, x) for g, x in zip(got, "RYKMSWBDHVACGT"))


def test_sql_functions(spark):
    S.register(spark)
    assert spark.sql("SELECT hoco('NNAAC') a, revcomp('AAC') b").first() == ("AC", "GTT")


def test_memoised_tables(spark, tmp_path):
    from braidwork import session

    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for arguments in ({"a": 1, "b": None}, {"b": None, "a": 1}, {"a": 2}):
        assert session.memoised(spark, "t", arguments, build, str(tmp_path)).count() == 3
    assert len(calls) == 2


def test_circularise_where_not_strict(spark):
    assert values(spark, ["ACGT", "AC", ""], S.circularise(c("s"), 3, strict=False)) == ["ACGTACG", None, None]
    with pytest.raises(Exception, match="shorter than"):
        values(spark, ["AC"], S.circularise(c("s"), 3))
    assert values(spark, ["acgtß"], S.ascii_upper(c("s"))) == ["ACGTß"]


@pytest.mark.parametrize("letters", ["ACGT", "aé中", "xyz😀", "".join(map(chr, range(0x100, 0x900)))])
@pytest.mark.parametrize("k", [1, 5, 12])
def test_windows_as_integers_and_as_rows(letters, k):
    import numpy as np

    r = random.Random(k)
    text = "".join(r.choices(letters, k=400))
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    rows, n = R.distinct_windows(points, np.arange(len(text) - k + 1), k)
    want = {}
    for i in range(len(text) - k + 1):
        want[text[i : i + k]] = want.get(text[i : i + k], 0) + 1
    assert dict(zip(R.strings_of(rows).to_pylist(), n.tolist())) == want



def test_downsampling_of_more_rows_than_a_sample_holds(spark):
    df = spark.range(60_000).select(c("id").alias("rec_ix"), c("id").cast("string").alias("id")).repartition(5)
    assert R.downsample(df, 0.3).count() == 18_000


def test_scaled_memory_is_rounded_once(spark, tmp_path):
    from braidwork.plans import catalog

    # the last ones: a whole product, and a share of the whole price first would fall below it
    rows = [(1, 1, 100.75, 0.04, 3.0, "N"), (2, 1, 10.5, 0.0, 3.0, "R"), (3, 1, 40962.5, 0.08, 20.0, "N"), (4, 1, 84087.5, 0.08, 5.0, "N")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_orderkey: r.mem for r in catalog.queries()["f23_scaling"](spark, str(tmp_path)).collect()}
    assert got == {k: int(d * p) if d else int(p) for k, _, p, d, _, _ in rows}


@pytest.mark.parametrize("k", [1, 3, 9, 40])
def test_kmers_of_records(spark, k, monkeypatch):
    r = random.Random(k)
    texts = ["".join(r.choices(s, k=r.randrange(60))) for s in ("ACGT", "AC", "abcdefghijklmnopqrstuvwxyz \n", "é😀x") for _ in range(5)] + ["", None, "A" * 50]
    df = spark.createDataFrame([(7 * i, t) for i, t in enumerate(texts)], "rec_ix long, seq string").coalesce(1)
    want = Counter((7 * i, t[j : j + k]) for i, t in enumerate(texts) if t for j in range(len(t) - k + 1))
    assert {(x.rec_ix, x.kmer): x.m for x in R.record_kmers(df, k).collect()} == want


def test_profiles_look_up_few_counts(spark, monkeypatch):
    """Rows are those of the join, also of slices, letters without counts and records with the same number."""
    r = random.Random(3)
    seqs = ["".join(r.choice("ACGTé") for _ in range(n)) for n in (0, 3, 4, 5, 40, 90)] + ["xxACGTxx", None]
    df = spark.createDataFrame(list(enumerate(seqs)) + [(4, "ACGTACGT")], "rec_ix long, seq string")
    counts = R.kmer_counts(df.filter("rec_ix < 6"), 4)
    joins, own = [], R.record_kmers
    monkeypatch.setattr(R, "record_kmers", lambda *a: joins.append(1) or own(*a))
    monkeypatch.setattr(R, "SLICE", 7)
    got = sorted(map(tuple, R.kmer_profile(df, counts, 4).collect()))
    assert not joins and len(got) == 5
    monkeypatch.setattr(R, "DENSE_BITS", 0)
    assert sorted(map(tuple, R.kmer_profile(df, counts, 4).collect())) == got and not joins
    monkeypatch.setattr(R, "PROFILE_KMERS", 3)
    assert sorted(map(tuple, R.kmer_profile(df, counts, 4).collect())) == got and joins
