"""Record operators on documents, whole table and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork import session
from braidwork.functions import seq as S
from braidwork.operators import chunks as C
from braidwork.operators import records as R
from braidwork.plans.registry import DNA_SQL, ORACLES, RECORDS_SQL, dna, query, records, table

c = F.col


@query("f1_retain", f"WITH {RECORDS_SQL} SELECT rec_ix, id, seq FROM rec WHERE id = 'src3_3'")
def f1(spark, sf):
    return R.retain(records(spark, sf), "src3_3").select("rec_ix", "id", "seq")


@query("f2_extract_headers", f"WITH {RECORDS_SQL} SELECT rec_ix, id || ' ' || coalesce(\"desc\", '') AS header FROM rec WHERE \"desc\" = 'de'")
def f2(spark, sf):
    return records(spark, sf).filter(c("desc") == "de").select("rec_ix", S.header_text(c("id"), c("desc")).alias("header"))


@query("f3_filter_summary", f"WITH {RECORDS_SQL} SELECT count(*) AS n_read, count(*) FILTER (\"desc\" = 'fr') AS n_kept, 'some records removed' AS outcome FROM rec")
def f3(spark, sf):
    r = records(spark, sf)
    return R.filter_summary(r, r.filter(c("desc") == "fr"))


@query("f4_drop_prefix", f"WITH {RECORDS_SQL} SELECT rec_ix, id FROM rec WHERE NOT starts_with(id, 'src1')")
def f4(spark, sf):
    return records(spark, sf).filter(~c("id").startswith("src1")).select("rec_ix", "id")


@query("f5_keep_prefix", f"WITH {RECORDS_SQL} SELECT rec_ix, id FROM rec WHERE starts_with(id, 'src2')")
def f5(spark, sf):
    return records(spark, sf).filter(c("id").startswith("src2")).select("rec_ix", "id")


@query("f6_drop_containing", f"WITH {RECORDS_SQL} SELECT rec_ix, id FROM rec WHERE NOT contains(lower(seq), 'license')")
def f6(spark, sf):
    return records(spark, sf).filter(~F.lower("seq").contains("license")).select("rec_ix", "id")


@query("f7_verify_genome", f"""WITH {DNA_SQL}, n AS (SELECT count(*) AS n_records, count(*) FILTER (NOT regexp_full_match(seq, '[ACGT]+')) AS n_invalid FROM dna)
SELECT *, CASE WHEN n_records = 0 THEN 'no records' WHEN n_invalid > 0 THEN 'invalid' WHEN n_records = 1 THEN 'single record' ELSE 'multiple records' END AS verdict FROM n""")
def f7(spark, sf):
    return R.verify_genome(dna(spark, sf))


@query("f8_circularise", f"WITH {DNA_SQL} SELECT rec_ix, CASE WHEN length(seq) >= 20 THEN seq || seq[1:20] END AS seq FROM dna")
def f8(spark, sf):
    """Records that are too short are null here; in strict form they fail the query."""
    return dna(spark, sf).select("rec_ix", S.circularise(c("seq"), 20, strict=False).alias("seq"))


@query("f9_uniquify", f"WITH {RECORDS_SQL} SELECT rec_ix, row_number() OVER (ORDER BY rec_ix) - 1 || '_' || id AS id FROM rec")
def f9(spark, sf):
    return R.uniquify(records(spark, sf).select("rec_ix", "id")).select("rec_ix", "id")


@query("f10_homopolymer", """WITH t AS (SELECT doc_id AS rec_ix, string_split(text, '') AS l FROM documents)
SELECT rec_ix, array_to_string(list_filter(l, lambda x, i: x <> CASE WHEN i = 1 THEN 'N' ELSE l[i - 1] END), '') AS seq FROM t""")
def f10(spark, sf):
    return records(spark, sf).select("rec_ix", S.homopolymer_compress(c("seq")).alias("seq"))


@query("f11_reverse_complement", f"WITH {DNA_SQL} SELECT rec_ix, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM dna")
def f11(spark, sf):
    return dna(spark, sf).select("rec_ix", S.reverse_complement(c("seq")).alias("seq"))


@query("f12_complement", f"WITH {DNA_SQL} SELECT rec_ix, translate(seq, 'ACGT', 'TGCA') AS seq FROM dna")
def f12(spark, sf):
    return dna(spark, sf).select("rec_ix", S.complement(c("seq")).alias("seq"))


@query("f13_reference_length", f"WITH {RECORDS_SQL} SELECT sum(length(seq))::BIGINT AS total FROM rec")
def f13(spark, sf):
    return records(spark, sf).agg(F.sum(F.length("seq")).alias("total"))


@query("f14_minimum_read_length", f"WITH {RECORDS_SQL} SELECT min(length(seq)) AS shortest FROM rec")
def f14(spark, sf):
    return records(spark, sf).agg(F.min(F.length("seq")).cast("bigint").alias("shortest"))


@query("f15_downsample", f"""WITH {RECORDS_SQL}, k AS (SELECT rec_ix, id, row_number() OVER (ORDER BY md5(rec_ix || ':3252457'), rec_ix) AS r, count(*) OVER () AS n FROM rec)
SELECT rec_ix, id FROM k WHERE r <= floor(n * 0.3)""")
def f15(spark, sf):
    return R.downsample(records(spark, sf).select("rec_ix", "id"), 0.3)


@query("f16_uppercase", f"WITH {RECORDS_SQL} SELECT rec_ix, translate(seq, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS seq FROM rec")
def f16(spark, sf):
    return records(spark, sf).select("rec_ix", S.ascii_upper(c("seq")).alias("seq"))


@query("f17_resolve_iupac", f"""WITH {RECORDS_SQL}, t AS (SELECT rec_ix, regexp_replace(translate(seq, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGTRYKMSWBDHV]', '', 'g') AS s FROM rec),
o AS (SELECT map {{'R': 'AG', 'Y': 'CT', 'K': 'GT', 'M': 'AC', 'S': 'CG', 'W': 'AT', 'B': 'CGT', 'D': 'AGT', 'H': 'ACT', 'V': 'ACG'}} AS m),
x AS (SELECT rec_ix, i, s[i + 1] AS ch, m[s[i + 1]] AS among FROM (SELECT rec_ix, s, unnest(range(0, length(s))) AS i FROM t), o),
y AS (SELECT rec_ix, string_agg(CASE WHEN among IS NULL THEN ch ELSE among[1 + ('0x' || md5(rec_ix || ':' || i)[1:8])::BIGINT % length(among)] END, '' ORDER BY i) AS seq FROM x GROUP BY rec_ix)
SELECT rec_ix, coalesce(y.seq, '') AS seq FROM t LEFT JOIN y USING (rec_ix)""")
def f17(spark, sf):
    seq = F.regexp_replace(S.ascii_upper(F.coalesce("seq", F.lit(""))), "[^ACGTRYKMSWBDHV]", "")
    return records(spark, sf).select("rec_ix", S.resolve_iupac(seq, c("rec_ix")).alias("seq"))


@query("f18_break_at_gaps", """WITH t AS (SELECT doc_id AS rec_ix, upper(translate(regexp_replace(lower(text), '[^a-z ]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz ', 'ACGTACGTACGTACGTACGTACGTACN')) AS seq FROM documents),
p AS (SELECT rec_ix, string_split(seq, 'N') AS l FROM t),
o AS (SELECT rec_ix, unnest(l) AS piece, unnest(range(1, len(l) + 1)) AS i FROM p),
s AS (SELECT rec_ix, piece, (sum(length(piece) + 1) OVER (PARTITION BY rec_ix ORDER BY i) - length(piece) - 1)::BIGINT AS "offset" FROM o)
SELECT rec_ix, "offset", piece FROM s WHERE length(piece) >= 6""")
def f18(spark, sf):
    letters = "abcdefghijklmnopqrstuvwxyz "
    seq = F.translate(F.regexp_replace(F.lower("seq"), "[^a-z ]", ""), letters, ("ACGT" * 7)[:26] + "N")
    return R.break_at_gaps(records(spark, sf).select("rec_ix", seq.alias("seq")), 6)


@query("f19_cut_reads")
def f19(spark, sf):
    return R.cut_reads(dna(spark, sf), coverage=2.0, shortest=100, longest=300, seed=7)


@query("f20_concatenate", "SELECT doc_id AS rec_ix, text AS seq FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def f20(spark, sf):
    return table(spark, sf, "documents").select(c("doc_id").alias("rec_ix"), c("text").alias("seq")).unionByName(table(spark, sf, "benchmark").select(c("item_id").alias("rec_ix"), c("text").alias("seq")))


@query("f21_escape_url", """WITH e AS (SELECT page_id, url, replace(replace(replace(replace(url || '/' || repeat(url, 8), '/', '¤a'), '?', '¤b'), '=', '¤c'), '&', '¤d') AS s FROM pages)
SELECT page_id, array_to_string(list_transform(range(0, ((length(s) + 199) // 200)::BIGINT), lambda i: s[200 * i + 1:200 * i + 200]), '/') AS name, url || '/' || repeat(url, 8) AS back FROM e""")
def f21(spark, sf):
    long = F.concat("url", F.lit("/"), F.repeat("url", 8))
    return table(spark, sf, "pages").select("page_id", S.escape_url(long).alias("name"), S.unescape_url(S.escape_url(long)).alias("back"))


HG38 = "hgdownload.soe.ucsc.edu/goldenPath/hg38/bigZips/"


@query("f22_checksum_url", f"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'http://{HG38}md5sum.txt' ELSE regexp_replace(url, '^([^?#]*/)[^/?#]*(.*)$', '\\1md5checksums.txt\\2') END AS checksum FROM pages")
def f22(spark, sf):
    """Every fifth page is a download from the folder that has a check sum file of its own name."""
    url = F.when(c("page_id") % 5 == 0, F.concat(F.lit(f"https://{HG38}"), "page_id", F.lit(".fa.gz"))).otherwise(c("url"))
    return table(spark, sf, "pages").select("page_id", S.checksum_url(url).alias("checksum"))


@query("f23_scaling", """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN floor(l_discount * l_extendedprice) ELSE floor(l_extendedprice) END::BIGINT AS mem,
  CASE WHEN l_discount > 0 THEN floor(l_discount * l_quantity) * CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END ELSE l_quantity END::BIGINT AS time FROM lineitem""")
def f23(spark, sf):
    factor = F.when(c("l_discount") > 0, c("l_discount"))
    source = F.when(c("l_returnflag") == "R", "hisim_x").otherwise("real")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.scaled(c("l_extendedprice"), factor).alias("mem"), S.scaled_time(c("l_quantity"), factor, source).alias("time"))


@query("f24_queues", """SELECT CASE WHEN o_totalprice >= 250000 THEN CASE WHEN t <= 4320 THEN 'bigmem,aurinko' ELSE 'aurinko' END WHEN t <= 480 THEN 'short,medium,bigmem,aurinko'
  WHEN t <= 2880 THEN 'medium,bigmem,aurinko' WHEN t <= 4320 THEN 'bigmem,aurinko' ELSE 'aurinko' END AS queue, count(*) AS n FROM (SELECT *, o_orderkey % 6000 AS t FROM orders) GROUP BY 1""")
def f24(spark, sf):
    return table(spark, sf, "orders").groupBy(S.queue_of(c("o_orderkey") % 6000, c("o_totalprice")).alias("queue")).agg(F.count("*").alias("n"))


KMER = "km AS (SELECT rec_ix, unnest(list_transform(range(1, greatest(length(seq) - 7, 0) + 1), lambda i: seq[i:i + 7])) AS kmer FROM dna)"


@query("k1_kmer_counts", f"WITH {DNA_SQL}, {KMER} SELECT kmer, count(*) AS n FROM km GROUP BY kmer")
def k1(spark, sf):
    return R.kmer_counts(dna(spark, sf), 8)


@query("k1_kmer_profile", f"""WITH {DNA_SQL}, {KMER}, n AS (SELECT kmer, count(*) AS n FROM km GROUP BY kmer)
SELECT rec_ix, count(*) AS n_kmers, sum(n)::BIGINT AS total FROM km JOIN n USING (kmer) GROUP BY rec_ix""")
def k1_profile(spark, sf):
    r = dna(spark, sf)
    return R.kmer_profile(r, R.kmer_counts(r, 8), 8)


@query("k2_kmer_histogram", f"WITH {DNA_SQL}, {KMER}, n AS (SELECT kmer, count(*) AS n FROM km GROUP BY kmer) SELECT least(n, 10000) AS multiplicity, count(*) AS kmers FROM n GROUP BY 1")
def k2(spark, sf):
    return R.kmer_histogram(R.kmer_counts(dna(spark, sf), 8))


@query("k2_kmer_histogram_weighted", f"WITH {DNA_SQL}, {KMER}, n AS (SELECT kmer, count(*) AS n FROM km GROUP BY kmer) SELECT least(n, 10000) AS multiplicity, sum(n)::BIGINT AS kmers FROM n GROUP BY 1")
def k2_weighted(spark, sf):
    return R.kmer_histogram(R.kmer_counts(dna(spark, sf), 8), weighted=True)


@query("k3_symmetric_table", f"WITH {DNA_SQL}, {KMER} SELECT least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM km GROUP BY 1")
def k3(spark, sf):
    return R.kmer_counts(dna(spark, sf), 8, symmetric=True)


@query("k4_kmer_bands", f"""WITH {DNA_SQL}, {KMER}, n AS (SELECT kmer, count(*) AS n FROM km GROUP BY kmer)
SELECT CASE WHEN n < 5 THEN 'error' WHEN n BETWEEN 10 AND 60 THEN 'single' WHEN n > 60 THEN 'repeat' ELSE 'between' END AS band, count(*) AS kmers FROM n GROUP BY 1""")
def k4(spark, sf):
    return R.kmer_bands(R.kmer_counts(dna(spark, sf), 8), 5, 10, 60)


@query("k5_simulated_diploid_reads")
def k5(spark, sf):
    """Two haplotypes: the sequence, and the sequence with every hash-chosen base complemented; reads are cut from both."""
    r = dna(spark, sf)
    other = F.array_join(F.transform(F.split("seq", ""), lambda x, i: F.when(F.pmod(F.xxhash64("rec_ix", i), F.lit(100)) == 0, S.complement(x)).otherwise(x)), "")
    both = r.withColumn("hap", F.lit("a")).unionByName(r.withColumn("seq", other).withColumn("hap", F.lit("b")))
    return R.cut_reads(both.withColumn("id", F.concat_ws(":", "id", "hap")).drop("hap"), coverage=1.0, shortest=100, longest=300, seed=3541529)


@query("k6_kmer_validation", """WITH a AS (SELECT DISTINCT unnest(list_transform(range(1, greatest(length(text) - 4, 0) + 1), lambda i: text[i:i + 4])) AS k FROM documents),
b AS (SELECT DISTINCT unnest(list_transform(range(1, greatest(length(text) - 4, 0) + 1), lambda i: text[i:i + 4])) AS k FROM benchmark),
n AS (SELECT (SELECT count(*) FROM a) AS n_contigs, (SELECT count(*) FROM b) AS n_reference, (SELECT count(*) FROM a JOIN b USING (k)) AS n_common)
SELECT *, n_common / n_contigs AS "precision", n_common / n_reference AS recall FROM n""")
def k6(spark, sf):
    return R.kmer_validation(records(spark, sf), table(spark, sf, "benchmark").withColumn("seq", c("text")), 5)


@query("k7_assembly_stats", f"""WITH {DNA_SQL}, l AS (SELECT length(seq) AS len FROM dna), r AS (SELECT len, sum(len) OVER (ORDER BY len DESC RANGE UNBOUNDED PRECEDING) AS s, sum(len) OVER () AS t FROM l)
SELECT count(*) AS n_contigs, max(t)::BIGINT AS total, max(len) AS longest, max(len) FILTER (s >= 0.5 * t) AS n50, max(len) FILTER (s >= 0.75 * t) AS n75, round(sum(len::DOUBLE * len) / max(t), 6) AS e_size FROM r""")
def k7(spark, sf):
    return R.assembly_stats(dna(spark, sf)).withColumn("e_size", F.round("e_size", 6))


@query("k6_contig_shares", """WITH b AS (SELECT DISTINCT unnest(list_transform(range(1, greatest(length(text) - 4, 0) + 1), lambda i: text[i:i + 4])) AS k FROM benchmark),
a AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(length(text) - 4, 0) + 1), lambda i: text[i:i + 4])) AS k FROM documents),
p AS (SELECT doc_id, count(*) AS n, count(b.k) AS m FROM a LEFT JOIN b USING (k) GROUP BY doc_id)
SELECT n_contigs, count(*) FILTER (n = m) * 100.0 / n_contigs AS exact, count(*) FILTER (m > 0) * 100.0 / n_contigs AS aligned FROM p, (SELECT count(*) AS n_contigs FROM documents) GROUP BY n_contigs""")
def k6_shares(spark, sf):
    return R.contig_shares(records(spark, sf), table(spark, sf, "benchmark").withColumn("seq", c("text")), 5)


@query("k7_nx_curve", f"""WITH {DNA_SQL}, l AS (SELECT length(seq) AS len FROM dna), r AS (SELECT len, sum(len) OVER (ORDER BY len DESC RANGE UNBOUNDED PRECEDING) AS s, sum(len) OVER () AS t FROM l)
SELECT x, max(len)::BIGINT AS length FROM r, (SELECT unnest(range(1, 101)) AS x) WHERE s * 100 >= x * t GROUP BY x""")
def k7_curve(spark, sf):
    return R.nx_curve(dna(spark, sf)).select(c("x").cast("bigint").alias("x"), "length")


@query("k10_bcalm_to_gfa", """SELECT 'H' || chr(9) || 'VN:Z:1.0' AS line UNION ALL SELECT 'S' || chr(9) || o_orderkey || chr(9) || o_orderpriority FROM orders
UNION ALL SELECT DISTINCT 'L' || chr(9) || l_orderkey || chr(9) || CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END || chr(9) || l_partkey || chr(9) || CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END || chr(9) || '4M' FROM lineitem""")
def k10(spark, sf):
    """Orders as unitigs, their lines as links."""
    from braidwork.sources.formats import gfa_lines

    link = F.struct(F.when(c("l_returnflag") == "R", "-").otherwise("+").alias("own"), c("l_partkey").alias("target"), F.when(c("l_linestatus") == "F", "-").otherwise("+").alias("other"))
    links = table(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("unitig")).agg(F.collect_set(link).alias("links"))
    unitigs = table(spark, sf, "orders").select(c("o_orderkey").alias("unitig"), c("o_orderpriority").alias("seq")).join(links, "unitig", "left")
    return gfa_lines(unitigs, 5).select("line")


#: Characters of a chunk in the queries below: short, so that documents have many borders.
PART = 97


def whole_again(records_, parts):
    """Records put together from chunks; those without one are empty."""
    return records_.select("rec_ix").join(C.joined(parts), "rec_ix", "left").select("rec_ix", F.coalesce("seq", F.lit("")).alias("seq"))


@query("f10_chunked_homopolymer", ORACLES["f10_homopolymer"])
def f10_chunked(spark, sf):
    r = records(spark, sf)
    return whole_again(r, C.homopolymer_compress(C.chunked(r, PART, 1)))


@query("f11_chunked_reverse_complement", ORACLES["f11_reverse_complement"])
def f11_chunked(spark, sf):
    r = dna(spark, sf)
    return whole_again(r, C.reverse_complement(C.chunked(r, PART, 5), PART, 5))


@query("f17_chunked_iupac", ORACLES["f17_resolve_iupac"])
def f17_chunked(spark, sf):
    r = records(spark, sf).withColumn("seq", F.regexp_replace(S.ascii_upper(F.coalesce("seq", F.lit(""))), "[^ACGTRYKMSWBDHV]", ""))
    return whole_again(r, C.resolve_iupac(C.chunked(r, PART, 1), size=PART))


@query("f18_chunked_gaps", ORACLES["f18_break_at_gaps"])
def f18_chunked(spark, sf):
    """The pieces put together again from their parts."""
    letters = "abcdefghijklmnopqrstuvwxyz "
    seq = F.translate(F.regexp_replace(F.lower("seq"), "[^a-z ]", ""), letters, ("ACGT" * 7)[:26] + "N")
    return C.gap_pieces(C.chunked(records(spark, sf).select("rec_ix", seq.alias("seq")), PART, 1), 6, PART)


@query("k1_chunked_kmer_counts", ORACLES["k1_kmer_counts"])
def k1_chunked(spark, sf):
    """The overlap is shorter than a window, so those over borders are put together."""
    return C.kmer_counts(C.chunked(dna(spark, sf), PART, 3), 8, PART, 3)


@query("s1_s2_chunked_fasta", f"""WITH {DNA_SQL}, x AS (SELECT *, row_number() OVER (ORDER BY rec_ix) - 1 AS r FROM dna)
SELECT r AS rec_ix, id, "desc", chunk, seq[97 * chunk + 1:97 * chunk + 97] AS seq, seq[greatest(97 * chunk - 9, 1):97 * chunk] AS before FROM (SELECT *, unnest(range(0, ((length(seq) + 96) // 97)::BIGINT)) AS chunk FROM x)""")
def s1_chunked(spark, sf):
    """documents as one FASTA text of lines of 60 letters, read back in splits."""
    at = session.scratch_path(spark, "fasta")
    lines = dna(spark, sf).select("rec_ix", F.concat(F.lit(">"), "id", F.lit(" "), "desc", F.lit("\n"), F.regexp_replace("seq", "(.{60})(?=.)", "$1\n")).alias("value"))
    lines.repartitionByRange("rec_ix").sortWithinPartitions("rec_ix").select("value").write.text(at)
    heads, chunks = C.read_fasta_chunks(spark, at, PART, 10)
    return chunks.join(heads, "rec_ix").select("rec_ix", "id", "desc", "chunk", "seq", "before")
