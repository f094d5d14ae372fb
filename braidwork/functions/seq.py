"""Scalar sequence functions as Column expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: IUPAC codes that stand for several bases.
IUPAC = {"R": "AG", "Y": "CT", "K": "GT", "M": "AC", "S": "CG", "W": "AT", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG"}


def header_text(id_: Column, desc: Column) -> Column:
    """Id, a blank, and the description (nothing for a null)."""
    return F.concat(id_, F.lit(" "), F.coalesce(desc, F.lit("")))


def homopolymer_compress(seq: Column) -> Column:
    """Runs of a character become one. A leading run of N vanishes; case counts."""
    return F.regexp_replace(F.regexp_replace(seq, r"(?s)(.)\1+", "$1"), "^N", "")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def is_dna(seq: Column) -> Column:
    """Not empty, and nothing but ACGT; false for a null."""
    return F.coalesce(seq.rlike("^[ACGT]+$"), F.lit(False))


def circularise(seq: Column, size: int = 1000, strict: bool = True) -> Column:
    """The sequence with its own first `size` characters appended; a shorter sequence fails the query, or is null where not strict."""
    if size < 1:
        raise ValueError("the size must be positive")
    short = F.raise_error(F.concat(F.lit("record shorter than the circularisation size: "), F.length(seq).cast("string"))) if strict else F.lit(None)
    return F.when(F.length(seq) < size, short.cast("string")).otherwise(F.concat(seq, F.substring(seq, 1, size)))


def resolve_iupac(seq: Column, seed: Column | int = 0, first: Column | int = 0) -> Column:
    """Each ambiguous code becomes one of its bases, chosen by the md5 of seed and 0-based place, counted from `first`."""
    first = F.lit(first) if isinstance(first, int) else first
    seed = F.lit(seed) if isinstance(seed, int) else seed
    options = F.create_map(*[x for k, v in IUPAC.items() for x in (F.lit(k), F.lit(v))])

    def pick(c: Column, i: Column) -> Column:
        among = F.try_element_at(options, c)
        draw = F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), (first + i).cast("string"))), 1, 8), 16, 10).cast("bigint")
        at = (draw % F.length(among)).cast("int") + 1
        return F.when(among.isNull(), c).otherwise(F.substring(among, at, F.lit(1)))

    return F.array_join(F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), pick), "")


def kmers(seq: Column, k: int) -> Column:
    """Array of the k-mers of the sequence in order; empty where it is shorter than k. One scan: substrings by index would start from the front each time."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def dna_of(text: Column) -> Column:
    """A stand-in genome: the letters a-z of a text, mapped to ACGT in turn."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), letters, ("ACGT" * 7)[:26])


def ascii_upper(seq: Column) -> Column:
    """Only a-z change."""
    return F.translate(seq, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def escape_url(url: Column) -> Column:
    """A URL as a directory name: / ? = & as marked letters, a / after every 200 characters that others follow."""
    out = url
    for sign, code in zip("/?=&", "abcd"):
        out = F.replace(out, F.lit(sign), F.lit("¤" + code))
    return F.regexp_replace(out, "(.{200})(?=.)", "$1/")


def unescape_url(name: Column) -> Column:
    out = F.replace(name, F.lit("/"), F.lit(""))
    for sign, code in zip("/?=&", "abcd"):
        out = F.replace(out, F.lit("¤" + code), F.lit(sign))
    return out


def checksum_url(url: Column) -> Column:
    """The check sum file beside a download; the hg38 folder has a file name of its own."""
    # a fixed value: a public download folder
    hg38 = "hgdownload.soe.ucsc.edu/goldenPath/hg38/bigZips/"
    beside = F.regexp_replace(url, r"^([^?#]*/)[^/?#]*(.*)$", "$1md5checksums.txt$2")
    return F.when(url.contains(hg38), F.lit(f"http://{hg38}md5sum.txt")).otherwise(beside)


def scaled(base: Column, factor: Column) -> Column:
    """Whole part of factor times base; the base where there is no factor."""
    return F.coalesce(F.floor(factor * base), base).cast("bigint")


def scaled_time(base: Column, factor: Column, read_source: Column) -> Column:
    """As scaled; simulated reads take twice as long, if there is a factor."""
    return F.when(factor.isNotNull() & read_source.startswith("hisim_"), scaled(base, factor) * 2).otherwise(scaled(base, factor))


def queue_of(minutes: Column, memory_mb: Column) -> Column:
    """The queues that take a job of that length and memory."""
    # fixed values: names and limits of queues
    long = F.when(minutes <= 4320, "bigmem,aurinko").otherwise("aurinko")
    return F.when(memory_mb >= 250_000, long).when(minutes <= 480, "short,medium,bigmem,aurinko").when(minutes <= 2880, "medium,bigmem,aurinko").otherwise(long)


def elapsed_seconds(text: Column) -> Column:
    """h:mm:ss or m:ss as seconds; null for other forms."""
    parts = F.split(text, ":")
    total = F.aggregate(F.transform(parts, lambda x: x.try_cast("double")), F.lit(0.0), lambda a, x: a * 60 + x)
    return F.when((F.size(parts) >= 2) & (F.size(parts) <= 3), total)


def formatted(value: Column) -> Column:
    """Digits with thousands separators, other numbers with two places too, anything else as it is."""
    return (
        F.when(value.rlike(r"^\d+$"), F.format_number(value.try_cast("double"), 0))
        .when(value.rlike(r"^-?\d*\.\d+$|^-?\d+\.?\d*(e[+-]?\d+)?$"), F.format_number(value.try_cast("double"), 2))
        .otherwise(value)
    )


def register(spark: SparkSession) -> None:
    """SQL functions of the same semantics, as temporary SQL functions (no Python runs in them)."""
    bodies = {
        "hoco(s STRING)": r"regexp_replace(regexp_replace(s, '(?s)(.)\\1+', '$1'), '^N', '')",
        "revcomp(s STRING)": "reverse(translate(s, 'ACGT', 'TGCA'))",
        "canonical_kmer(s STRING)": "least(s, reverse(translate(s, 'ACGT', 'TGCA')))",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS STRING RETURN {body}")
