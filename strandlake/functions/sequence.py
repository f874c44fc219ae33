"""Sequence, header and quality functions as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC codes and their complements, both cases.
IUPAC = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv"
COMPLEMENT = "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb"

# The standard genetic code, codons in order T, C, A, G.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def revcomp_iupac(seq: Column) -> Column:
    """Reverse complement of IUPAC codes in both cases; other letters become N."""
    return F.reverse(F.translate(F.regexp_replace(seq, f"[^{IUPAC}]", "N"), IUPAC, COMPLEMENT))


def revcomp(seq: Column) -> Column:
    """Reverse complement of A, C, G, T; everything else becomes N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA"))


def kmer_code(kmer: Column, k: int) -> Column:
    """Two bits a base (A 0, C 1, G 2, T 3), the first base highest; null if another letter occurs."""
    digits = F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")
    return F.when(kmer.rlike(f"^[ACGT]{{{k}}}$"), digits)


def seed_key(kmer18: Column) -> Column:
    """Table address of an 18-mer: the code of its first 16 bases with the first base masked out (30 bits)."""
    return kmer_code(F.substring(kmer18, 1, 16), 16).bitwiseAND(0x3FFFFFFF)


def canonical(kmer: Column) -> Column:
    """The smaller, in letter order, of a k-mer and its reverse complement."""
    return F.least(kmer, F.reverse(F.translate(kmer, "ACGT", "TGCA")))


def kmers(seq: Column, k: int, step: int = 1) -> Column:
    """All k-mers of a sequence as an array (empty for shorter ones)."""
    last = F.length(seq) - k + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last, F.lit(step)), lambda i: F.substr(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def header_stem(header: Column) -> Column:
    """The header up to the first blank."""
    return F.split(header, "\\s", 2)[0]


def header_ordinal(header: Column) -> Column:
    """The running number that a header ``@<digits>@...`` carries, or null."""
    return F.nullif(F.regexp_extract(header, r"^@(\d{1,19})@", 1), F.lit("")).cast("long")


def header_umi(header: Column) -> Column:
    """The molecular barcode: 6 to 11 leading bases followed by a colon, or null."""
    return F.nullif(F.regexp_extract(header, r"^@?([ACGTN]{6,11}):", 1), F.lit(""))


def shared_header(h1: Column, h2: Column) -> Column:
    """The common stem of two mate headers that differ in a last 1 and 2 alone, or null."""
    stem = F.substr(h1, F.lit(1), F.length(h1) - 1)
    same = (stem == F.substr(h2, F.lit(1), F.length(h2) - 1)) & h1.endswith("1") & h2.endswith("2")
    return F.when(same, stem)


def compact_header(header: Column) -> Column:
    """A viewer's short header: of colon-separated fields, those behind the second (7 and more fields) or the first (6)."""
    parts = F.split(F.regexp_replace(header, "^@", ""), ":")
    return F.when(F.size(parts) >= 7, F.array_join(F.slice(parts, 3, 100), ":")).when(F.size(parts) == 6, F.array_join(F.slice(parts, 2, 100), ":")).otherwise(F.array_join(parts, ":"))


def valid_quality_length(qual: Column) -> Column:
    """Length without trailing ``#``, at least 1."""
    return F.greatest(F.length(F.regexp_replace(qual, "#+$", "")), F.lit(1))


def rebased_quality(qual: Column) -> Column:
    """Quality letters moved so that the smallest is ``#``."""
    codes = F.transform(F.split(qual, ""), lambda c: F.ascii(c))
    low = F.array_min(codes)
    return F.when(F.length(qual) > 0, F.array_join(F.transform(codes, lambda c: F.char(c - low + 35)), "")).otherwise(qual)


def pseudo_mapq(length: Column, mismatches: Column) -> Column:
    """254 x (length - mismatches) div length."""
    return F.floor(254 * (length - mismatches) / length).cast("int")


def sam_flag(mate: int, match_no: Column, rev_self: Column, rev_other: Column) -> Column:
    """SAM flag bits: paired, proper and first or second; 0x100 from the second match on; strands of both mates."""
    base = 0x43 if mate == 1 else 0x83
    return F.lit(base) + F.when(match_no > 1, 0x100).otherwise(0) + F.when(rev_self, 0x10).otherwise(0) + F.when(rev_other, 0x20).otherwise(0)


def template_length(delta: Column, len1: Column, len2: Column) -> Column:
    """Of gap-free pairs: delta + len2, or delta - len1 where mate 2 lies left."""
    return F.when(delta >= 0, delta + len2).otherwise(delta - len1)


def linear_address(vchr: Column, offset: Column, pos: Column) -> Column:
    """Address in the linear genome: virtual chromosome x 2^28 + offset + position."""
    return F.shiftleft(vchr.cast("long"), 28) + offset + pos


def translate_codons(seq: Column) -> Column:
    """Amino acids of the codons of a sequence in its first frame; X for codons with other letters, a rest is left out."""
    table = F.create_map(*[x for i, a in enumerate(AMINO_ACIDS) for x in (F.lit("".join("TCAG"[i >> s & 3] for s in (4, 2, 0))), F.lit(a))])
    codons = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length(seq) / 3).cast("int") - 1, F.lit(0))), lambda i: F.coalesce(F.try_element_at(table, F.substr(seq, i * 3 + 1, F.lit(3))), F.lit("X")))
    return F.when(F.length(seq) >= 3, F.array_join(codons, "")).otherwise(F.lit(""))


def chromosome_number(name: Column) -> Column:
    """Contig number of a name: a ``chr`` prefix goes, X, Y and M (MT) are 23, 24 and 25; null for others."""
    bare = F.regexp_replace(name, "^chr", "")
    return F.coalesce(F.when(bare == "X", 23).when(bare == "Y", 24).when(bare.isin("M", "MT"), 25), bare.try_cast("int"))


def cigar_text(cigar: Column) -> Column:
    """``10M2D`` form of array<struct<n, op>>."""
    return F.array_join(F.transform(cigar, lambda x: F.concat(x["n"].cast("string"), x["op"])), "")


def cigar_parse(text: Column) -> Column:
    """array<struct<n, op>> of ``10M2D``."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+[MIDNSHP=X])"), 1), lambda x: F.struct(F.regexp_extract(x, r"(\d+)", 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))


def cigar_sum(cigar: Column, ops: str) -> Column:
    """Total length of the given operations."""
    return F.aggregate(F.filter(cigar, lambda x: x["op"].isin(*ops)), F.lit(0), lambda a, x: a + x["n"])


def reference_span(cigar: Column) -> Column:
    """Reference bases: M and D, with clips counted as M."""
    return cigar_sum(cigar, "MDS")


def expand_cigar(cigar: Column) -> Column:
    """One operation per base."""
    return F.flatten(F.transform(cigar, lambda x: F.array_repeat(x["op"], x["n"])))


def apply_mismatches(seq: Column, mismatches: Column) -> Column:
    """``seq`` with the letters of array<struct<pos (0-based), nt>> put in place."""
    return F.aggregate(mismatches, seq, lambda s, m: F.overlay(s, m["nt"], m["pos"] + 1))


def fixed_ad(gt: Column, ad: Column) -> Column:
    """Allele depths of VCF rows: genotype 1/2 with two depths alone gets a leading 0 for the reference."""
    return F.when((gt == "1/2") & (F.size(ad) == 2), F.concat(F.array(F.lit(0).cast("long")), ad)).otherwise(ad)
