"""Readers and writers of the text formats: FASTQ, contig tables, BED, VCF, GFF3, transcript maps, positions, k-mer lists, SAM, bedGraph.

Scans are Spark text scans with parsing as column expressions. Where a record spans lines (FASTQ) lines are numbered within
their file by Spark's row index of each split, so files are read in parallel.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.sequence import chromosome_number, header_ordinal

# Alignment scores and their limits.
DEFAULT_SCORES = {"match": 3, "mismatch": -1, "insert": -15, "delete": -3, "max_mismatches": 8, "max_cigar": 15}


def _column(i: int) -> Column:
    return F.split("value", "\t").getItem(i)


def read_fastq(spark: SparkSession, path: str, mate: int = 1) -> DataFrame:
    """(file, ordinal, mate, header, seq, qual): four lines a record, numbered from 0 in each file.

    A header ``@<digits>@...`` sets the ordinal, and the numbers behind it go on from there. Lines are numbered over each file by
    the sizes of its partitions, whose count (not their rows) is all that meets in one place."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    numbered = with_line_numbers(lines, ["file"])
    return with_ordinals(fastq_records(numbered, ["file"]), ["file"]).select("file", "ordinal", F.lit(mate).alias("mate"), "header", "seq", "qual")


def with_line_numbers(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``line``, from 0 within ``keys``, to the lines of text scans with their split's start (block) and a number that rises within it (at)."""
    sizes = lines.groupBy(*keys, "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return lines.join(before.select(*keys, "block", "before", "first"), [*keys, "block"]).withColumn("line", F.col("before") + F.col("at") - F.col("first"))


def fastq_records(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, record, header, seq, qual) of numbered lines, four to a record."""
    part = lambda k, name: F.max(F.when(F.col("line") % 4 == k, F.col("value"))).alias(name)
    return numbered.groupBy(*keys, F.expr("line div 4").alias("record")).agg(part(0, "header"), part(1, "seq"), part(3, "qual"))


def with_ordinals(records: DataFrame, keys: list[str], start: str | None = None) -> DataFrame:
    """Adds ``ordinal`` and ``shift``: a header's ordinal, and the numbers behind it; ``start`` is the column of the shift that holds before the first stated one."""
    # a stated ordinal holds until the next one: found inside tiles of records, and carried over from tile to tile in a small table
    stated = records.withColumn("_tile", F.expr("record div 65536")).withColumn("_shift", header_ordinal(F.col("header")) - F.col("record"))
    tiles = stated.groupBy(*keys, "_tile").agg(F.max(F.when(F.col("_shift").isNotNull(), F.struct("record", "_shift"))).alias("_last"))
    so_far = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carried = tiles.select(*keys, "_tile", F.last("_last", ignorenulls=True).over(so_far)["_shift"].alias("_carried"))
    inside = Window.partitionBy(*keys, "_tile").orderBy("record").rowsBetween(Window.unboundedPreceding, 0)
    shift = F.coalesce(F.last("_shift", ignorenulls=True).over(inside), "_carried", F.col(start) if start else F.lit(0), F.lit(0))
    return stated.join(carried, [*keys, "_tile"]).withColumn("shift", shift).withColumn("ordinal", F.col("record") + F.col("shift")).drop("_tile", "_shift", "_carried")


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Contig table: chr, len, vchr, voffset, ac, sam_name; comments and the header line are skipped."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & _column(0).rlike(r"^\d+$"))
    return rows.select(_column(0).cast("int").alias("chr"), _column(1).cast("long").alias("len"), _column(2).cast("int").alias("vchr"), _column(3).cast("long").alias("voffset"), _column(4).alias("ac"), _column(5).alias("sam_name"))


def read_bed(spark: SparkSession, path: str, pad: int = 0) -> DataFrame:
    """Regions with numbered contigs, inclusive ends, padded; track and comment lines are skipped."""
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser|$)"))
    return rows.select(chromosome_number(_column(0)).alias("chr"), F.greatest(_column(1).cast("long") - pad, F.lit(0)).alias("start"), (_column(2).cast("long") + pad).alias("end"), F.get(F.split("value", "\t"), F.lit(3)).alias("name"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Region table: contig, start and end in the first three columns, as they stand; lines without numbers there (headers) are skipped."""
    rows = spark.read.text(path).select(chromosome_number(_column(0)).alias("chr"), F.get(F.split("value", "\t"), F.lit(1)).try_cast("long").alias("start"), F.get(F.split("value", "\t"), F.lit(2)).try_cast("long").alias("end"))
    return rows.where("start is not null and end is not null")


def read_transcript_table(spark: SparkSession, path: str) -> DataFrame:
    """Transcript table: gene, chr (column 6), strand (7), exons ``a..b,c..d`` (8) as array<struct<start, end>>, and the RNA's bases (12); lines
    with fewer columns are skipped."""
    part = lambda i: F.get(F.split("value", "\t"), F.lit(i))
    exons = F.transform(F.split(part(7), ","), lambda x: F.struct(F.split_part(x, F.lit(".."), F.lit(1)).try_cast("long").alias("start"), F.split_part(x, F.lit(".."), F.lit(2)).try_cast("long").alias("end")))
    rows = spark.read.text(path).where(F.size(F.split("value", "\t")) >= 12)
    return rows.select(part(0).alias("gene"), chromosome_number(part(5)).alias("chr"), part(6).alias("strand"), exons.alias("exons"), part(11).alias("rna")).where("chr is not null")


def shifted_starts(regions: DataFrame, by: int = 20) -> DataFrame:
    """Region starts moved left by ``by`` where that doesn't run into the region before."""
    w = Window.partitionBy("chr").orderBy("start", "end")
    moved = F.greatest(F.col("start") - by, F.lit(0))
    return regions.withColumn("_last", F.lag("end").over(w)).withColumn("start", F.when(F.col("_last").isNull() | (moved > F.col("_last")), moved).otherwise(F.col("start"))).drop("_last")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variants with INFO as a map and the samples as arrays of format values."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.split("value", "\t").alias("c"))
    info = F.map_from_entries(F.transform(F.split(F.col("c")[7], ";"), lambda x: F.struct(F.split(x, "=")[0], F.coalesce(F.get(F.split(x, "=", 2), F.lit(1)), F.lit("")))))
    samples = F.transform(F.slice("c", F.lit(10), F.size("c")), lambda s: F.map_from_arrays(F.slice(F.split(F.col("c")[8], ":"), F.lit(1), F.size(F.split(s, ":"))), F.split(s, ":")))
    return rows.select(chromosome_number(F.col("c")[0]).alias("chr"), F.col("c")[1].cast("long").alias("pos"), F.col("c")[2].alias("id"), F.col("c")[3].alias("ref"), F.split(F.col("c")[4], ",").alias("alt"), F.col("c")[5].alias("qual"), F.col("c")[6].alias("filter"), info.alias("info"), F.when(F.size("c") > 9, samples).otherwise(F.array().cast("array<map<string,string>>")).alias("samples"))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Genes and exons with gene_id, gene_name and exon_number."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & _column(2).isin("gene", "exon"))
    attr = lambda key: F.nullif(F.regexp_extract(_column(8), f'(?:^|;) *{key}[= ]"?([^";]*)', 1), F.lit(""))
    return rows.select(chromosome_number(_column(0)).alias("chr"), _column(2).alias("kind"), _column(3).cast("long").alias("start"), _column(4).cast("long").alias("end"), attr("gene_id").alias("gene_id"), attr("gene_name").alias("gene_name"), attr("exon_number").cast("int").alias("exon_no"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Map lines ``>map|ID|...[a..b,c..d] (name; ...) LEN=n``: id, exons (start, end), name, length."""
    rows = spark.read.text(path).where(F.col("value").startswith(">"))
    exons = F.transform(F.regexp_extract_all(F.regexp_extract("value", r"\[([^\]]*)\]", 1), F.lit(r"(\d+\.\.\d+)"), 1), lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("long").alias("start"), F.regexp_extract(x, r"(\d+)$", 1).cast("long").alias("end")))
    return rows.select(F.split("value", "\\|")[1].alias("id"), exons.alias("exons"), F.regexp_extract("value", r"\(([^;)]*)", 1).alias("name"), F.regexp_extract("value", r"LEN=(\d+)", 1).try_cast("long").alias("length"))


def read_positions(spark: SparkSession, path: str, most: int = 1024) -> DataFrame:
    """Positions (chr, pos) below a header line; the feature is limited to ``most`` of them, in order."""
    rows = spark.read.text(path).select(chromosome_number(_column(0)).alias("chr"), _column(1).try_cast("long").alias("pos")).where("chr is not null and pos is not null")
    return rows.orderBy("chr", "pos").limit(most)


def read_kmers(spark: SparkSession, path: str) -> DataFrame:
    """K-mer lists (plain or gzip): kmer, strand, chr, pos."""
    return spark.read.csv(path, sep="\t", schema="kmer string, strand string, chr int, pos long")


def read_sites(spark: SparkSession, path: str, width: int = 1000) -> DataFrame:
    """Restriction sites with their bin."""
    rows = spark.read.text(path).select(chromosome_number(_column(0)).alias("chr"), _column(1).try_cast("long").alias("site")).where("site is not null")
    return rows.withColumn("bin", F.expr(f"site div {width}"))


def read_scores(path: str) -> dict[str, int]:
    """Alignment scores from JSON; unknown names are an error, missing ones get the defaults."""
    with open(path) as f:
        got = json.load(f)
    if unknown := set(got) - set(DEFAULT_SCORES):
        raise ValueError(f"unknown scores: {sorted(unknown)}")
    return DEFAULT_SCORES | {k: int(x) for k, x in got.items()}


def write_scores(scores: dict[str, int], path: str) -> None:
    with open(path, "w") as f:
        json.dump(scores, f, indent=1, sort_keys=True)


def genome_chunks(fasta_lines: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(chr, chunk, seq): upper-cased sequence in chunks, from (chr, line_no, line)."""
    w = Window.partitionBy("chr").orderBy("line_no")
    at = fasta_lines.withColumn("end", F.sum(F.length("line")).over(w)).withColumn("start", F.col("end") - F.length("line"))
    cut = at.where("length(line) > 0").withColumn("chunk", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}"))))
    part = F.expr(f"substr(line, cast(greatest(chunk * {width} - start, 0) as int) + 1, cast(least(end, (chunk + 1) * {width}) - greatest(start, chunk * {width}) as int))")
    cells = F.array_sort(F.collect_list(F.struct("start", part.alias("part"))))
    return cut.groupBy("chr", "chunk").agg(F.upper(F.array_join(F.transform(cells, lambda x: x["part"]), "")).alias("seq"))


def fetch(genome: DataFrame, contig: int, first: int, last: int, width: int = 1 << 16) -> DataFrame:
    """Bases first..last (1-based, inclusive) of a contig; only the chunks that hold them are read."""
    a, b = (first - 1) // width, (last - 1) // width
    chosen = genome.where((F.col("chr") == contig) & F.col("chunk").between(a, b)).groupBy("chr").agg(F.array_sort(F.collect_list(F.struct("chunk", "seq"))).alias("c"))
    return chosen.select("chr", F.substr(F.array_join(F.transform("c", lambda x: x["seq"]), ""), F.lit(first - a * width), F.lit(last - first + 1)).alias("seq"))


def write_store(pairs: DataFrame, path: str, codec: str = "zstd", rows: int = 65_536) -> None:
    """Pairs as Parquet by class, contig and part, sorted by position, at most ``rows`` rows in a file's block.

    Ranges of positions are dealt, so that a hot part becomes several files with positions that follow each other."""
    keyed = pairs.withColumn("part", F.expr("least(pos1, pos2) div 67108864"))
    order = ["klass", "chr", "part", F.least("pos1", "pos2")]
    keyed.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("klass", "chr", "part").option("compression", codec).option("parquet.block.row.count.limit", rows).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A store as it was written; class, contig and part prune its files."""
    return spark.read.parquet(path)


def write_fastq(reads: DataFrame, path: str) -> None:
    """header, seq, qual -> FASTQ text."""
    reads.select(F.concat_ws("\n", "header", "seq", F.lit("+"), "qual").alias("value")).write.text(path)


def vcf_text(calls: DataFrame, sample: str) -> DataFrame:
    """VCF 4.1 lines, header first, of (chr, pos, ref, alt, gt, dp, ad): write in this order."""
    header = ["##fileformat=VCFv4.1", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">', '##FORMAT=<ID=AD,Number=.,Type=Integer,Description="Allele depths">', "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])]
    head = calls.sparkSession.createDataFrame([(-1, i, x) for i, x in enumerate(header)], "chr int, pos long, line string")
    cell = F.concat_ws(":", "gt", F.col("dp").cast("string"), F.array_join(F.col("ad").cast("array<string>"), ","))
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("chr").cast("string")), F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT:DP:AD"), cell)
    return head.unionByName(calls.select("chr", "pos", line.alias("line"))).orderBy("chr", "pos").select("line")


def bedgraph_text(runs: DataFrame) -> DataFrame:
    """bedGraph lines of (chr, start0, end0, depth)."""
    return runs.orderBy("chr", "start0").select(F.concat_ws("\t", F.concat(F.lit("chr"), F.col("chr").cast("string")), F.col("start0").cast("string"), F.col("end0").cast("string"), F.col("depth").cast("string")).alias("line"))
