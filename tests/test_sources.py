"""Readers and writers on small files."""

import gzip

import pytest

from strandlake.sources import formats as fm


def write(path, text):
    path.write_text(text)
    return str(path)


def test_fastq_round_trip(spark, tmp_path):
    records = [(f"@r{i}/1", "ACGT" * (i % 5 + 1), "IIII" * (i % 5 + 1)) for i in range(500)]
    path = write(tmp_path / "a.fq", "".join(f"{h}\n{s}\n+\n{q}\n" for h, s, q in records))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = fm.read_fastq(spark, path).orderBy("ordinal").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["ordinal"], r["header"], r["seq"], r["qual"]) for r in got] == [(i, *x) for i, x in enumerate(records)]
    out = str(tmp_path / "out")
    fm.write_fastq(fm.read_fastq(spark, path), out)
    assert spark.read.text(out).count() == 2000


def test_fastq_headers_may_state_the_ordinal(spark, tmp_path):
    path = write(tmp_path / "b.fq", "".join(f"{h}\nA\n+\nI\n" for h in ("@x", "@70@y", "@z")))
    assert [r["ordinal"] for r in fm.read_fastq(spark, path).orderBy("ordinal").collect()] == [0, 70, 71]


def test_tables(spark, tmp_path):
    contigs = fm.read_contigs(spark, write(tmp_path / "c", "#x\nchr\tlen\tv\to\tAC\tS\n1\t100\t0\t0\tNC1\tchr1\n23\t50\t1\t64\tNC2\tchrX\n"))
    assert [tuple(r) for r in contigs.orderBy("chr").collect()] == [(1, 100, 0, 0, "NC1", "chr1"), (23, 50, 1, 64, "NC2", "chrX")]
    bed = fm.read_bed(spark, write(tmp_path / "d", "track x\nchr1\t5\t20\tone\nchrX\t30\t40\nchrM\t1\t2\n"), pad=10)
    assert [tuple(r) for r in bed.orderBy("chr").collect()] == [(1, 0, 30, "one"), (23, 20, 50, None), (25, 0, 12, None)]
    moved = fm.shifted_starts(spark.createDataFrame([(1, 100, 200), (1, 215, 300), (1, 400, 500)], "chr int, start long, end long"))
    assert [r["start"] for r in moved.orderBy("start").collect()] == [80, 215, 380]
    gff = fm.read_gff(spark, write(tmp_path / "e", '#\nchr2\ts\texon\t5\t9\t.\t+\t.\tgene_id "G1"; gene_name "N"; exon_number 3\nchr2\ts\tgene\t1\t20\t.\t+\t.\tgene_id=G1;gene_name=N\nchr2\ts\tCDS\t1\t2\t.\t+\t.\tx\n'))
    assert sorted(tuple(r) for r in gff.collect())[0] == (2, "exon", 5, 9, "G1", "N", 3) and gff.count() == 2
    maps = fm.read_transcripts(spark, write(tmp_path / "f", ">map|T1|chr1[5..9,20..30] (abc; d) LEN=16\nACGT\n")).first()
    assert (maps["id"], maps["name"], maps["length"], [tuple(e) for e in maps["exons"]]) == ("T1", "abc", 16, [(5, 9), (20, 30)])
    assert [tuple(r) for r in fm.read_positions(spark, write(tmp_path / "g", "chr\tpos\nchr3\t9\nchrY\t4\n")).collect()] == [(3, 9), (24, 4)]
    assert fm.read_sites(spark, write(tmp_path / "h", "chr3\t2500\n")).first()["bin"] == 2
    with gzip.open(tmp_path / "k.gz", "wt") as f:
        f.write("ACGT\t+\t1\t77\n")
    assert tuple(fm.read_kmers(spark, str(tmp_path / "k.gz")).first()) == ("ACGT", "+", 1, 77)


def test_vcf(spark, tmp_path):
    lines = [r["line"] for r in fm.vcf_text(spark.createDataFrame([(2, 7, "A", "C,G", "1/2", 30, [0, 12, 18]), (1, 9, "A", "C", "0/1", 9, [4, 5])], "chr int, pos long, ref string, alt string, gt string, dp int, ad array<int>"), "S").collect()]
    assert lines[0] == "##fileformat=VCFv4.1" and lines[-1].endswith("1/2:30:0,12,18")
    path = write(tmp_path / "v.vcf", "\n".join(lines).replace("PASS\t.\t", "PASS\tDP=3;SOMATIC\t") + "\n")
    rows = fm.read_vcf(spark, path).orderBy("chr").collect()
    assert [(r["chr"], r["pos"], r["alt"], r["info"]["DP"], r["info"]["SOMATIC"]) for r in rows] == [(1, 9, ["C"], "3", ""), (2, 7, ["C", "G"], "3", "")]
    assert rows[1]["samples"][0] == {"GT": "1/2", "DP": "30", "AD": "0,12,18"}


def test_scores(tmp_path):
    path = str(tmp_path / "s.json")
    fm.write_scores({"match": 4}, path)
    assert fm.read_scores(path)["match"] == 4 and fm.read_scores(path)["delete"] == -3
    fm.write_scores({"foo": 1}, path)
    with pytest.raises(ValueError):
        fm.read_scores(path)


def test_genome_and_store(spark, tmp_path):
    seq = "acgtnACGTTTGA" * 40
    lines = spark.createDataFrame([(1, i, seq[i * 60 : i * 60 + 60]) for i in range(9)] + [(2, 0, "ac")], "chr int, line_no int, line string")
    chunks = fm.genome_chunks(lines, 128)
    assert "".join(r["seq"] for r in chunks.where("chr = 1").orderBy("chunk").collect()) == seq.upper()
    assert fm.fetch(chunks, 1, 100, 300, 128).first()["seq"] == seq.upper()[99:300]
    pairs = spark.createDataFrame([(k, c, p, p + 50) for k in "pm" for c in (1, 2) for p in (5, 70_000_000)], "klass string, chr int, pos1 int, pos2 int")
    fm.write_store(pairs, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).where("klass = 'p' and chr = 1 and part = 1").count() == 1


def test_region_and_transcript_tables(spark, tmp_path):
    (tmp_path / "regions.tsv").write_text("chrom\tstart\tend\nchr3\t10\t20\tx\nX\t5\t6\nchr4\t\t9\nlonely\n")
    assert sorted(tuple(r) for r in fm.read_regions(spark, str(tmp_path / "regions.tsv")).collect()) == [(3, 10, 20), (23, 5, 6)]
    line = lambda chrom, exons: "\t".join(["g1", "a", "b", "c", "d", chrom, "+", exons, "e", "f", "g", "ACGU"])
    (tmp_path / "rna.tsv").write_text(line("chr7", "10..20,30..44") + "\nshort\tline\n" + line("chrY", "1..2") + "\n")
    got = {r["chr"]: r for r in fm.read_transcript_table(spark, str(tmp_path / "rna.tsv")).collect()}
    assert [tuple(x) for x in got[7]["exons"]] == [(10, 20), (30, 44)] and got.keys() == {7, 24}
    assert (got[7]["gene"], got[7]["strand"], got[7]["rna"]) == ("g1", "+", "ACGU")


def test_vcf_keeps_all_samples(spark, tmp_path):
    row = "\t".join(["chr1", "7", ".", "A", "C", ".", "PASS", "DP=1", "GT"] + ["0/1"] * 1200)
    (tmp_path / "many.vcf").write_text(f"#CHROM\n{row}\n")
    got = fm.read_vcf(spark, str(tmp_path / "many.vcf")).first()
    assert len(got["samples"]) == 1200 and got["samples"][1199] == {"GT": "0/1"}
