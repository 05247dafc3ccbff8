"""Round trips of file formats and one end-to-end run."""

import lzma
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.pipelines import HmmConfig, SfsConfig, run_hmm, run_sfs
from strandline.plans import fixture as X
from strandline.sources import binary as B
from strandline.sources import text as T
from strandline.sources.sinks import vcf_header, vcf_lines, write_vcf


def test_vcf_to_panel_and_target(spark):
    head = ["##x", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "a", "b", "c"])]
    body = ["1\t10\t.\tA\tG\t.\t.\t.\tGT:DP\t0/1:3\t1|1:2\t./.:0", "1\t20\t.\tA\tG,T\t.\t.\t.\tGT\t0/2\t0/0\t0/0", "1\t30\t.\tA\tG,T\t.\t.\t.\tGT\t1/2\t0/0\t0/0", "1\t40\t.\tAC\tG\t.\t.\t.\tGT\t0/1\t0/0\t0/0", "X\t5\t.\tC\tT\t.\t.\t.\tGT\t1\t0/0\t0/1"]
    lines = spark.createDataFrame([(x,) for x in head + body], "value string")
    c = T.genotype_counts(T.parse_vcf(lines, ["a", "b", "c"]), pseudo_haploid=["c"])
    p = {(r.chrom, r.pos): r for r in T.vcf_panel(c, {"P": ["a", "b"], "Q": ["c"]}).collect()}
    assert set(p) == {("1", 10), ("1", 20), ("X", 5)}
    r = p["1", 10]
    assert (r.ref, r.alt, r.P_ref, r.P_alt, r.Q_ref, r.Q_alt) == ("A", "G", 1, 3, 0, 0)
    assert (p["1", 20].alt, p["1", 20].P_alt) == ("T", 1)
    assert (p["X", 5].P_ref, p["X", 5].P_alt, p["X", 5].Q_ref, p["X", 5].Q_alt) == (2, 1, 1, 0)
    t = T.vcf_target(c, spark.createDataFrame([("1", 10)], "chrom string, pos int"), "a").collect()
    assert [(r.pos, r.tref, r.talt) for r in t] == [(10, 1, 1)]


def test_text_formats(spark, tmp_path):
    (tmp_path / "m").write_text('"Physical_Pos" "deCODE"\n100 0.5\n200 0.7\n')
    assert [(r.pos, r.map) for r in T.read_recombination_map(spark, str(tmp_path / "m"), "9", "deCODE").collect()] == [(100, 0.5), (200, 0.7)]
    (tmp_path / "b.bed").write_text("1\t0\t3\n1\t2\t5\n2\t7\t8\n")
    bed = T.read_bed(spark, str(tmp_path / "b.bed"))
    assert sorted((r.chrom, r.pos) for r in T.bed_positions(bed).collect()) == [("1", i) for i in range(1, 6)] + [("2", 8)]
    assert T.bed_positions(bed, "1", 2, 4, 2).count() == 2
    (tmp_path / "f.fa").write_text(">1 x\nAC\ngt\n>2\nTT\n")
    assert sorted((r.chrom, r.pos, r.base) for r in T.read_fasta(spark, str(tmp_path / "f.fa")).collect()) == [("1", 1, "A"), ("1", 2, "C"), ("1", 3, "G"), ("1", 4, "T"), ("2", 1, "T"), ("2", 2, "T")]
    (tmp_path / "c.csv.xz").write_bytes(lzma.compress(b"chrom,pos,lib,tref,talt\n1,5,a,2,0\nX,7,,1,1\n"))
    got = T.load_counts(T.read_table(spark, str(tmp_path / "c.csv.xz"), T.COUNTS)).collect()
    assert sorted((r.chrom, r.pos, r.lib, r.tref, r.talt) for r in got) == [("1", 5, "a", 2, 0), ("X", 7, "lib0", 1, 1)]


def test_two_panel_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("chrom,pos,ref,alt,map,AFR_ref,AFR_alt\n1,5,A,C,0.1,3,1\n1,5,A,C,0.1,3,1\n1,6,A,C,,3,1\n1,7,G,T,0.2,2,2\n")
    (tmp_path / "b.csv").write_text("chrom,pos,ref,alt,map,AFR_ref,AFR_alt,NEA_ref,NEA_alt\n1,5,A,C,0.1,9,9,1,0\n")
    rows = T.load_panel(spark, [str(tmp_path / "a.csv")], {"AFR": ["AFR"]}).collect()
    assert sorted((r.pos, r.AFR_ref) for r in rows) == [(5, 3), (7, 2)]


def test_packed_genotypes(spark, tmp_path):
    rng = np.random.default_rng(0)
    n_ind, n_snp = 9, 23
    g = rng.integers(0, 4, (n_snp, n_ind))
    size = B.record_length(n_ind)
    data = bytearray(f"GENO {n_ind} {n_snp} 0 0".encode().ljust(size, b"\0"))
    for row in g:
        rec = bytearray(size)
        for i, v in enumerate(row):
            rec[i // 4] |= int(v) << (6 - 2 * (i % 4))
        data += rec
    (tmp_path / "x.geno").write_bytes(bytes(data))
    (tmp_path / "x.ind").write_text("".join(f"s{i} {'MF'[i % 2]} P{i % 3}\n" for i in range(n_ind)))
    (tmp_path / "x.snp").write_text("".join(f"rs{i} {23 if i > 20 else 1} 0.0{i:02d} {i + 1} A C\n" for i in range(n_snp)))
    out = B.read_eigenstrat(spark, str(tmp_path / "x"))
    got = {(r.chrom, r.pos, r["sample"]): r.n_ref for r in out.collect()}
    for i in range(n_snp):
        for k in range(n_ind):
            assert got["X" if i > 20 else "1", i + 1, f"s{k}"] == (None if g[i, k] == 3 else g[i, k])
    c = B.population_counts(out).where("chrom = '1' and pos = 1").collect()
    assert sum(r.n_ref for r in c) == sum(int(v) for v in g[0] if v != 3)


def bgzf_block(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def test_bam_pileup(spark, tmp_path):
    def read(pos, seq, flag=0, cigar=None, rg="lib-1", md=None):
        name, cig = b"r\0", cigar or [(len(seq), 0)]
        packed = bytearray((len(seq) + 1) // 2)
        for i, b in enumerate(seq):
            packed[i // 2] |= B.BASES.index(b) << (4 if i % 2 == 0 else 0)
        tags = b"RGZ" + rg.encode() + b"\0MDZ" + (md or str(len(seq))).encode() + b"\0" + b"NMi" + struct.pack("<i", 0)
        body = struct.pack("<iiBBHHHi", 0, pos - 1, len(name), 30, 0, len(cig), flag, len(seq)) + struct.pack("<iii", -1, -1, 0) + name + b"".join(struct.pack("<I", n << 4 | o) for n, o in cig) + bytes(packed) + bytes([40] * len(seq)) + tags
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"1\0" + struct.pack("<i", 1000)
    reads = read(10, "ACGTT", md="1C2T0") + read(12, "GGGGG", 16) + read(11, "TACG", md="0C3") + read(10, "ACGTA", cigar=[(3, 0), (2, 4)]) + read(10, "ACGTA", rg="PhiX") + read(500, "AAAA")
    (tmp_path / "x.bam").write_bytes(bgzf_block(head) + bgzf_block(reads[:50]) + bgzf_block(reads[50:]) + bgzf_block(b""))
    r = B.read_bam(spark, str(tmp_path / "x.bam"))
    assert r.count() == 6
    sites = spark.createDataFrame([("1", 12, "G", "A"), ("1", 13, "C", "T"), ("1", 900, "A", "C")], "chrom string, pos int, ref string, alt string")
    piles = B.pileup(r, sites)
    assert sorted((x.pos, x.base, x.rg, x.deam) for x in piles.collect()) == sorted([(12, "G", "lib", -1), (12, "G", "lib", -1), (12, "A", "lib", 0), (13, "T", "lib", -1), (13, "G", "lib", -1), (13, "C", "lib", 0)])
    c = {(x.pos, x.lib): (x.tref, x.talt, x.tdeam, x.tother) for x in B.pileup_counts(piles).collect()}
    assert c[12, "lib_nodeam"] == (2, 0, 0, 0) and c[13, "lib_nodeam"] == (0, 1, 1, 1) and c[12, "lib_deam"] == (0, 1, 0, 0)


def test_vcf_output(spark, tmp_path):
    df = spark.createDataFrame([("1", 5, "A", "C", "A", -0.1, -1.0, -2.0, 0.8, 0.15, 0.05, 7)], "chrom string, pos int, ref string, alt string, aa string, l0 double, l1 double, l2 double, g0 double, g1 double, g2 double, depth int")
    assert vcf_lines(df).first()[0] == "1\t5\t.\tA\tC\t.\tPASS\tAA=A\tGT:GL:GP:DP\t0/0:-0.1,-1,-2:0.8,0.15,0.05:7"
    more = df.unionByName(df.withColumns({"chrom": F.lit("10"), "pos": F.lit(3)})).unionByName(df.withColumn("pos", F.lit(2))).unionByName(df.withColumn("chrom", F.lit("X")))
    write_vcf(more.repartition(3), str(tmp_path / "o"), ["s"])
    lines = [x for p in sorted((tmp_path / "o").glob("part-*")) for x in p.read_text().splitlines()]
    head = vcf_header(["s"])
    assert lines[: len(head)] == head
    assert [tuple(x.split("\t")[:2]) for x in lines[len(head) :]] == [("1", "2"), ("1", "5"), ("10", "3"), ("X", "5")]


def test_runs_recover_the_source(spark):
    d = "/root/testdata/sf0.001"
    panel = X.sites(spark, d).withColumn("map", F.col("pos") * 1e-6)
    counts = X.obs(spark, d).select("chrom", "pos", "lib", "tref", "talt")
    r = run_hmm(panel, counts, HmmConfig(sources=("AFR", "NEA"), max_iter=2, replicates=3, high_cov=None))
    assert r.fit.ll[-1] > r.fit.ll[0]
    p = r.tables["bin"].agg(F.avg("NEA"), F.avg("AFR")).first()
    assert p[0] > p[1]  # the first 100 kb of every chromosome follow the second source
    assert {"bin", "snp", "rle", "sim", "occupancy", "cont", "pars"} == set(r.tables)
    snp = r.tables["snp"].agg(F.min(F.pow(F.lit(10.0), "log_g0") + F.pow(F.lit(10.0), "log_g1") + F.pow(F.lit(10.0), "log_g2")), F.count("p")).first()
    assert snp[0] == pytest.approx(1.0) and snp[1] == counts.select("chrom", "pos").distinct().count()
    assert r.tables["occupancy"].agg(F.sum("mean")).first()[0] == pytest.approx(1.0)
    s = run_sfs(panel, counts, SfsConfig(max_iter=2, states=("NEA", "DEN", "PAN"), jackknife=2))
    assert set(s) == {"pars", "sfs", "cont", "snp", "f2", "f3", "f4", "vcf"}
    assert s["sfs"].where("n_snps > 0 and se_tau is not null and l_tau <= tau").count() > 0
    assert {r[0] for r in s["f4"].select("rep").distinct().collect()} == {"0", "1", "2"}
    assert s["cont"].where("se_cont >= 0 and n_reads > 0").count() == counts.select("lib").distinct().count()
    v = s["vcf"].select(*[F.abs(F.col("g0") + F.col("g1") + F.col("g2") - 1).alias("d")]).agg(F.max("d"), F.count("d")).first()
    assert v[0] < 1e-9 and v[1] == s["snp"].count() > 0


def test_genotype_mode_and_haploid_chromosomes(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    panel = X.sites(spark, d).withColumn("map", F.col("pos") * 1e-6)
    calls = X.obs(spark, d).groupBy("chrom", "pos").agg(F.least(F.sum("tref"), F.lit(2)).alias("tref"), F.least(F.sum("talt"), F.lit(2)).alias("talt"))
    calls = calls.withColumn("talt", F.least("talt", 2 - F.least("tref", F.lit(2)))).withColumn("tref", 2 - F.col("talt")).withColumn("lib", F.lit("gt"))
    r = run_hmm(panel, calls, HmmConfig(sources=("AFR", "NEA"), gt_mode=True, sex="m", max_iter=2, replicates=2, high_cov=None, prior=0.5, favoured=("AFR",)))
    assert r.fit.ll[-1] > r.fit.ll[0] and r.fit.params.cont == {"gt": 0.01}
    x = r.tables["bin"].where("haploid").agg(F.max("AFRNEA"), F.min(F.col("AFR") + F.col("NEA")), F.count_distinct("chrom")).first()
    assert x[0] == 0 and x[1] == pytest.approx(1.0) and x[2] == 1
    assert r.tables["bin"].where("not haploid and AFRNEA > 0").count() > 0
    strands = {a: b for a, b in r.tables["sim"].where("it = 0").groupBy("chrom").agg(F.sum("len")).collect()}
    bins = {a: b for a, b in r.tables["bin"].groupBy("chrom").count().collect()}
    assert all(strands[c] == bins[c] * (1 if c == "X" else 2) for c in bins)
    one = run_hmm(panel, calls, HmmConfig(sources=("AFR", "NEA"), gt_mode=True, snp_mode=True, max_iter=1, replicates=1, high_cov=None, ancestral="PAN", ancestral_prior=0.1, rates=((-0.1, 0.1), (0.2, -0.2)), outputs=("bin", "pars")))
    assert one.tables["bin"].count() == S_count(panel)
    one.write(str(tmp_path / "r"))
    assert "converged: false" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "r.yaml")).collect())
    for rr in (False, True):
        s = run_sfs(panel, calls, SfsConfig(gt_mode=True, random_read=rr, max_iter=2))
        assert s["sfs"].where("n_anc + n_der > 0 and read_ratio between 0 and 1").count() > 0 and s["snp"].count() > 0


def S_count(panel):
    return panel.where("PAN_ref + PAN_alt > 0").count()


def test_command_line_runs_panels_and_counts(spark, tmp_path):
    from strandline.__main__ import main

    bins = spark.createDataFrame([("1", i, i * 0.1, i * 100, "NEA" if 3 < i < 9 else "AFR", 1, 0.05 if 3 < i < 9 else 0.95, 0.9 if 3 < i < 9 else 0.02, 0.05 if 3 < i < 9 else 0.03) for i in range(14)], "chrom string, bin long, map double, pos long, viterbi string, n_snps int, AFR double, NEA double, AFRNEA double")
    bins.coalesce(1).write.option("header", True).csv(str(tmp_path / "bins"))
    main(["runs", "--in", str(tmp_path / "bins"), "--out", str(tmp_path / "rle")])
    got = spark.read.option("header", True).csv(str(tmp_path / "rle")).where("target = 'NEA' and type = 'homo'").collect()
    assert [(r.start, r.end, r.pos, r.pos_end) for r in got] == [("4", "8", "400", "800")] or [(r.start, r.end) for r in got] == [("5", "8")]
    (tmp_path / "pops.yaml").write_text("P: [a, b]\nQ: [c]\n")
    (tmp_path / "x.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc\n1\t100\t.\tA\tG\t.\t.\t.\tGT\t0/1\t1/1\t0/0\n")
    main(["panel", "--vcf", str(tmp_path / "x.vcf"), "--out", str(tmp_path / "panel"), "--state-file", str(tmp_path / "pops.yaml"), "--format", "parquet"])
    r = spark.read.parquet(str(tmp_path / "panel")).first()
    assert (r.P_ref, r.P_alt, r.Q_ref, r.Q_alt) == (1, 3, 2, 0) and r.map == pytest.approx(1e-4)
