"""Readers and writers on small hand-made files."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from loomspan.sinks import writers as W
from loomspan.sources import readers as R
from loomspan.streaming import windows as SW


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        if name.endswith(".gz"):
            with gzip.open(p, "wt") as f:
                f.write(text)
        else:
            p.write_text(text)
        return str(p)

    return write


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_vcf(spark, put):
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n"
    p = put("a.vcf.gz", head + "c1\t100\ta\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;END=50;PRECISE;SVLEN=-70,80\tGT\t0/1\t./.\nc1\tx\tb\tN\tN\t1\t.\tA=1\tGT\t0/0\t1/1\nc2\t7\td\tN\tN]c3:9]\t3.5\tLow\tSVTYPE=BND\tGT\t0/1\t0/0\n")
    df = R.vcf(spark, p)
    assert rows(df.select("chrom", "pos", "end", "id", "svtype", "len", "qual", "mate_chrom", "mate_pos")) == [("c1", 50, 100, "a", "DEL", 80, None, None, None), ("c2", 7, 7, "d", "BND", 1, 3.5, "c3", 9)]
    assert df.where("id = 'a'").first()["samples"] == ["0/1", "./."] and R.vcf_samples(spark, p) == ["s1", "s2"]


def test_paf_blocks_and_filter(spark, put):
    p = put("a.paf", "q\t100\t0\t90\t+\tt\t200\t10\t100\t80\t20000\t60\ttp:A:P\tdv:f:0.01\nq\t100\t0\t9\t-\tt\t200\t10\t19\t8\t9\t60\n")
    df = R.paf(spark, p)
    assert df.where("strand = '+'").first()["tags"] == {"tp": "P", "dv": "0.01"}
    assert R.alignment_filter(df).count() == 1
    assert sorted(r["block_id"] for r in R.sequence_blocks(df).collect()) == ["q_1", "q_2"]


def test_gff_gtf_bed(spark, put):
    p = put("a.gff3", "#c\nc\ts\tgene\t1\t9\t.\t+\t.\tID=g1;Name=a%20b;Name=z; Note=\nshort\n")
    r = R.gff3(spark, p).first()
    assert r["start"] == 1 and r["score"] is None and r["attributes"]["ID"] == "g1" and r["attributes"]["Name"] == "a b"
    g = put("a.gtf", 'c\ts\texon\t1\t9\t.\t+\t.\tgene_id "g"; transcript_id "t";\n')
    assert R.gtf(spark, g).first()["transcript_id"] == "t"
    b = put("a.bed", "track x\nc\t1.0\t9\nc\t5\t7\tn\t3\t-\nc\tx\t7\n")
    assert rows(R.bed(spark, b)) == [("c", 1, 9, "c:1-9", None, None), ("c", 5, 7, "n", 3.0, "-")]
    w = put("a.bg", "track\nc\t0\t5\t1.5\nc\t5\t6\tnan\nd\t0\t1\t2\nc\t6\t7\tinf\n")
    assert rows(R.bedgraph(spark, w, ["c"])) == [("c", 0, 5, 1.5)]
    k = put("a.peak", "c\t1\t2\tp\t0\t.\t2.5\t1\t6\nc\t1\t2\tq\t0\t.\t1.0\t1\t6\n")
    assert R.broad_peak(spark, k).count() == 1


def test_fasta_and_maf(spark, put):
    p = put("a.fa", ">s1#LTR/Copia x y\nac\ngt\r\n>s2\nNN\n")
    assert rows(R.fasta(spark, p).select("id", "sequence")) == [("s1#LTR/Copia", "ACGT"), ("s2", "NN")]
    assert rows(R.fasta(spark, p, by_class=True).select("id", "cls")) == [("s1", "LTR/Copia"), ("s2", None)]
    assert rows(R.fasta_lengths(R.fasta(spark, p))) == [("s1#LTR/Copia", 4), ("s2", 2)]
    m = put("a.maf", "##maf\na score=1\ns A.chr1 5 3 + 10 ACG\ns B.chr2 1 3 - 10 ACT\n\na score=2\ns A.chr1 9 1 + 10 A\n")
    df = R.maf(spark, m)
    assert rows(df.select("species", "chrom", "start", "size", "text")) == [("A", "chr1", 5, 3, "ACG"), ("A", "chr1", 9, 1, "A"), ("B", "chr2", 1, 3, "ACT")]
    assert R.maf_species_blocks(df, [], exactly=1).count() == 1 and R.maf_species_blocks(df, ["B"], least=1).count() == 2


def test_chain_axt_blast_trf(spark, put):
    c = put("a.chain", "chain 900 t 100 + 10 40 q 50 - 5 30 7\n10 5 0\n8 0 2\n5\n\n")
    assert rows(R.chain(spark, c).select("t_start", "t_end", "q_start", "q_end")) == [(10, 20, 35, 45), (25, 33, 27, 35), (33, 38, 20, 25)]
    a = put("a.axt", "0 t 11 20 q 1 10 + 500\nACGT\nACGT\n\n")
    assert rows(R.axt(spark, a)) == [("t", 10, 20, "q", 0, 10, "+", 500)]
    b = put("a.b6", "q\ts\t99.0\t100\t1\t0\t1\t100\t250\t151\t1e-9\t180\nq\ts\t99.0\t10\t1\t0\t1\t10\t1\t10\t1\t18\n")
    assert rows(R.blast6(spark, b, 80, 1e-5, 100).select("s_start", "s_end", "s_strand")) == [(150, 250, "-")]
    t = put("a.dat", "head\nSequence: c1 x\n\n1 60 20 3.0 20 95 0 100 25 25 25 25 2.0 ACGT ACGTACGT\nSequence: c2\n5 9 2 2.5 2 90 0 9 1 1 1 1 1 AT ATAT\n")
    assert rows(R.trf_dat(spark, t).select("chrom", "start", "end", "period", "consensus")) == [("c1", 0, 60, 20, "ACGT"), ("c2", 4, 9, 2, "AT")]


def test_repeat_tables(spark, put):
    t = put("a.cls", "#TE\tOrder\nx#LTR\tLTR\tCopia\tAle\tyes\t+\tGAG\nx#LTR\tLTR\tGypsy\tTek\tyes\t+\tGAG\n")
    assert rows(R.tesorter_cls(spark, t).select("id", "superfamily")) == [("x", "Copia")]
    p = put("a.list", "#LTR_loc c\nc1:101..200 pass motif:TGCA TSD:x 1..2 IN:3 y 0.98 + Copia LTR 1234\nc1:300..201 pass m t a b c 0.9 - Gypsy LTR NA\n")
    got = rows(R.pass_list(spark, p).select("chrom", "start", "end", "identity", "te_type", F.round("insertion_time")))
    assert got[0] == ("c1", 100, 200, 0.98, "LTR", 1234.0) and got[1][1:3] == (200, 300) and got[1][5] == round(0.1 / 2.6e-8)
    o = put("a.out", "   SW perc\nscore\n\n  100 1.5 0 0 old 11 20 (5) C fam LTR/Copia 1 2 3 1\n  100 1.5 0 0 zz 11 20 (5) + fam LTR 1 2 3 1\n")
    m = spark.createDataFrame([("old", "new")], "a string, b string")
    assert rows(R.repeatmasker_out(spark, o, m).select("seq", "start", "strand", "mapped")) == [("new", 10, "-", True), ("zz", 10, "+", False)]


def test_matrices_and_orders(spark, put):
    f = put("counts.tsv", "Orthogroup\tA\tB\tTotal\nO1\t1\t2\t3\nO2\t0\tx\t0\n")
    assert rows(R.family_matrix(spark, f)) == [("O1", "A", 1), ("O1", "B", 2), ("O2", "A", 0), ("O2", "B", None)]
    g = put("genes.tsv", "Orthogroup\tA\tB\nO1\tA|g1, A|g2\t\n")
    assert rows(R.family_genes(spark, g)) == [("O1", "A", "g1"), ("O1", "A", "g2")]
    s = put("stats.tsv", "m\tA\tB\nx\t1\t2\n\nsecond\tpart\n")
    assert [r["cells"][0] for r in R.first_section(spark, s).orderBy("line").collect()] == ["m", "x"]
    o = put("order.gff", "c\tg1\t1\t9\t+\t1\to1\nc\tg2\t11\t19\t-\t2\to2\n")
    assert R.gene_order(spark, o).count() == 2
    with pytest.raises(Exception, match="repeated keys"):
        R.gene_order(spark, put("bad.gff", "c\tg1\t1\t9\t+\t1\to1\nc\tg2\t11\t19\t-\t1\to2\n")).collect()
    with pytest.raises(Exception, match="bad segment line"):
        R.segments(spark, put("bad.km", "c\t1\t2\tred\n")).collect()
    assert R.segments(spark, put("ok.km", "c\t1\t2\tred\t1\n")).count() == 1
    b = put("blocks.csv", "id,chr1,block1,block2,ks\n1,c,1_2_3,7_6_5,0.1_nan_0.3\n")
    assert R.blockinfo(spark, b).first()["ks"] == [0.1, 0.3]
    z = put("a.fai", "c2\t10\t0\nc1\t20\t0\n")
    assert rows(R.contig_sizes(spark, z)) == [("c1", 20, 2), ("c2", 10, 1)]


def test_signal_tables(spark, put):
    c = put("a.cx", "c\t5\t+\t3\t1\tCG\tCGA\nc\t6\t+\t0\t0\tCG\tCGA\nc\t7\t+\t3\t1\tXX\tCGA\n")
    assert rows(R.cx_report(spark, c)) == [("c", 5, "+", 3, 1, "CG")]
    h = put("a.histo", "1 100\n2\t50\nx y\n")
    assert rows(R.kmer_histogram(spark, h).drop("file")) == [(1, 100), (2, 50)]
    a = put("ab.tsv", "c\t0\t9\t0.5\nc\t9\t18\t\n")
    assert R.compartments(spark, a).count() == 1
    d = put("depth.tsv", "c\t0\t9\tv1|left\t3.5\n")
    assert rows(R.region_depth(spark, d).select("name", "tag", "depth")) == [("v1", "left", 3.5)]
    t = put("tandem.csv", "seq,start,end,w\nc,11,20,178\n")
    assert rows(R.tandem_summary(spark, t)) == [("c", 10, 20, "rep_178")]


def test_annotation_tables(spark, put, tmp_path):
    e = put("a.emapper", "## v\n#query\tKO\nq1\tko:1,ko:2\nq1\tko:1;ko:3\nq2\t-\n")
    assert rows(R.emapper(spark, e, "KO")) == [("q1", "ko:1"), ("q1", "ko:2"), ("q1", "ko:3")]
    assert rows(R.first_column(spark, put("ids", "#x\na b\na c\nd\n"))) == [("a",), ("d",)]
    put("sp1/s.json", json.dumps({"parameters": {"mode": "prot"}, "lineage_dataset": {"name": "l"}, "results": {"Complete": 98.5, "n_markers": 10}}))
    put("sp2/s.json", "{bad")
    got = R.busco_json(spark, str(tmp_path / "sp*/s.json"), "prot").collect()
    assert [(r["species"], r["complete"], r["markers"]) for r in got] == [("sp1", 98.5, 10)]
    assert rows(R.busco_table(spark, put("ft", "#\nb1\tComplete\nb1\tMissing\nb2\tMissing\n"))) == [("Complete", 1), ("Missing", 1)]
    put("s1/quant.sf", "Name\tLength\tTPM\nt1\t5\t1.5\nt2\t5\tx\n")
    q = R.quant(spark, str(tmp_path / "s1/quant.sf"), spark.createDataFrame([("s1", "ctl")], "sample_id string, group string"))
    assert rows(q.select("name", "tpm", "group")) == [("t1", 1.5, "ctl"), ("t2", None, "ctl")]
    assert rows(R.gene_sums(q, spark.createDataFrame([("t1", "g1")], "tx_id string, gene_id string")))[0] == ("g1", "s1", 1.5)
    u = put("u.dat", "ID x\nAC   P1;\nDR   GO; GO:1; x\nDR   GO; GO:2; x\n//\nAC   P2;\n//\n")
    assert rows(R.flat_records(spark, u, {"go": r"GO; (GO:\d+)"})) == [("P1", ["GO:1", "GO:2"]), ("P2", [])]


def test_events_and_anchors(spark, put):
    a = put("comb", "c\t10\t200\tdel\t190\nc\t10\t200\tDEL\t190\nc\t5\t9\tINS\t4\n")
    i = put("inv", "c\t90\t40\n")
    got = rows(R.assembly_events(spark, {"combined": a, "inv": i}).select("layout", "start", "end", "type", "len"))
    assert got == [("combined", 10, 200, "DEL", 190), ("inv", 40, 90, "INV", 50)]
    s = put("a.simple", "a1\ta2\tb1\tb2\t10\t+\n")
    ga = spark.createDataFrame([("a1", "A", 1, 5), ("a2", "A", 50, 60)], "gene string, chrom string, start bigint, end bigint")
    gb = spark.createDataFrame([("b1", "B", 100, 105), ("b2", "B", 70, 80)], "gene string, chrom string, start bigint, end bigint")
    assert rows(R.anchor_spans(spark, s, ga, gb)) == [("A", "B", 1, 60, 70, 105, 1)]
    ch = spark.createDataFrame([("f1", "3"), ("f2", "-2"), ("f3", "4")], "fam string, br string")
    pr = spark.createDataFrame([("f1", "0.01"), ("f2", "0.02"), ("f3", "N/A")], "fam string, br string")
    assert rows(R.significant(ch, pr, "fam", "br").select("fam", "direction")) == [("f1", "expansion"), ("f2", "contraction")]


def test_driver_side_files(put, tmp_path):
    put("d/a.longer.txt", "x")
    put("d/b.txt", "x")
    put("d/empty.tsv", "")
    assert R.first_existing(str(tmp_path / "d"), ["*.tsv", "*.txt"]).endswith("b.txt") and R.first_existing(str(tmp_path / "d"), ["*.zz"]) is None
    assert R.ini_section(put("c.ini", "[a]\nk=v\n"), "a") == {"k": "v"} and R.ini_section(str(tmp_path / "c.ini"), "z") == {}
    conf = R.run_config(put("run.json", '{"x": "c.ini", "n": 3, "y": "absent"}'))
    assert conf["x"] == str(tmp_path / "c.ini") and conf["n"] == 3 and conf["y"] == "absent"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.5), ("b", None, 0.0)], "k string, n bigint, v double")
    W.tsv(df, str(tmp_path / "t"), ["n", "k"], compression="gzip")
    assert rows(R.csv_rows(spark, str(tmp_path / "t"))) == [("1", "a"), (None, "b")]
    with pytest.raises(Exception):
        W.tsv(df, str(tmp_path / "t"))
    W.wide(spark.createDataFrame([("r", "x", 1.0)], "r string, c string, v double"), str(tmp_path / "w"), "r", "c", "v", ["x", "y"])
    assert rows(R.csv_rows(spark, str(tmp_path / "w"))) == [("r", "1.000000", "0.000000")]
    W.bed(spark.createDataFrame([("c", 1, 9)], "c string, s bigint, e bigint"), str(tmp_path / "b"), "c", "s", "e", closed=True)
    assert rows(R.bed(spark, str(tmp_path / "b")).select("start", "end")) == [(0, 9)]
    v = spark.createDataFrame([("c", 5, "x", "N", "<DEL>", None, "PASS", "SVTYPE=DEL", "GT", ["0/1", "1/1"])], "chrom string, pos bigint, id string, ref string, alt string, qual double, filt string, info string, format string, samples array<string>")
    line = W.vcf_lines(v, {"SRC": F.lit("a"), "NONE": F.lit(None).cast("string")}, F.lit("new")).first()["value"]
    assert line == "c\t5\tnew\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;SRC=a\tGT\t0/1\t1/1"
    f = W.fasta_lines(spark.createDataFrame([("s", "A" * 70), ("t", "C" * 60)], "n string, s string"), "n", "s")
    W.text(f, str(tmp_path / "f"))
    assert rows(R.fasta(spark, str(tmp_path / "f")).select("id", F.length("sequence"))) == [("s", 70), ("t", 60)]
    (tmp_path / "one.bin").write_bytes(b"abc")
    assert W.checksums(spark, str(tmp_path / "one.bin")).first()["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert rows(W.render_null(df))[1] == ("b", "NA", "0.0") and os.path.basename(W.versioned(str(tmp_path))).startswith("v")


def test_streams_agree_with_batch(spark, tmp_path):
    d = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = SW.read_files(spark, str(tmp_path / "in"), batch.schema)
    q = SW.to_memory(SW.tumbling(stream, "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n")]), "tumble", "complete")
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("tumble")) == rows(SW.tumbling(batch, "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n")]))
    q = SW.to_parquet(SW.first_seen(stream, ["user_id"], "ts", "60 days").select("user_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.select("user_id").distinct().count()
    q = SW.to_memory(SW.sessions(stream, "ts", "30 minutes", ["user_id"], [F.count(F.lit(1)).alias("n")]), "sess", "complete")
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("sess")) == rows(SW.sessions(batch, "ts", "30 minutes", ["user_id"], [F.count(F.lit(1)).alias("n")]))
