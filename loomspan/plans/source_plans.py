"""Round trips: slices of the tables written in a format's layout, read back by its reader.

The SQL states what the reader must give, from the tables; it knows nothing of the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import scalars as S
from loomspan.operators import composites as C
from loomspan.operators import intervals as I
from loomspan.operators import karyotype as K
from loomspan.operators import matching as M
from loomspan.operators import pav as P
from loomspan.operators import relational as O
from loomspan.operators import signal as G
from loomspan.plans.signal_plans import CALLS, EX, _calls, _exons
from loomspan.runtime import Scratch, table
from loomspan.sinks import writers as W
from loomspan.sources import readers as R
from loomspan.streaming import windows as SW


def _path(spark: SparkSession, name: str) -> str:
    return Scratch(spark, name).path


def _line(*cols: Column | str | int, sep: str = "\t") -> Column:
    """A line of cells; null as an empty cell."""
    return F.concat_ws(sep, *(F.coalesce(c.cast("string"), F.lit("")) if isinstance(c, Column) else F.lit(str(c)) for c in cols)).alias("value")


def _put(df: DataFrame, name: str, one: bool = False, compression: str | None = None) -> str:
    """Write lines; ``one`` keeps their order in a single file."""
    path = _path(df.sparkSession, name)
    W.text(df.coalesce(1) if one else df, path, compression=compression)
    return path


c = F.col


def _exon_rows(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gtf").where("type = 'exon' and seq_id is not null and left is not null and right is not null and strand is not null")
    return g.select("seq_id", c("gene_id"), c("transcript_id"), c("strand"), F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b"), "score", "phase").distinct()


_EXONS = """x AS (SELECT DISTINCT seq_id, gene_id, transcript_id, strand, least("left", "right") AS a, greatest("left", "right") AS b, score, phase FROM gtf WHERE type = 'exon' AND seq_id IS NOT NULL AND "left" IS NOT NULL AND "right" IS NOT NULL AND strand IS NOT NULL)"""


def vcf_scan(spark, d):
    """Calls as an annotated variant file; TRA as breakends."""
    v = _calls(spark, d).where("type is not null")
    info = F.concat_ws(";", F.concat(F.lit("SVTYPE="), "type"), F.concat(F.lit("END="), c("c_start") + 1), F.concat(F.lit("SVLEN=-"), c("c_end") - c("c_start"), F.lit(",1")))
    v = v.select("chrom", c("c_end").alias("pos"), "id", F.lit("N").alias("ref"), F.when(c("type") == "TRA", F.concat(F.lit("N]chrZ:"), c("c_end"), F.lit("]"))).otherwise(F.concat(F.lit("<"), "type", F.lit(">"))).alias("alt"), "qual", F.lit("PASS").alias("filt"), info.alias("info"), F.lit("GT").alias("format"), F.array(F.lit("0/1"), F.coalesce("sample", F.lit("."))).alias("samples"))
    head = spark.createDataFrame([("##fileformat=VCFv4.2",), ("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb",), ("c\tnone\tx\tN\tN\t.\t.\t.\tGT\t.\t.",)], "value string")
    path = _put(head.unionByName(W.vcf_lines(v, {"SRC": F.lit("t")}, F.concat(F.lit("n_"), "id"))), "vcf", compression="gzip")
    out = R.vcf(spark, path)
    return out.select("chrom", "pos", "end", "id", "svtype", "len", "qual", "mate_chrom", "mate_pos", c("info")["SRC"].alias("src"), c("samples")[1].alias("sample"))


def paf_scan(spark, d):
    """Calls as alignments: fixed columns, tags, the quality filter and the block layout."""
    v = _calls(spark, d).where("type is not null and qual is not null").select("id", "chrom", "c_start", "c_end", "qual", F.when(c("type") == "INV", "-").otherwise("+").alias("st"), F.when(c("type") == "DUP", "S").otherwise("P").alias("tp"), ((c("c_end") % 30) / 100).alias("dv"))
    line = _line(c("chrom"), 10**9, c("c_start"), c("c_end"), c("st"), F.concat(F.lit("t_"), "id"), 10**9, c("c_start") + 5, c("c_end") + 5, c("c_end") - c("c_start"), c("c_end") - c("c_start"), F.floor("qual"), F.concat(F.lit("tp:A:"), "tp"), F.concat(F.lit("dv:f:"), c("dv").cast("string")))
    df = R.alignment_filter(R.paf(spark, _put(v.select(line), "paf")), 15, 100, 0.2)
    return R.sequence_blocks(df).select("block_id", "q_start", "q_end", "t_name", "t_start", "block_strand", "score")


def gff_scan(spark, d):
    x = _exon_rows(spark, d).where("gene_id is not null")
    attr = F.concat(F.lit("ID="), "gene_id", F.lit(";Name=a%20"), "strand", F.lit("; Name=second;Note="))
    df = R.gff3(spark, _put(x.select(_line(c("seq_id"), "src", "exon", c("a"), c("b"), F.coalesce(c("score").cast("string"), F.lit(".")), c("strand"), F.coalesce(c("phase").cast("string"), F.lit(".")), attr)), "gff"))
    return df.groupBy("seq_id", c("attributes")["ID"].alias("gene"), c("attributes")["Name"].alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("a"), F.max("end").alias("b"), F.count("score").alias("scored"), F.count("phase").alias("phased"))


def gtf_scan(spark, d):
    x = _exon_rows(spark, d)
    attr = F.concat(F.coalesce(F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; ')), F.lit("")), F.coalesce(F.concat(F.lit('transcript_id "'), "transcript_id", F.lit('";')), F.lit("")))
    df = R.gtf(spark, _put(x.select(_line(c("seq_id"), "src", "exon", c("a"), c("b"), ".", c("strand"), ".", attr)), "gtf"))
    return df.groupBy("gene_id", "transcript_id").agg(F.count(F.lit(1)).alias("n"), F.sum(c("right") - c("left") + 1).alias("bp"))


def bed_scan(spark, d):
    """Exons through the sink, closed to half-open; every second without a name."""
    x = _exon_rows(spark, d).select("seq_id", "a", "b").distinct()
    path = _path(spark, "bed")
    W.bed(x.where("a % 2 = 0"), path, "seq_id", "a", "b", name=F.concat(F.lit("n"), c("a").cast("string")), closed=True)
    W.bed(x.where("a % 2 = 1"), path, "seq_id", "a", "b", closed=True, mode="append")
    return R.bed(spark, path).select("chrom", "start", "end", "name")


def bedgraph_scan(spark, d):
    v = _calls(spark, d).where("qual is not null")
    lines = v.select(_line(c("chrom"), c("c_start"), c("c_end"), F.when(c("c_end") % 9 == 0, "nan").when(c("c_end") % 9 == 1, "inf").otherwise(c("qual").cast("string"))))
    df = R.interval_values(spark, _put(lines.unionByName(spark.createDataFrame([("track type=bedGraph",)], "value string")), "bg"))
    return df.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("end").alias("last"))


def peak_scan(spark, d):
    v = _calls(spark, d).where("qual is not null")
    line = _line(c("chrom"), c("c_start"), c("c_end"), c("id"), 0, ".", c("qual") / 10, 1, c("qual") / 4)
    return R.broad_peak(spark, _put(v.select(line), "peak")).select("name", "start", "end", "signal")


_SEQ = "[ACGTN]{60,}"


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"({_SEQ})"), F.lit(1))).alias("pos", "seq")).select(F.concat_ws("_", F.lit("s"), "doc_id", "pos").alias("name"), "seq")


def fasta_scan(spark, d):
    """Sequences in lines of 60, with a class in the header; ids, classes, lengths and bases."""
    s = _sequences(spark, d).withColumn("head", F.concat("name", F.lit("#LTR/Copia some text")))
    path = _path(spark, "fa")
    W.text(W.fasta_lines(s.withColumn("seq", F.lower("seq")), "head", "seq"), path)
    df = R.fasta(spark, path, by_class=True)
    return R.fasta_lengths(df).join(df, "id").select("id", "cls", "length", F.md5("sequence").alias("digest"))


def maf_scan(spark, d):
    """Regions as alignment blocks of the nations in them; species and sizes per block's first one."""
    n = table(spark, d, "nation").select("n_regionkey", "n_nationkey", F.concat(F.lit("n"), "n_nationkey").alias("sp"))
    rows = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("s "), "sp", F.lit(".chr"), "n_regionkey", F.lit(" "), "n_nationkey", F.lit(" 4 + 1000 AC-T")))), "\n").alias("t"))
    df = R.maf(spark, _put(rows.select(F.concat(F.lit("a score=1\n"), "t", F.lit("\n")).alias("value")), "maf"))
    wide = R.maf_species_blocks(df, ["n0"], least=5).select("block")
    return df.join(wide, "block").select("species", "chrom", "start", "size", "src_size", "text")


def chain_scan(spark, d):
    """An order's lines as a chain: sizes and gaps become cumulative coordinates on both sides."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_quantity").cast("bigint").alias("q")).distinct()
    one = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "q"))).alias("z"))
    body = F.array_join(F.transform(c("z"), lambda x: F.concat_ws(" ", x["q"].cast("string"), F.lit("3"), x["l_linenumber"].cast("string"))), "\n")
    text = F.concat(F.lit("chain 900 t 100000 + 10 900 q 100000 "), F.when(c("l_orderkey") % 2 == 0, "+").otherwise("-"), F.lit(" 5 800 "), "l_orderkey", F.lit("\n"), body, F.lit("\n"))
    df = R.chain(spark, _put(one.select(text.alias("value")), "chain"))
    return df.groupBy("chain_id", "block_strand").agg(F.count(F.lit(1)).alias("n"), F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.min("q_start").alias("q_start"), F.max("q_end").alias("q_end"))


def axt_scan(spark, d):
    v = _calls(spark, d)
    text = F.concat(F.concat_ws(" ", F.lit("0"), "chrom", c("c_start") + 1, "c_end", "id", c("c_start") + 1, "c_end", F.lit("-"), F.lit("500")), F.lit("\nACGT\nACGT\n"))
    return R.axt(spark, _put(v.select(text.alias("value")), "axt")).select("t_name", "t_start", "t_end", "q_name", "block_strand", "score")


def blast_scan(spark, d):
    """Calls as hits; INV on the minus strand."""
    v = _calls(spark, d).where("qual is not null")
    a, b = c("c_start") + 1, c("c_end")
    inv = F.coalesce(c("type") == "INV", F.lit(False))
    line = _line(c("id"), c("chrom"), 99.5, c("c_end") - c("c_start"), 1, 0, 1, 100, F.when(inv, b).otherwise(a), F.when(inv, a).otherwise(b), "1e-9", c("qual") * 4)
    return R.blast6(spark, _put(v.select(line), "b6"), 80, 1e-5, 60.0).select("query", "s_start", "s_end", "s_strand", "bits")


def trf_scan(spark, d):
    x = _exon_rows(spark, d).select("seq_id", "a", "b").distinct()
    rows = x.groupBy("seq_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(c("a").cast("string"), F.lit(" "), c("b").cast("string"), F.lit(" 20 3.5 20 95 0 100 25 25 25 25 2.0 ACGT ACGTACGT")))), "\n").alias("t"))
    df = R.trf_dat(spark, _put(rows.select(F.concat(F.lit("Sequence: "), "seq_id", F.lit(" x\n\nParameters: 2\n"), "t", F.lit("\n")).alias("value")), "trf"))
    return df.select("chrom", "start", "end", "period", "copies", "identity", "consensus")


def cls_scan(spark, d):
    """Domain-based classes: of an id given twice the first row counts."""
    n = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    lines = n.select("p_partkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"), "p_brand", "p_type").orderBy("p_partkey", "i")
    df = R.tesorter_cls(spark, _put(lines.select(_line(F.concat(F.lit("e"), "p_partkey", F.lit("#LTR")), "LTR", F.when(c("i") == 0, c("p_brand")).otherwise("later"), c("p_type"), "yes", "+", "GAG")), "cls", one=True))
    return df.select("id", c("superfamily"), "clade")


def pass_list_scan(spark, d):
    v = _calls(spark, d).where("type is not null")
    text = F.concat_ws("\t", F.concat("chrom", F.lit(":"), c("c_start") + 1, F.lit(".."), "c_end"), F.lit("pass"), F.lit("motif:TGCA"), F.lit("TSD:x"), F.lit("1..2"), F.lit("IN:3"), F.lit("y"), (1 - (c("c_end") % 20) / 100).cast("string"), F.lit("+"), F.lit("Copia"), F.lit("LTR"), F.when(c("c_end") % 2 == 0, F.lit("1234")).otherwise("NA"))
    df = R.pass_list(spark, _put(v.select(text.alias("value")), "pass"))
    return df.select("chrom", "start", "end", "category", "te_type", F.round("insertion_time", 3).alias("insertion_time"))


def gene_order_scan(spark, d):
    """Genes with their ordinal, and segments of five fields."""
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("ord"))
    g = R.gene_order(spark, _put(p.select(_line(c("p_brand"), F.concat(F.lit("g"), "p_partkey"), c("p_partkey"), c("p_partkey") + 9, "+", c("ord"), "o")), "order"))
    s = R.segments(spark, _put(p.groupBy("p_brand").agg(F.min("ord").alias("a"), F.max("ord").alias("b")).select(_line(c("p_brand"), c("a"), c("b"), "red", 1)), "seg"))
    return g.join(s.select("chrom", c("end").alias("last"), "colour"), "chrom").groupBy("chrom", "colour", "last").agg(F.max("ord").alias("top"), F.sum("start").alias("total"))


def cytosine_scan(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    line = _line(F.concat(F.lit("c"), c("user_id") % 7), c("event_id"), "+", c("event_id") % 3, c("event_id") % 2, F.when(c("event_id") % 5 == 0, "CHG").when(c("event_id") % 5 == 1, "XX").otherwise("CG"), "CGA")
    return R.cx_report(spark, _put(e.select(line), "cx")).groupBy("chrom", "context").agg(F.sum("meth").alias("meth"), F.sum("unmeth").alias("unmeth"), F.count(F.lit(1)).alias("n"))


def histogram_scan(spark, d):
    h = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("depth")).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))
    return R.kmer_histogram(spark, _put(h.select(_line(c("depth"), c("n"), sep=" ")).unionByName(spark.createDataFrame([("x y",)], "value string")), "histo")).select("depth", "count")


def contig_scan(spark, d):
    """Contigs with their length and rank in file order, joined to the calls on them."""
    g = table(spark, d, "gap_bed").groupBy("chrom").agg(F.max("end").alias("n")).orderBy("n", "chrom")
    return R.contig_sizes(spark, _put(g.select(_line(c("chrom"), c("n"), 0)), "fai", one=True))


def family_scan(spark, d):
    """A wide count matrix and a wide matrix of gene lists, read long and joined."""
    p = table(spark, d, "part").select("p_brand", (c("p_size") % 4).cast("string").alias("sp"), "p_partkey")
    counts, lists = _path(spark, "counts"), _path(spark, "genes")
    wide = p.groupBy(c("p_brand").alias("Orthogroup")).pivot("sp", ["0", "1", "2", "3"])
    W.tsv(wide.agg(F.count(F.lit(1))).na.fill(0).withColumn("Total", F.lit(9)), counts)
    W.tsv(wide.agg(F.concat_ws(", ", F.sort_array(F.collect_list(F.concat(F.lit("sp|g"), c("p_partkey").cast("string")))))), lists)
    genes = R.family_genes(spark, lists).groupBy("family", "species").agg(F.count(F.lit(1)).alias("listed"), F.min("gene").alias("first"))
    return R.family_matrix(spark, counts).join(genes, ["family", "species"], "left")


def sections_scan(spark, d):
    n = table(spark, d, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name")
    text = n.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat_ws("\t", x["n_nationkey"].cast("string"), x["n_name"])), "\n").alias("t"))
    path = _put(text.select(F.concat("t", F.lit("\n\nsecond\tpart\n")).alias("value")), "stats", one=True)
    return R.first_section(spark, path).select(c("line").cast("bigint").alias("line"), c("cells")[1].alias("name"))


def quant_scan(spark, d):
    """Per-sample quantifications with a manifest, summed by gene."""
    base = _path(spark, "quant")
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    for i in range(3):
        W.tsv(p.where(c("p_partkey") % 3 == i).select(c("p_partkey").alias("Name"), F.lit(5).alias("Length"), F.when(c("p_size") > 5, c("p_retailprice").cast("string")).otherwise("x").alias("TPM")), f"{base}/s{i}")
    manifest = spark.createDataFrame([("s0", "ctl"), ("s1", "trt")], "sample_id string, group string")
    tx = p.where("p_size % 2 = 0").select(c("p_partkey").cast("string").alias("tx_id"), F.concat(F.lit("gene"), c("p_size")).alias("gene_id"))
    q = R.quant(spark, f"{base}/*", manifest)
    sums = R.gene_sums(q.where("group is not null"), tx)
    return sums.select("gene_id", "sample_id", F.round("tpm", 4).alias("tpm"))


def busco_scan(spark, d):
    """Summaries of species as JSON files, one of them broken; a state table with repeated ids."""
    base = _path(spark, "busco")
    n = table(spark, d, "region").select("r_regionkey", "r_name")
    for i in range(5):
        body = F.to_json(F.struct(F.struct(F.lit("prot").alias("mode")).alias("parameters"), F.struct(c("r_name").alias("name")).alias("lineage_dataset"), F.struct((c("r_regionkey") + 90.5).alias("Complete"), (c("r_regionkey") * 10).cast("bigint").alias("n_markers")).alias("results")))
        W.text(n.where(c("r_regionkey") == i).select(F.when(c("r_regionkey") == 3, "{bad").otherwise(body).alias("value")).coalesce(1), f"{base}/sp{i}")
    return R.busco_json(spark, f"{base}/sp*/part*", "prot").select("species", "mode", "lineage", "complete", "markers")


def busco_states(spark, d):
    p = table(spark, d, "part").select("p_partkey", (c("p_size") % 3).alias("m")).orderBy("p_partkey")
    rows = p.select("p_partkey", F.explode(F.array(F.element_at(F.array(F.lit("Complete"), F.lit("Duplicated"), F.lit("Missing")), c("m") + 1), F.lit("Fragmented"))).alias("s"))
    return R.busco_table(spark, _put(rows.select(_line(c("p_partkey"), c("s"), 1, 2)), "table", one=True))


def significant_changes(spark, d):
    """Change and probability tables with a column per branch; families that change significantly."""
    p = table(spark, d, "part").select(c("p_partkey").alias("FamilyID"), (c("p_size") - 25).alias("br<1>"), F.when(c("p_size") % 7 == 0, "N/A").otherwise(((c("p_partkey") % 20) / 100).cast("string")).alias("pv"))
    a, b = _path(spark, "change"), _path(spark, "prob")
    W.tsv(p.select("FamilyID", "br<1>"), a)
    W.tsv(p.select("FamilyID", c("pv").alias("br<1>")), b)
    change, prob = R.csv_rows(spark, a), R.csv_rows(spark, b)
    branch = R.marked_columns(change, "BR<1")[0]
    return R.significant(change, prob, "FamilyID", branch).groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.sum("change").alias("total"))


def assembly_events(spark, d):
    """Variants of assemblies in four layouts, with repeated rows."""
    v = _calls(spark, d).where("type in ('DEL', 'CNV', 'INV', 'TRA')")
    v = v.select("chrom", "type", "c_start", "c_end").distinct()
    twice = lambda t, *cells: _put(v.where(c("type") == t).select(F.explode(F.array(F.lit(0), F.lit(1))), "*").select(_line(*cells)), t)
    paths = {"combined": twice("DEL", c("chrom"), c("c_start"), c("c_end"), F.lower("type"), c("c_end") - c("c_start")), "cnv": twice("CNV", c("chrom"), c("c_start"), c("c_end"), 77), "inv": twice("INV", c("chrom"), c("c_end"), c("c_start")), "trl": twice("TRA", c("chrom"), c("c_start"), c("c_end"))}
    # every layout's repeated rows count once per file
    return R.assembly_events(spark, paths).groupBy("layout", "type", "chrom", "start", "end").agg(F.max("len").alias("len"))


def flat_scan(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    text = F.concat(F.lit("ID   x\nAC   P"), "p_partkey", F.lit(";\nDR   GO; GO:"), "p_size", F.lit("; a\nDR   GO; GO:"), c("p_size") + 1, F.lit("; b\n//"))
    df = R.flat_records(spark, _put(p.select(text.alias("value")), "flat"), {"go": r"GO; (GO:\d+)"})
    return df.select("accession", F.array_join("go", ",").alias("go"))


def depth_scan(spark, d):
    """Depths of flank windows from a table, and the gate on them."""
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    line = _line("c", c("event_id"), c("event_id") + 9, F.concat(F.lit("v"), "user_id", F.when(c("event_id") % 2 == 0, "|left").otherwise("|right")), c("value"))
    df = R.region_depth(spark, _put(e.select(line), "depth"))
    g = G.flank_depth_gate(df.where("tag = 'left'"), "name", "depth", 1.0, 40.0)
    return g.select("name", "windows", "reason", F.round("min_depth", 6).alias("min_depth"))


def annotation_scan(spark, d):
    """Terms of a multi-valued annotation column, found by the header's name."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    head = spark.createDataFrame([("## note",), ("#query\tx\tKO",)], "value string")
    rows = p.select(_line(F.concat(F.lit("q"), c("p_partkey")), "x", F.when(c("p_size") % 5 == 0, "-").otherwise(F.concat(F.lit("ko:"), c("p_size"), F.lit(",ko:"), c("p_size") + 1, F.lit(";ko:"), c("p_size")))))
    df = R.emapper(spark, _put(head.unionByName(rows), "emapper"), "KO")
    ids = R.first_column(spark, _put(p.where("p_size > 25").select(_line(F.concat(F.lit("q"), "p_partkey"), "z", sep=" ")), "ids"))
    return df.join(ids.select(c("id").alias("query")), "query", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def compartment_scan(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    line = _line(F.concat(F.lit("c"), c("user_id") % 4), c("event_id"), c("event_id") + 5, F.when(c("event_id") % 6 > 0, c("value") - 50))
    df = R.compartments(spark, _put(e.select(line), "ab"), ["c0", "c1"])
    return df.groupBy("chrom", F.when(c("e1") > 0, "A").otherwise("B").alias("side")).agg(F.count(F.lit(1)).alias("n"), F.sum(c("end") - c("start")).alias("bp"))


def repeat_out_scan(spark, d):
    v = _calls(spark, d)
    text = F.concat(F.lit("  100 1.5 0.0 0.0 "), F.concat_ws(" ", "chrom", c("c_start") + 1, "c_end", F.lit("(5)"), F.when(c("type") == "INV", "C").otherwise("+"), "id", F.lit("LTR/Copia 1 2 3 1")))
    names = table(spark, d, "chunks").where("chrom is not null").select(c("chrom").alias("a"), F.concat(F.lit("new_"), "chrom").alias("b")).distinct()
    head = spark.createDataFrame([("   SW perc",), ("score",)], "value string")
    df = R.repeatmasker_out(spark, _put(head.unionByName(v.select(text.alias("value"))), "out"), names)
    return df.select("seq", "start", "end", "strand", "repeat", "mapped")


def tandem_scan(spark, d):
    x = _exon_rows(spark, d).select("seq_id", "a", "b").distinct()
    path = _path(spark, "tandem")
    x.select(c("seq_id").alias("seq"), c("a").alias("start"), c("b").alias("end"), (c("b") - c("a")).alias("width")).write.option("header", True).csv(path)
    return R.tandem_summary(spark, path)


def anchor_scan(spark, d):
    """Blocks by their end genes, resolved to the span of each chromosome pair."""
    x = _exon_rows(spark, d).where("gene_id is not null").groupBy("gene_id").agg(F.min("seq_id").alias("chrom"), F.min("a").alias("start"), F.max("b").alias("end")).withColumnRenamed("gene_id", "gene")
    e = x.groupBy("chrom").agg(F.min("gene").alias("a1"), F.max("gene").alias("a2"))
    df = R.anchor_spans(spark, _put(e.select(_line(c("a1"), c("a2"), c("a2"), c("a1"), 10, "+")), "simple"), x, x)
    return df


def compressed_table(spark, d):
    """An ordered, compressed table with a header and marks for nulls, read by names."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(c("o_orderkey") % 3 > 0, c("o_orderstatus")).alias("status"), "o_totalprice")
    path = _path(spark, "tsv")
    W.tsv(W.render_null(o), path, ["status", "o_orderkey"], compression="gzip")
    df = R.csv_rows(spark, path)
    return df.select(S.missing_to_null(c("status")).alias("status"), S.safe_int(c("o_orderkey")).alias("o_orderkey"))


def checksum_manifest(spark, d):
    """Files and bytes of a written table, with whether the digests differ."""
    path = _put(table(spark, d, "nation").repartition(3, "n_nationkey").select(F.concat_ws("\t", "n_nationkey", "n_name").alias("value")), "sums")
    m = W.checksums(spark, f"{path}/part*")
    return m.agg(F.sum("bytes").alias("bytes"), (F.count(F.lit(1)) == F.count_distinct("sha256")).alias("all_differ"), F.min(F.length("sha256")).alias("digits"))


def kept_samples(spark, d):
    """Sample columns by prefix and without excluded ones, made long."""
    n = table(spark, d, "nation").groupBy(F.substring("n_name", 1, 1).alias("id")).pivot("n_regionkey", [0, 1, 2, 3, 4]).agg(F.count(F.lit(1))).na.fill(0)
    n = n.select("id", *(c(str(i)).alias(f"genome_{i}") for i in range(5)), F.lit(1).alias("other"))
    return P.to_long(n, ["id"], P.sample_columns(n, ["id"], ["genome_3"], "genome_"))


def coordinates(spark, d):
    """Exons flipped to plus, widened and clipped, after reversed ones were swapped."""
    g = table(spark, d, "gtf").where("seq_id is not null and strand is not null and type = 'exon'").select("seq_id", "strand", c("left").alias("s"), c("right").alias("e"), F.lit(100_000_000).cast("bigint").alias("n"))
    x = I.normalise(g, "s", "e").where("s is not null and e is not null").withColumn("s", c("s") - 1)
    x = I.expand(I.flip_to_plus(x, "s", "e", "strand", "n"), "s", "e", 500, c("n"))
    return x.groupBy("seq_id", "strand").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("a"), F.max("e").alias("b"), F.sum(c("e") - c("s")).alias("bp"))


def labels(spark, d):
    """Chromosome prefixes, sample labels, list cells, relative positions and stars, by rule."""
    e = table(spark, d, "events").select("event_id", "value")
    i = c("event_id")
    chrom = F.concat(F.element_at(F.array(F.lit("Ab."), F.lit("R1."), F.lit("")), (i % 3 + 1).cast("int")), F.lit("chr"), (i % 4).cast("string"))
    cell = F.concat(F.lit("old1, x,"), F.when(i % 2 == 0, "old1,drop").otherwise("y ,x"), F.lit(","))
    out = e.select(S.strip_prefix(chrom, ["Ab.", "R1."]).alias("chrom"), F.array_join(S.canonical_labels(cell, {"old1": "new"}, ["drop"]), "|").alias("labels"), F.array_join(S.list_cell(F.concat(F.lit("sp|g1.t1, sp|g"), (i % 3).cast("string"), F.lit(".t1,")), ",", r"[^|]*\|", r"\.t\d+"), "|").alias("genes"), S.relative_position(i * 100_000, F.lit(20_000_000), F.lit(30_000_000)).alias("place"), S.p_stars(c("value") / 1000).alias("stars"))
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("n"))


def inserted(spark, d):
    """Inserted bases of alleles made from the texts' sequences, and exons trimmed to a core."""
    s = _sequences(spark, d)
    alt = F.concat(F.lit("a"), F.substring("seq", 1, 40), F.lit("*-"))
    return s.select("name", S.insertion_sequence(F.lit("A"), alt).alias("ins"), S.insertion_sequence(F.lit("A"), F.substring("seq", 1, 20)).alias("short"))


def contig_coordinates(spark, d):
    """Exons in regions shifted to their contig, cut to a core, with a check of the known contigs."""
    x = _exons(spark, d).select("seq_id", "e_start", "e_end")
    offs = x.select("seq_id").distinct().select("seq_id", (F.length("seq_id") * 1000).cast("bigint").alias("off"), F.concat(F.lit("ctg_"), "seq_id").alias("contig"))
    x = C.region_to_contig(O.must_know(x, "seq_id", offs, "seq_id"), offs, "seq_id", "off", "e_start", "e_end")
    a, b = S.trim_core(c("e_start") + 1, c("e_end"), 30)
    return x.groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("a"), F.sum(b).alias("b"))


def projected_blocks(spark, d):
    """Chunks projected to targets by the calls over them, as blocks, ranked by length."""
    b = _calls(spark, d).where("type is not null").select(c("chrom").alias("q_name"), c("c_start").alias("q_start"), c("c_end").alias("q_end"), c("type").alias("t_name"), (c("c_start") + 7).alias("t_start"), (c("c_end") + 7).alias("t_end"))
    ch = table(spark, d, "chunks").where("chrom is not null and start < end and chunk_id is not null").groupBy("chunk_id").agg(F.min("chrom").alias("chrom"), F.min("start").alias("start"), F.max("end").alias("end")).withColumnRenamed("chunk_id", "name")
    return K.project_blocks(b, ch, 1000).select("r_name", "t_name", "bp", "t_start", "t_end", c("rank").cast("int").alias("rank"))


def breakpoint_flanks(spark, d):
    """For every chunk the last DEL before its middle and the first DUP after it."""
    b = _calls(spark, d).where("type in ('DEL', 'DUP')").select("chrom", c("c_start").alias("start"), c("c_end").alias("end"), c("type").alias("ancestry"))
    w = table(spark, d, "chunks").where("chrom is not null and start < end and chunk_id is not null").groupBy("chunk_id").agg(F.min("chrom").alias("chrom"), F.min("start").alias("win_start"), F.max("end").alias("win_end")).select("*", F.lit("DEL").alias("l"), F.lit("DUP").alias("r"))
    return K.breakpoint_flanks(b, w, "chunk_id", "l", "r")


def batch_functions(spark, d):
    """A caller's function per group and a table function per batch."""
    n = table(spark, d, "nation").select("n_regionkey", "n_nationkey")
    per = M.apply_groups(n, ["n_regionkey"], lambda p: p.groupby("n_regionkey", as_index=False).agg(total=("n_nationkey", "sum")), "n_regionkey long, total long")

    def twice(part):
        yield part
        yield part.assign(total=-part["total"])

    return M.apply_batches(per, twice, "n_regionkey long, total long")


def record_stream(spark, d):
    """The events read as a stream of files, counted per type as they pass; a run ends with its input."""
    path, out, mark = _path(spark, "stream"), _path(spark, "counts"), _path(spark, "mark")
    ev = table(spark, d, "events").select("event_id", "event_type", "user_id")
    ev.write.parquet(path)
    stream = SW.read_files(spark, path, ev.schema, per_trigger=100)
    q = SW.to_parquet(stream.where("event_id % 2 = 0").select("event_type", "user_id"), out, mark)
    q.awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


QUERIES = {
    f.__name__: f
    for f in (
        vcf_scan, paf_scan, gff_scan, gtf_scan, bed_scan, bedgraph_scan, peak_scan, fasta_scan, maf_scan, chain_scan, axt_scan, blast_scan, trf_scan, cls_scan, pass_list_scan, gene_order_scan, cytosine_scan, histogram_scan, contig_scan, family_scan, sections_scan, quant_scan,
        busco_scan, busco_states, significant_changes, assembly_events, flat_scan, depth_scan, annotation_scan, compartment_scan, repeat_out_scan, tandem_scan, anchor_scan, compressed_table, checksum_manifest, kept_samples, coordinates, labels, inserted, contig_coordinates,
        projected_blocks, breakpoint_flanks, batch_functions, record_stream,
    )
}

_CH = 'ch AS (SELECT chunk_id, min(chrom) AS chrom, min("start") AS ws, max("end") AS we FROM chunks WHERE chrom IS NOT NULL AND "start" < "end" AND chunk_id IS NOT NULL GROUP BY chunk_id)'
_S = f"s AS (SELECT 's_' || doc_id || '_' || unnest(range(0, len(l))) AS name, unnest(l) AS seq FROM (SELECT doc_id, regexp_extract_all(text, '{_SEQ}') AS l FROM documents WHERE text IS NOT NULL))"

SQL = {
    "vcf_scan": f"""WITH {CALLS} SELECT chrom, c_start + 1 AS pos, c_end AS "end", 'n_' || id AS id, type AS svtype, greatest(c_end - c_start, 1) AS len, qual, CASE WHEN type = 'TRA' THEN 'chrZ' END AS mate_chrom, CASE WHEN type = 'TRA' THEN c_end END AS mate_pos, 't' AS src, coalesce(sample, '.') AS sample FROM calls WHERE type IS NOT NULL""",
    "paf_scan": f"""WITH {CALLS}, f AS (SELECT * FROM calls WHERE type IS NOT NULL AND qual IS NOT NULL AND floor(qual) >= 15 AND c_end - c_start >= 100 AND c_end % 30 <= 20 AND type <> 'DUP')
      SELECT chrom || '_' || row_number() OVER (PARTITION BY chrom ORDER BY c_start, c_end, 't_' || id, c_start + 5) AS block_id, c_start AS q_start, c_end AS q_end, 't_' || id AS t_name, c_start + 5 AS t_start, CASE WHEN type = 'INV' THEN '-' ELSE '+' END AS block_strand, c_end - c_start AS score FROM f""",
    "gff_scan": f"WITH {_EXONS} SELECT seq_id, gene_id AS gene, 'a ' || strand AS label, count(*) AS n, min(a) AS a, max(b) AS b, count(score) AS scored, count(phase) AS phased FROM x WHERE gene_id IS NOT NULL GROUP BY ALL",
    "gtf_scan": f"WITH {_EXONS} SELECT gene_id, transcript_id, count(*) AS n, CAST(sum(b - a + 1) AS BIGINT) AS bp FROM x GROUP BY ALL",
    "bed_scan": f"WITH {_EXONS} SELECT DISTINCT seq_id AS chrom, a - 1 AS start, b AS \"end\", CASE WHEN a % 2 = 0 THEN 'n' || a ELSE seq_id || ':' || (a - 1) || '-' || b END AS name FROM x",
    "bedgraph_scan": f"WITH {CALLS} SELECT chrom, count(*) AS n, round(sum(qual), 4) AS total, max(c_end) AS last FROM calls WHERE qual IS NOT NULL AND c_end % 9 > 1 GROUP BY chrom",
    "peak_scan": f"WITH {CALLS} SELECT id AS name, c_start AS start, c_end AS \"end\", qual / 10 AS signal FROM calls WHERE qual / 10 >= 2 AND qual / 4 >= 5",
    "fasta_scan": f"WITH {_S} SELECT name AS id, 'LTR/Copia' AS cls, length(seq) AS length, md5(seq) AS digest FROM s",
    "maf_scan": "SELECT 'n' || n_nationkey AS species, 'chr' || n_regionkey AS chrom, CAST(n_nationkey AS BIGINT) AS start, 4::BIGINT AS size, 1000::BIGINT AS src_size, 'AC-T' AS text FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey <> 0 GROUP BY 1 HAVING count(*) >= 5)",
    "chain_scan": """WITH li AS (SELECT DISTINCT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS BIGINT) AS q FROM lineitem), b AS (SELECT *, coalesce(sum(q + 3) OVER w, 0) AS dt, coalesce(sum(q + l_linenumber) OVER w, 0) AS dq FROM li WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      p AS (SELECT CAST(l_orderkey AS VARCHAR) AS chain_id, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS block_strand, 10 + dt AS ts, 10 + dt + q AS te, 5 + dq AS x, 5 + dq + q AS y FROM b)
      SELECT chain_id, block_strand, count(*) AS n, CAST(min(ts) AS BIGINT) AS t_start, CAST(max(te) AS BIGINT) AS t_end, CAST(min(CASE WHEN block_strand = '+' THEN x ELSE 100000 - y END) AS BIGINT) AS q_start, CAST(max(CASE WHEN block_strand = '+' THEN y ELSE 100000 - x END) AS BIGINT) AS q_end FROM p GROUP BY ALL""",
    "axt_scan": f"WITH {CALLS} SELECT chrom AS t_name, c_start AS t_start, c_end AS t_end, id AS q_name, '-' AS block_strand, 500::BIGINT AS score FROM calls",
    "blast_scan": f"WITH {CALLS} SELECT id AS query, c_start AS s_start, c_end AS s_end, CASE WHEN type = 'INV' AND c_end > c_start + 1 THEN '-' ELSE '+' END AS s_strand, qual * 4 AS bits FROM calls WHERE qual * 4 >= 60 AND c_end - c_start >= 80",
    "trf_scan": f"WITH {_EXONS} SELECT DISTINCT seq_id AS chrom, a - 1 AS start, b AS \"end\", 20 AS period, 3.5::DOUBLE AS copies, 95::DOUBLE AS identity, 'ACGT' AS consensus FROM x",
    "cls_scan": "SELECT 'e' || p_partkey AS id, p_brand AS superfamily, p_type AS clade FROM part",
    "pass_list_scan": f"WITH {CALLS} SELECT chrom, c_start AS start, c_end AS \"end\", 'pass' AS category, 'LTR' AS te_type, round(CASE WHEN c_end % 2 = 0 THEN 1234 ELSE (1 - (1 - (c_end % 20) / 100)) / 2.6e-8 END, 3) AS insertion_time FROM calls WHERE type IS NOT NULL",
    "gene_order_scan": "WITH o AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS ord FROM part) SELECT p_brand AS chrom, 'red' AS colour, max(ord) AS last, max(ord) AS top, CAST(sum(p_partkey) AS BIGINT) AS total FROM o GROUP BY p_brand",
    "cytosine_scan": "WITH e AS (SELECT 'c' || user_id % 7 AS chrom, event_id % 3 AS m, event_id % 2 AS u, CASE event_id % 5 WHEN 0 THEN 'CHG' WHEN 1 THEN 'XX' ELSE 'CG' END AS context FROM events) SELECT chrom, context, CAST(sum(m) AS BIGINT) AS meth, CAST(sum(u) AS BIGINT) AS unmeth, count(*) AS n FROM e WHERE context <> 'XX' AND m + u >= 1 GROUP BY ALL",
    "histogram_scan": "SELECT depth, count(*) AS count FROM (SELECT o_custkey, count(*) AS depth FROM orders GROUP BY 1) GROUP BY depth",
    "contig_scan": 'SELECT chrom AS contig, max("end") AS length, CAST(row_number() OVER (ORDER BY max("end"), chrom) AS INTEGER) AS rank FROM gap_bed GROUP BY chrom',
    "family_scan": "WITH g AS (SELECT DISTINCT p_brand AS family FROM part), s AS (SELECT unnest(['0', '1', '2', '3']) AS species), p AS (SELECT p_brand AS family, CAST(p_size % 4 AS VARCHAR) AS species, count(*) AS n, min('g' || p_partkey) AS first FROM part GROUP BY ALL) SELECT family, species, coalesce(n, 0) AS n, n AS listed, first FROM g CROSS JOIN s LEFT JOIN p USING (family, species)",
    "sections_scan": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS line, n_name AS name FROM nation",
    "quant_scan": "SELECT CASE WHEN p_size % 2 = 0 THEN 'gene' || p_size ELSE CAST(p_partkey AS VARCHAR) END AS gene_id, 's' || p_partkey % 3 AS sample_id, round(sum(CASE WHEN p_size > 5 THEN p_retailprice END), 4) AS tpm FROM part WHERE p_partkey % 3 < 2 GROUP BY ALL",
    "busco_scan": "SELECT 'sp' || r_regionkey AS species, 'prot' AS mode, r_name AS lineage, CAST(r_regionkey + 90.5 AS DOUBLE) AS complete, CAST(r_regionkey * 10 AS BIGINT) AS markers FROM region WHERE r_regionkey <> 3",
    "busco_states": "SELECT CASE p_size % 3 WHEN 0 THEN 'Complete' WHEN 1 THEN 'Duplicated' ELSE 'Missing' END AS state, count(*) AS n FROM part GROUP BY 1",
    "significant_changes": "SELECT CASE WHEN p_size > 25 THEN 'expansion' ELSE 'contraction' END AS direction, count(*) AS n, CAST(sum(p_size - 25) AS DOUBLE) AS total FROM part WHERE p_size <> 25 AND p_size % 7 <> 0 AND p_partkey % 20 < 5 GROUP BY 1",
    "assembly_events": f"""WITH {CALLS}, v AS (SELECT DISTINCT chrom, type, c_start, c_end FROM calls WHERE type IN ('DEL', 'CNV', 'INV', 'TRA')) SELECT CASE type WHEN 'DEL' THEN 'combined' WHEN 'CNV' THEN 'cnv' WHEN 'INV' THEN 'inv' ELSE 'trl' END AS layout, type, chrom, c_start AS start, c_end AS "end", CASE WHEN type = 'CNV' THEN 77 ELSE c_end - c_start END AS len FROM v WHERE type <> 'DEL' OR c_end - c_start >= 50""",
    "flat_scan": "SELECT 'P' || p_partkey AS accession, 'GO:' || p_size || ',GO:' || (p_size + 1) AS go FROM part",
    "depth_scan": "SELECT 'v' || user_id AS name, count(value) AS windows, CASE WHEN count(value) = 0 THEN 'no_depth' WHEN min(value) < 1 THEN 'low_min' WHEN avg(value) < 40 THEN 'low_mean' ELSE 'pass' END AS reason, round(min(value), 6) AS min_depth FROM events WHERE event_id % 2 = 0 GROUP BY user_id",
    "annotation_scan": "WITH t AS (SELECT p_partkey, unnest([p_size, p_size + 1]) AS t FROM part WHERE p_size % 5 <> 0 AND p_size > 25) SELECT 'ko:' || t AS term, count(*) AS n FROM t GROUP BY t",
    "compartment_scan": "SELECT 'c' || user_id % 4 AS chrom, CASE WHEN value - 50 > 0 THEN 'A' ELSE 'B' END AS side, count(*) AS n, CAST(5 * count(*) AS BIGINT) AS bp FROM events WHERE event_id % 6 > 0 AND user_id % 4 < 2 AND value IS NOT NULL GROUP BY ALL",
    "repeat_out_scan": f"WITH {CALLS}, k AS (SELECT DISTINCT chrom FROM chunks WHERE chrom IS NOT NULL) SELECT CASE WHEN k.chrom IS NOT NULL THEN 'new_' ELSE '' END || calls.chrom AS seq, c_start AS start, c_end AS \"end\", CASE WHEN type = 'INV' THEN '-' ELSE '+' END AS strand, id AS repeat, k.chrom IS NOT NULL AS mapped FROM calls LEFT JOIN k ON k.chrom = calls.chrom",
    "tandem_scan": f"WITH {_EXONS} SELECT DISTINCT seq_id AS chrom, a - 1 AS start, b AS \"end\", 'rep_' || (b - a) AS name FROM x",
    "anchor_scan": f"""WITH {_EXONS}, g AS (SELECT gene_id, min(seq_id) AS chrom, min(a) AS s, max(b) AS e FROM x WHERE gene_id IS NOT NULL GROUP BY 1), m AS (SELECT chrom, min(gene_id) AS a1, max(gene_id) AS a2 FROM g GROUP BY 1), p AS (SELECT chrom, a1 AS a, a2 AS b FROM m UNION ALL SELECT chrom, a2, a1 FROM m)
      SELECT ga.chrom AS a_chrom, gb.chrom AS b_chrom, min(ga.s) AS a_start, max(ga.e) AS a_end, min(gb.s) AS b_start, max(gb.e) AS b_end, count(DISTINCT p.chrom) AS blocks FROM p JOIN g ga ON ga.gene_id = p.a JOIN g gb ON gb.gene_id = p.b GROUP BY 1, 2""",
    "compressed_table": "SELECT CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS status, o_orderkey FROM orders",
    "checksum_manifest": "SELECT CAST(sum(length(CAST(n_nationkey AS VARCHAR)) + length(n_name) + 2) AS BIGINT) AS bytes, true AS all_differ, 64 AS digits FROM nation",
    "kept_samples": "WITH i AS (SELECT DISTINCT n_name[1:1] AS id FROM nation), s AS (SELECT unnest([0, 1, 2, 4]) AS r) SELECT id, 'genome_' || r AS sample, count(n_name) AS state FROM i CROSS JOIN s LEFT JOIN nation ON n_name[1:1] = id AND n_regionkey = r GROUP BY ALL",
    "coordinates": """WITH g AS (SELECT seq_id, strand, least("left", "right") - 1 AS s, greatest("left", "right") AS e FROM gtf WHERE type = 'exon' AND seq_id IS NOT NULL AND strand IS NOT NULL AND "left" IS NOT NULL AND "right" IS NOT NULL), f AS (SELECT seq_id, strand, CASE WHEN strand = '-' THEN 100000000 - e ELSE s END AS s, CASE WHEN strand = '-' THEN 100000000 - s ELSE e END AS e FROM g),
      x AS (SELECT seq_id, strand, greatest(s - 500, 0) AS s, least(e + 500, 100000000) AS e FROM f) SELECT seq_id, strand, count(*) AS n, min(s) AS a, max(e) AS b, CAST(sum(e - s) AS BIGINT) AS bp FROM x WHERE s < e GROUP BY ALL""",
    "labels": """WITH e AS (SELECT event_id AS i, value / 1000 AS p, event_id * 100000 AS pos FROM events) SELECT 'chr' || i % 4 AS chrom, CASE WHEN i % 2 = 0 THEN 'new|x' ELSE 'new|x|y' END AS labels, 'g1|g' || i % 3 AS genes,
      CASE WHEN pos < 20000000 THEN 'left ' || format('{:.2f}', (20000000 - pos) / 1000000) || ' Mb' WHEN pos > 30000000 THEN 'right ' || format('{:.2f}', (pos - 30000000) / 1000000) || ' Mb' ELSE 'within' END AS place, CASE WHEN p IS NULL THEN 'NA' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars, count(*) AS n FROM e GROUP BY ALL""",
    "inserted": f"WITH {_S} SELECT name, seq[1:40] AS ins, CAST(NULL AS VARCHAR) AS short FROM s",
    "contig_coordinates": EX + """, e AS (SELECT 'ctg_' || seq_id AS contig, e_start + 1 + length(seq_id) * 1000 AS s, e_end + length(seq_id) * 1000 AS e FROM ex), t AS (SELECT *, e - s + 1 < 63 AS short, s + CAST(floor((e - s + 1 - 3) / 2) AS BIGINT) AS mid FROM e)
      SELECT contig, count(*) AS n, CAST(sum(CASE WHEN short THEN mid ELSE s + 30 END) AS BIGINT) AS a, CAST(sum(CASE WHEN short THEN mid + 2 ELSE e - 30 END) AS BIGINT) AS b FROM t GROUP BY contig""",
    "projected_blocks": f"""WITH {CALLS}, {_CH}, g AS (SELECT chunk_id AS r_name, type AS t_name, CAST(sum(c_end - c_start) AS BIGINT) AS bp, min(c_start + 7) AS t_start, max(c_end + 7) AS t_end FROM ch JOIN calls ON calls.chrom = ch.chrom AND type IS NOT NULL AND c_start < we + 1000 AND greatest(ws - 1000, 0) < c_end GROUP BY ALL)
      SELECT *, CAST(row_number() OVER (PARTITION BY r_name ORDER BY bp DESC, t_name) AS INTEGER) AS rank FROM g""",
    "breakpoint_flanks": f"""WITH {CALLS}, {_CH}, f AS (SELECT chunk_id, max(c_end) FILTER (type = 'DEL' AND c_end <= (ws + we) / 2) AS left_end, min(c_start) FILTER (type = 'DUP' AND c_start >= (ws + we) / 2) AS right_start FROM ch JOIN calls ON calls.chrom = ch.chrom AND type IN ('DEL', 'DUP') GROUP BY chunk_id)
      SELECT *, CASE WHEN right_start - left_end IS NULL THEN 'open' WHEN right_start - left_end <= 10000 THEN 'narrow' WHEN right_start - left_end <= 100000 THEN 'medium' ELSE 'wide' END AS width_class FROM f""",
    "batch_functions": "WITH t AS (SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation GROUP BY 1) SELECT * FROM t UNION ALL SELECT n_regionkey, -total FROM t",
    "record_stream": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_id % 2 = 0 GROUP BY 1",
}
