"""Readers for genomic and tabular text formats.

Every reader lands lines as text and parses them with column expressions, so that scans are split,
columns are pruned and nothing but the reader's own layout rules is evaluated. Unparsable numbers
become null through ``try_cast``; gzip files are read through the file extension.
"""

from __future__ import annotations

import configparser
import glob
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions.scalars import breakend, info_map, list_cell, parse_interval


def lines(spark: SparkSession, path: str, skip: str | None = "#") -> DataFrame:
    """Non-empty lines in ``value``, without carriage returns and comment lines."""
    df = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"))
    df = df.where(F.length(F.trim("value")) > 0)
    return df.where(~F.startswith("value", F.lit(skip))) if skip else df


def blocks(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Text between separators, in ``value``, with a running ``block`` per file position."""
    df = spark.read.option("lineSep", sep).text(path).where(F.length(F.trim("value")) > 0)
    return df.withColumn("block", F.monotonically_increasing_id())


def _cut(df: DataFrame, names: list[str], types: dict[str, str] | None = None, sep: str = "\t", least: int | None = None) -> DataFrame:
    c = F.split("value", sep)
    df = df.withColumn("__c", c).where(F.size("__c") >= (least if least is not None else len(names)))
    types = types or {}
    cols = [(F.get("__c", F.lit(i)).try_cast(types[n]) if n in types else F.get("__c", F.lit(i))).alias(n) for i, n in enumerate(names)]
    return df.select(*cols, "__c")


def _float_int(c: Column) -> Column:
    return F.floor(c.try_cast("double")).cast("bigint")


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, id, ref, alt, qual, filt, info (map), svtype, end, len, format, samples (array).

    Rows without a readable POS are left out; reversed pos and end are swapped; len is at least 1,
    from SVLEN (the longest of a list) or else the span.
    """
    df = _cut(lines(spark, path), ["chrom", "pos", "id", "ref", "alt", "qual", "filt", "info"], {"pos": "bigint", "qual": "double"})
    df = df.where("pos is not null").withColumn("info", info_map(F.col("info")))
    lens = F.transform(F.split(F.coalesce(F.col("info")["SVLEN"], F.lit("")), ","), lambda x: F.abs(x.try_cast("double")))
    df = df.withColumns({"__e": F.coalesce(F.col("info")["END"].try_cast("bigint"), F.col("pos")), "__l": F.array_max(F.filter(lens, lambda x: x.isNotNull()))})
    mate_chr, mate_pos = breakend(F.col("alt"))
    return df.select(
        "chrom",
        F.least("pos", "__e").alias("pos"),
        "id",
        "ref",
        "alt",
        "qual",
        "filt",
        "info",
        F.upper(F.coalesce(F.col("info")["SVTYPE"], F.nullif(F.regexp_extract("alt", "^<([A-Za-z]+)", 1), F.lit("")))).alias("svtype"),
        F.greatest("pos", "__e").alias("end"),
        F.greatest(F.lit(1), F.coalesce(F.col("__l"), F.abs(F.col("__e") - F.col("pos")).cast("double"))).cast("bigint").alias("len"),
        F.coalesce(F.col("info")["CHR2"], mate_chr).alias("mate_chrom"),
        mate_pos.alias("mate_pos"),
        F.get("__c", F.lit(8)).alias("format"),
        F.slice("__c", 10, F.greatest(F.size("__c") - 9, F.lit(0))).alias("samples"),
    )


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """Sample names of the header line (one short line, read on the driver)."""
    head = spark.read.text(path).where(F.startswith("value", F.lit("#CHROM"))).limit(1).collect()
    return head[0][0].rstrip("\r").split("\t")[9:] if head else []


def paf(spark: SparkSession, path: str) -> DataFrame:
    """The 12 fixed columns and ``tags``, a map of tag to value."""
    n = ["q_name", "q_len", "q_start", "q_end", "strand", "t_name", "t_len", "t_start", "t_end", "matches", "block_len", "mapq"]
    df = _cut(lines(spark, path), n, {c: "bigint" for c in n if c not in ("q_name", "strand", "t_name")})
    tags = F.filter(F.slice("__c", 13, F.greatest(F.size("__c") - 12, F.lit(0))), lambda x: F.size(F.split(x, ":", 3)) == 3)
    return df.withColumn("tags", F.map_from_entries(F.transform(tags, lambda x: F.struct(F.split(x, ":", 3)[0], F.split(x, ":", 3)[2])))).drop("__c")


def alignment_filter(df: DataFrame, mapq: int = 20, block: int = 10_000, divergence: float = 0.12) -> DataFrame:
    """Primary alignments of enough quality and length; a missing divergence passes."""
    dv = F.coalesce(F.try_element_at("tags", F.lit("dv")), F.try_element_at("tags", F.lit("de"))).try_cast("double")
    tp = F.coalesce(F.try_element_at("tags", F.lit("tp")), F.lit("P"))
    return df.where((F.col("mapq") >= mapq) & (F.col("block_len") >= block) & (F.coalesce(dv, F.lit(0.0)) <= divergence) & (tp == "P"))


def sequence_blocks(df: DataFrame) -> DataFrame:
    """Alignment rows in the common block layout with a block id in coordinate order."""
    w = Window.partitionBy("q_name").orderBy("q_start", "q_end", "t_name", "t_start")
    return df.select("q_name", "q_start", "q_end", "t_name", "t_start", "t_end", F.col("strand").alias("block_strand"), F.col("matches").alias("score"), "q_len", "t_len", F.concat_ws("_", "q_name", F.row_number().over(w)).alias("block_id"))


def gff3(spark: SparkSession, path: str) -> DataFrame:
    """9 columns, coordinates 1-based closed; ``attributes`` is a map with decoded values."""
    n = ["seq_id", "source", "type", "start", "end", "score", "strand", "phase", "attr"]
    df = _cut(lines(spark, path), n, {"start": "bigint", "end": "bigint", "score": "double", "phase": "int"})
    parts = F.filter(F.split("attr", r"\s*;\s*"), lambda x: F.trim(x) != "")
    # a plus sign stands for itself in this format
    decode = lambda x: F.try_url_decode(F.regexp_replace(x, r"\+", "%2B"))
    pair = lambda x: F.struct(F.regexp_extract(F.trim(x), r"^([^=\s]+)", 1), decode(F.regexp_replace(F.regexp_extract(F.trim(x), r"^[^=\s]+[=\s]\s*(.*)$", 1), '^"|"$', "")))
    entries = F.transform(parts, pair)
    # of a key given twice the first counts
    firsts = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda y: y["col1"]), e["col1"]) == i + 1)
    return df.withColumn("attributes", F.map_from_entries(firsts)).drop("__c", "attr")


def gtf_attributes(attr: Column, names: list[str]) -> list[Column]:
    """Quoted attributes of a GTF cell by name; null where absent."""
    return [F.nullif(F.regexp_extract(attr, rf'(?:^|;)\s*{n}\s+"([^"]*)"', 1), F.lit("")).alias(n) for n in names]


def gtf(spark: SparkSession, path: str, names: tuple[str, ...] = ("gene_id", "transcript_id")) -> DataFrame:
    n = ["seq_id", "source", "type", "left", "right", "score", "strand", "phase", "attr"]
    df = _cut(lines(spark, path), n, {"left": "bigint", "right": "bigint", "score": "double", "phase": "int"})
    return df.select(*n[:-1], *gtf_attributes(F.col("attr"), list(names)))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, name (``chrom:start-end`` if missing), score, strand."""
    df = _cut(lines(spark, path).where(~F.col("value").rlike("^(track|browser)")), ["chrom", "s", "e"])
    s, e = _float_int(F.col("s")), _float_int(F.col("e"))
    return df.select("chrom", s.alias("start"), e.alias("end"), F.coalesce(F.get("__c", F.lit(3)), F.concat(F.col("chrom"), F.lit(":"), s.cast("string"), F.lit("-"), e.cast("string"))).alias("name"), F.get("__c", F.lit(4)).try_cast("double").alias("score"), F.get("__c", F.lit(5)).alias("strand"), "__c").where("start is not null and end is not null").drop("__c")


def broad_peak(spark: SparkSession, path: str, signal: float = 2.0, q: float = 5.0) -> DataFrame:
    """Peaks with enough signal and -log10 q."""
    df = _cut(lines(spark, path), ["chrom", "start", "end", "name", "score", "strand", "signal", "p", "q"], {"start": "bigint", "end": "bigint", "score": "double", "signal": "double", "p": "double", "q": "double"})
    return df.drop("__c").where((F.col("signal") >= signal) & (F.col("q") >= q))


def bedgraph(spark: SparkSession, path: str, chroms: list[str] | None = None) -> DataFrame:
    """chrom, start, end, value; non-finite values and chromosomes not listed are left out."""
    df = _cut(lines(spark, path).where(~F.col("value").rlike("^(track|browser)")), ["chrom", "start", "end", "value"], {"start": "bigint", "end": "bigint", "value": "double"}).drop("__c")
    df = df.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    return df.where(F.col("chrom").isin(chroms)) if chroms is not None else df


def fasta(spark: SparkSession, path: str, by_class: bool = False) -> DataFrame:
    """id (header up to the first blank), description, sequence (upper case); ``cls`` from ``id#cls``."""
    df = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    parts = F.split(F.regexp_replace("value", "\r", ""), "\n", 2)
    out = df.select(parts[0].alias("description"), F.upper(F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "")).alias("sequence"))
    out = out.select(F.split("description", r"\s")[0].alias("id"), "description", "sequence")
    return out.withColumns({"cls": F.get(F.split("id", "#", 2), F.lit(1)), "id": F.split("id", "#", 2)[0]}) if by_class else out


def fasta_lengths(df: DataFrame) -> DataFrame:
    return df.select("id", F.length("sequence").cast("bigint").alias("length"))


def maf(spark: SparkSession, path: str) -> DataFrame:
    """block, species, chrom, start, size, strand, src_size, text of every ``s`` line."""
    df = blocks(spark, path, "\n\n").select("block", F.explode(F.split("value", "\n")).alias("value")).where(F.col("value").rlike(r"^s\s"))
    c = F.split(F.trim("value"), r"\s+")
    src = F.split(c[1], r"\.", 2)
    return df.select("block", src[0].alias("species"), F.get(src, F.lit(1)).alias("chrom"), c[2].try_cast("bigint").alias("start"), c[3].try_cast("bigint").alias("size"), c[4].alias("strand"), c[5].try_cast("bigint").alias("src_size"), F.get(c, F.lit(6)).alias("text"))


def maf_species_blocks(df: DataFrame, ignore: list[str], least: int | None = None, exactly: int | None = None) -> DataFrame:
    """Blocks by their number of distinct species, ancestors in ``ignore`` not counted."""
    n = df.where(~F.col("species").isin(ignore)).groupBy("block").agg(F.count_distinct("species").alias("species"))
    return n.where(F.col("species") == exactly) if exactly is not None else n.where(F.col("species") >= (least or 1))


def chain(spark: SparkSession, path: str) -> DataFrame:
    """Ungapped blocks with cumulative coordinates; a '-' query is flipped to plus."""
    df = spark.read.option("lineSep", "chain ").text(path).where(F.length(F.trim("value")) > 0)
    ls = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    h = F.split(F.trim(F.get(ls, F.lit(0))), r"\s+")
    df = df.where(F.size(h) >= 11).select(
        h[0].cast("bigint").alias("score"), h[1].alias("t_name"), h[4].cast("bigint").alias("t0"), h[6].alias("q_name"), h[7].cast("bigint").alias("q_size"), h[8].alias("block_strand"), h[9].cast("bigint").alias("q0"), F.get(h, F.lit(11)).alias("chain_id"),
        F.posexplode(F.slice(ls, 2, F.greatest(F.size(ls) - 1, F.lit(0)))).alias("i", "line"),
    )
    c = F.split(F.trim("line"), r"\s+")
    df = df.select("*", c[0].try_cast("bigint").alias("size"), F.coalesce(F.get(c, F.lit(1)).try_cast("bigint"), F.lit(0)).alias("dt"), F.coalesce(F.get(c, F.lit(2)).try_cast("bigint"), F.lit(0)).alias("dq")).where("size is not null")
    w = Window.partitionBy("chain_id", "t_name", "t0", "q_name", "q0").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(F.col("size") + F.col(c)).over(w), F.lit(0))
    df = df.withColumns({"t_start": F.col("t0") + before("dt"), "__q": F.col("q0") + before("dq")})
    minus = F.col("block_strand") == "-"
    return df.select("chain_id", "score", "t_name", "t_start", (F.col("t_start") + F.col("size")).alias("t_end"), "q_name", F.when(minus, F.col("q_size") - F.col("__q") - F.col("size")).otherwise(F.col("__q")).alias("q_start"), F.when(minus, F.col("q_size") - F.col("__q")).otherwise(F.col("__q") + F.col("size")).alias("q_end"), "block_strand")


def axt(spark: SparkSession, path: str) -> DataFrame:
    """Header lines only: t_name, t_start, t_end, q_name, q_start, q_end, strand, score (half-open)."""
    df = lines(spark, path).where(F.col("value").rlike(r"^\d+\s+\S+\s+\d+"))
    c = F.split(F.trim("value"), r"\s+")
    return df.select(c[1].alias("t_name"), (c[2].cast("bigint") - 1).alias("t_start"), c[3].cast("bigint").alias("t_end"), c[4].alias("q_name"), (c[5].cast("bigint") - 1).alias("q_start"), c[6].cast("bigint").alias("q_end"), c[7].alias("block_strand"), c[8].try_cast("bigint").alias("score"))


def blast6(spark: SparkSession, path: str, length: int = 0, evalue: float | None = None, bits: float | None = None) -> DataFrame:
    """Hits with the subject interval normalised to half-open plus ``s_strand``; optional filters."""
    n = ["query", "subject", "pident", "length", "mismatch", "gaps", "q_start", "q_end", "ss", "se", "evalue", "bits"]
    df = _cut(lines(spark, path), n, {c: "double" if c in ("pident", "evalue", "bits") else "bigint" for c in n[2:]})
    df = df.where(F.col("length") >= length)
    df = df.where(F.col("evalue") <= evalue) if evalue is not None else df
    df = df.where(F.col("bits") >= bits) if bits is not None else df
    return df.select(*n[:8], (F.least("ss", "se") - 1).alias("s_start"), F.greatest("ss", "se").alias("s_end"), F.when(F.col("ss") <= F.col("se"), "+").otherwise("-").alias("s_strand"), "evalue", "bits")


def trf_dat(spark: SparkSession, path: str) -> DataFrame:
    """Repeat rows with the sequence named by the section they stand in."""
    df = spark.read.option("lineSep", "Sequence:").text(path)
    df = df.withColumn("__l", F.split("value", "\n")).select(F.split(F.trim(F.col("__l")[0]), r"\s+")[0].alias("chrom"), F.explode(F.slice("__l", 2, F.greatest(F.size("__l") - 1, F.lit(0)))).alias("line")).where(F.col("line").rlike(r"^\d+ \d+ "))
    c = F.split(F.trim("line"), " ")
    return df.where(F.size(c) >= 14).select("chrom", (c[0].cast("bigint") - 1).alias("start"), c[1].cast("bigint").alias("end"), c[2].try_cast("int").alias("period"), c[3].try_cast("double").alias("copies"), c[5].try_cast("double").alias("identity"), c[13].alias("consensus"))


def _first_per(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def tesorter_cls(spark: SparkSession, path: str) -> DataFrame:
    """Classification per element id (cut at '#'); the first row of an id counts."""
    n = ["id", "ord", "superfamily", "clade", "complete", "strand", "domains"]
    df = _cut(lines(spark, path).withColumn("__i", F.monotonically_increasing_id()).select("value", "__i").withColumn("value", F.concat_ws("\t", "value", F.lit(""), F.col("__i").cast("string"))), n).withColumn("__i", F.element_at("__c", -1).cast("bigint"))
    return _first_per(df.withColumn("id", F.split("id", "#")[0]), "id", "__i").drop("__c", "__i")


def pass_list(spark: SparkSession, path: str, rate: float = 1.3e-8) -> DataFrame:
    """LTR elements: chrom, start, end (half-open), category, identity, superfamily, te_type, insertion_time (imputed from identity)."""
    c = F.split(F.trim("value"), r"\s+")
    df = lines(spark, path).select(c.alias("c")).where(F.size("c") >= 11)
    chrom, a, b = parse_interval(F.col("c")[0])
    ident = F.col("c")[7].try_cast("double")
    time = F.get("c", F.lit(11)).try_cast("double")
    return df.select(chrom.alias("chrom"), (F.least(a, b) - 1).alias("start"), F.greatest(a, b).alias("end"), F.col("c")[1].alias("category"), ident.alias("identity"), F.col("c")[8].alias("strand"), F.col("c")[9].alias("superfamily"), F.col("c")[10].alias("te_type"), F.coalesce(time, (1 - ident) / (2 * rate)).alias("insertion_time"))


def csv_rows(spark: SparkSession, path: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """Named columns, all strings until cast."""
    return spark.read.option("sep", sep).option("header", header).csv(path)


def blockinfo(spark: SparkSession, path: str) -> DataFrame:
    """Collinear blocks with their packed cells as arrays."""
    from loomspan.operators.karyotype import packed_numbers

    df = csv_rows(spark, path, ",")
    return df.withColumns({c: packed_numbers(F.col(c)) for c in ("block1", "block2", "ks") if c in df.columns})


def gene_order(spark: SparkSession, path: str) -> DataFrame:
    """chrom, gene, start, end, strand, ord, original; a repeated (chrom, ord) fails at run time."""
    from loomspan.operators.relational import unique_or_fail

    n = ["chrom", "gene", "start", "end", "strand", "ord", "original"]
    return unique_or_fail(_cut(lines(spark, path), n, {"start": "bigint", "end": "bigint", "ord": "bigint"}).drop("__c"), ["chrom", "ord"])


def segments(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, colour, cls; a line without exactly five fields fails at run time."""
    df = lines(spark, path).withColumn("__c", F.split("value", "\t"))
    ok = F.assert_true(F.size("__c") == 5, F.concat(F.lit("bad segment line: "), F.col("value")))
    c = F.col("__c")
    return df.withColumn("__ok", ok).where("__ok is null").select(c[0].alias("chrom"), c[1].cast("bigint").alias("start"), c[2].cast("bigint").alias("end"), c[3].alias("colour"), c[4].alias("cls"))


def cx_report(spark: SparkSession, path: str, least: int = 1, contexts: tuple[str, ...] = ("CG", "CHG", "CHH")) -> DataFrame:
    """Cytosines with enough coverage: chrom, pos, strand, meth, unmeth, context."""
    df = _cut(lines(spark, path), ["chrom", "pos", "strand", "meth", "unmeth", "context"], {"pos": "bigint", "meth": "bigint", "unmeth": "bigint"}).drop("__c")
    return df.where(F.col("context").isin(*contexts) & (F.col("meth") + F.col("unmeth") >= least))


def kmer_histogram(spark: SparkSession, path: str) -> DataFrame:
    c = F.split(F.trim("value"), r"\s+")
    return lines(spark, path).select("file", c[0].try_cast("bigint").alias("depth"), F.get(c, F.lit(1)).try_cast("bigint").alias("count")).where("depth is not null and count is not null")


def contig_sizes(spark: SparkSession, path: str) -> DataFrame:
    """contig, length and rank in file order."""
    df = _cut(lines(spark, path), ["contig", "length"], {"length": "bigint"}).drop("__c").withColumn("__i", F.monotonically_increasing_id())
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__i"))).drop("__i")


def family_matrix(spark: SparkSession, path: str, family: str = "Orthogroup", drop: tuple[str, ...] = ("Total",)) -> DataFrame:
    """Wide count matrix as long (family, species, n)."""
    df = csv_rows(spark, path)
    cols = [c for c in df.columns if c != family and c not in drop]
    return df.unpivot([family], cols, "species", "n").select(F.col(family).alias("family"), "species", F.col("n").try_cast("bigint").alias("n"))


def family_genes(spark: SparkSession, path: str, family: str = "Orthogroup", prefix: str | None = r"[^|]*\|") -> DataFrame:
    """Wide matrix of gene lists as long (family, species, gene)."""
    df = csv_rows(spark, path)
    long = df.unpivot([family], [c for c in df.columns if c != family], "species", "cell")
    return long.select(F.col(family).alias("family"), "species", F.explode(list_cell(F.col("cell"), ",", prefix)).alias("gene"))


def first_section(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a file up to its first blank line, as (line, cells)."""
    df = spark.read.option("lineSep", "\n\n").text(path).withColumn("__i", F.monotonically_increasing_id())
    top = df.orderBy("__i").limit(1)
    return top.select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value")).where("value <> ''").select("line", F.split("value", "\t").alias("cells"))


def quant(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """name, tpm and the sample (the file's directory), with the manifest's columns if one is given."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path).select(F.col("Name").alias("name"), F.col("TPM").try_cast("double").alias("tpm"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("sample_id"))
    return df.join(manifest, "sample_id", "left") if manifest is not None else df


def gene_sums(df: DataFrame, tx2gene: DataFrame) -> DataFrame:
    """TPM per gene and sample; transcripts without a gene stand for themselves."""
    return df.join(tx2gene.select(F.col("tx_id").alias("name"), "gene_id"), "name", "left").groupBy(F.coalesce("gene_id", "name").alias("gene_id"), "sample_id").agg(F.sum("tpm").alias("tpm"))


def busco_json(spark: SparkSession, path: str, mode: str | None = None) -> DataFrame:
    """One row per species directory: the summary with the newest file time; unreadable files are left out."""
    df = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("mtime"))
    g = lambda p: F.get_json_object("value", f"$.{p}")
    out = df.select(F.element_at(F.split("file", "/"), -2).alias("species"), "file", "mtime", g("parameters.mode").alias("mode"), g("lineage_dataset.name").alias("lineage"), g("results.Complete").try_cast("double").alias("complete"), g("results.n_markers").try_cast("bigint").alias("markers")).where("complete is not null")
    out = out.where(F.col("mode") == mode) if mode else out
    w = Window.partitionBy("species").orderBy(F.desc("mtime"), "file")
    return out.withColumn("candidates", F.count(F.lit(1)).over(Window.partitionBy("species"))).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def busco_table(spark: SparkSession, path: str) -> DataFrame:
    """Counts of states, each id by its first row."""
    df = _cut(lines(spark, path).withColumn("value", F.concat_ws("\t", "value", F.lit(""))), ["id", "state"]).drop("__c").withColumn("__i", F.monotonically_increasing_id())
    return df.groupBy("id").agg(F.min_by("state", "__i").alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def marked_columns(df: DataFrame, part: str) -> list[str]:
    """Columns whose name contains a text, as result tables with varying headers need."""
    return [c for c in df.columns if part.lower() in c.lower()]


def significant(change: DataFrame, prob: DataFrame, family: str, branch: str, alpha: float = 0.05) -> DataFrame:
    """Families that change on a branch with p below alpha: family, change, p, direction."""
    j = change.select(family, F.col(f"`{branch}`").try_cast("double").alias("change")).join(prob.select(family, F.col(f"`{branch}`").try_cast("double").alias("p")), family)
    return j.where((F.col("p") < alpha) & (F.col("change") != 0)).withColumn("direction", F.when(F.col("change") > 0, "expansion").otherwise("contraction"))


# positions of (chrom, start, end, type, length) in the layouts of assembly variants; -1 is none
EVENT_LAYOUTS = {"combined": (0, 1, 2, 3, 4), "cnv": (0, 1, 2, -1, 3), "inv": (0, 1, 2, -1, -1), "trl": (0, 1, 2, -1, -1)}
EVENT_TYPES = {"cnv": "CNV", "inv": "INV", "trl": "TRA"}


def assembly_events(spark: SparkSession, paths: dict[str, str], least: int = 50) -> DataFrame:
    """Variants of several layouts as one table, each file's repeated rows once, small DEL and INS out."""
    out = None
    for kind, path in paths.items():
        pos = EVENT_LAYOUTS[kind]
        c = F.split("value", "\t")
        df = lines(spark, path).select("file", F.get(c, F.lit(pos[0])).alias("chrom"), F.get(c, F.lit(pos[1])).try_cast("bigint").alias("a"), F.get(c, F.lit(pos[2])).try_cast("bigint").alias("b"), (F.upper(F.get(c, F.lit(pos[3]))) if pos[3] >= 0 else F.lit(EVENT_TYPES[kind])).alias("type"), (F.abs(F.get(c, F.lit(pos[4])).try_cast("bigint")) if pos[4] >= 0 else F.lit(None).cast("bigint")).alias("len"), F.lit(kind).alias("layout"))
        df = df.where("a is not null").dropDuplicates(["file", "chrom", "a", "b", "type"])
        out = df if out is None else out.unionByName(df)
    ev = out.select("layout", "file", "chrom", F.least("a", F.coalesce("b", "a")).alias("start"), F.greatest("a", F.coalesce("b", "a")).alias("end"), "type", "len")
    ev = ev.withColumn("len", F.coalesce("len", F.col("end") - F.col("start")))
    return ev.where(~(F.col("type").isin("DEL", "INS") & (F.col("len") < least)))


def emapper(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Distinct (query, term) of a multi-valued column; the single-hash line is the header."""
    head = spark.read.text(path).where(F.col("value").rlike("^#[^#]")).limit(1).collect()
    names = head[0][0].lstrip("#").rstrip("\r").split("\t") if head else []
    i = names.index(column)
    c = F.split("value", "\t")
    terms = F.explode(list_cell(F.regexp_replace(F.get(c, F.lit(i)), ";", ","), ","))
    return lines(spark, path).select(c[0].alias("query"), terms.alias("term")).where("term <> '-'").distinct()


def first_column(spark: SparkSession, path: str, skip_hash: bool = True) -> DataFrame:
    return lines(spark, path, "#" if skip_hash else None).select(F.split(F.trim("value"), r"\s+")[0].alias("id")).distinct()


def compartments(spark: SparkSession, path: str, chroms: list[str] | None = None) -> DataFrame:
    df = _cut(lines(spark, path), ["chrom", "start", "end", "e1"], {"start": "bigint", "end": "bigint", "e1": "double"}).drop("__c").where("e1 is not null")
    return df.where(F.col("chrom").isin(chroms)) if chroms else df


def repeatmasker_out(spark: SparkSession, path: str, id_map: DataFrame | None = None) -> DataFrame:
    """Rows of a .out file with the sequence name mapped (``mapped`` tells whether it was known)."""
    c = F.split(F.trim("value"), r"\s+")
    df = lines(spark, path).where(F.col("value").rlike(r"^\s*\d+\s")).select(c[4].alias("seq"), (c[5].try_cast("bigint") - 1).alias("start"), c[6].try_cast("bigint").alias("end"), F.when(c[8] == "C", "-").otherwise("+").alias("strand"), c[9].alias("repeat"), c[10].alias("cls"), c[1].try_cast("double").alias("divergence"))
    if id_map is None:
        return df
    m = id_map.toDF("seq", "new_seq")
    return df.join(m, "seq", "left").withColumn("mapped", F.col("new_seq").isNotNull()).withColumn("seq", F.coalesce("new_seq", "seq")).drop("new_seq")


def tandem_summary(spark: SparkSession, path: str) -> DataFrame:
    """CSV of repeat arrays as half-open intervals with a generated family name."""
    df = csv_rows(spark, path, ",")
    return df.select(F.col(df.columns[0]).alias("chrom"), (F.col(df.columns[1]).try_cast("bigint") - 1).alias("start"), F.col(df.columns[2]).try_cast("bigint").alias("end"), F.format_string("rep_%s", F.col(df.columns[3])).alias("name"))


def anchor_spans(spark: SparkSession, path: str, genes_a: DataFrame, genes_b: DataFrame) -> DataFrame:
    """Block endpoints resolved by gene (gene, chrom, start, end): the span per chromosome pair."""
    c = F.split("value", "\t")
    ends = F.array(F.struct(c[0].alias("a"), c[2].alias("b")), F.struct(c[1].alias("a"), c[3].alias("b")))
    df = lines(spark, path).where(F.size(c) >= 4).select(F.col("value").alias("i"), F.explode(ends).alias("p")).select("i", "p.a", "p.b")
    ga = genes_a.select(F.col("gene").alias("a"), F.col("chrom").alias("a_chrom"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    gb = genes_b.select(F.col("gene").alias("b"), F.col("chrom").alias("b_chrom"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    j = df.join(ga, "a").join(gb, "b")
    return j.groupBy("a_chrom", "b_chrom").agg(F.min("a_start").alias("a_start"), F.max("a_end").alias("a_end"), F.min("b_start").alias("b_start"), F.max("b_end").alias("b_end"), F.count_distinct("i").alias("blocks"))


def flat_records(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Records of a flat file that end with a line ``//``: accession and, per field, all matches of its pattern."""
    df = spark.read.option("lineSep", "//\n").text(path).where(F.length(F.trim("value")) > 0)
    acc = F.regexp_extract("value", r"(?m)^AC\s+(\w+)", 1)
    return df.select(acc.alias("accession"), *(F.regexp_extract_all("value", F.lit(p), 1).alias(n) for n, p in fields.items()))


def region_depth(spark: SparkSession, path: str) -> DataFrame:
    """Interval depths made by an external tool: chrom, start, end, name, tag, depth."""
    df = _cut(lines(spark, path), ["chrom", "start", "end", "name", "depth"], {"start": "bigint", "end": "bigint", "depth": "double"}).drop("__c")
    return df.withColumns({"tag": F.get(F.split("name", r"\|"), F.lit(1)), "name": F.split("name", r"\|")[0]})


def interval_values(spark: SparkSession, path: str) -> DataFrame:
    """Values of a binary track, exported to bedGraph upstream (there is no native reader)."""
    return bedgraph(spark, path)


def spreadsheet(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet through pandas on the driver; needs a spreadsheet package."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))


def first_existing(directory: str, patterns: list[str]) -> str | None:
    """The first non-empty file of the first pattern that matches; ties by path length, then path."""
    for pattern in patterns:
        found = sorted((p for p in glob.glob(os.path.join(directory, pattern)) if os.path.getsize(p) > 0), key=lambda p: (len(p), p))
        if found:
            return found[0]
    return None


def ini_section(path: str, section: str) -> dict[str, str]:
    parser = configparser.ConfigParser()
    parser.read(path)
    return dict(parser[section]) if parser.has_section(section) else {}


def run_config(path: str) -> dict:
    """A JSON run configuration; entries that are existing relative paths are resolved beside it."""
    with open(path) as f:
        conf = json.load(f)
    base = os.path.dirname(os.path.abspath(path))
    return {k: os.path.join(base, v) if isinstance(v, str) and not os.path.isabs(v) and os.path.exists(os.path.join(base, v)) else v for k, v in conf.items()}
