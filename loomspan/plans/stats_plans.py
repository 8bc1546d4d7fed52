"""Statistics, ranking, set, sequence and streaming-form queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import scalars as S
from loomspan.operators import islands as L
from loomspan.operators import karyotype as K
from loomspan.operators import relational as R
from loomspan.operators import signal as G
from loomspan.operators import stats as T
from loomspan.runtime import table
from loomspan.streaming import windows as SW


def r(c, digits: int = 9):
    return F.round(c, digits)


def grouped_quantiles(spark, d):
    li = table(spark, d, "lineitem")
    keys = ["l_returnflag", "l_linestatus"]
    means = li.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), r(F.avg("l_extendedprice"), 4).alias("mean"))
    return means.join(T.group_quantiles(li, keys, "l_extendedprice", {"q25": 0.25, "q50": 0.5, "q90": 0.9}), keys)


def nearest_rank(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_suppkey").agg(T.nearest_rank("l_extendedprice", 0.5).alias("p50"), T.nearest_rank("l_extendedprice", 0.95).alias("p95"))


def spearman(spark, d):
    li = table(spark, d, "lineitem")
    out = T.spearman(li, ["l_returnflag"], "l_quantity", "l_discount")
    return out.select("l_returnflag", r("spearman", 8).alias("spearman"), "n")


def average_rank(spark, d):
    return T.average_rank(table(spark, d, "part"), ["p_brand"], "p_size").select("p_partkey", "avg_rank")


def pearson_distance(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_suppkey").agg(r(T.pearson_distance("l_quantity", "l_extendedprice"), 8).alias("distance"))


def mann_whitney(spark, d):
    out = T.mann_whitney(table(spark, d, "lineitem"), ["l_linestatus"], "l_returnflag", "A", "R", "l_quantity")
    return out.select("l_linestatus", "n1", "n2", r("u", 3).alias("u"), r("z", 8).alias("z"))


def mann_whitney_p(spark, d):
    return T.mann_whitney(table(spark, d, "lineitem"), ["l_linestatus"], "l_returnflag", "A", "R", "l_quantity").select("l_linestatus", "z", "p")


def bootstrap_mean(spark, d):
    """Means of 60 rounds; which row weighs how much in which round follows from its id."""
    out = T.bootstrap_mean(table(spark, d, "events"), ["event_type"], "value", 60, 7, ["event_id"])
    return out.select("event_type", r("lo", 6).alias("lo"), r("hi", 6).alias("hi"))


def bootstrap_distance(spark, d):
    """Distance of quantity and price per line status and return flag, with its resampling."""
    li = table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    out = T.bootstrap_distance(li, ["l_linestatus", "l_returnflag"], "l_quantity", "l_extendedprice", 20, 3, ["id"])
    return out.select("l_linestatus", "l_returnflag", "n", *(r(x, 6).alias(x) for x in ("distance", "mean", "lo", "hi")), "rounds")


def empirical_p(spark, d):
    """Supplier means against the mean of its nation's purchases, as a stated null."""
    li = table(spark, d, "lineitem").withColumn("observed", F.lit(30000.0))
    out = T.empirical_p(li, ["l_suppkey"], "l_extendedprice", "observed")
    return out.select("l_suppkey", "ge", "n", r("p").alias("p"), r("z", 6).alias("z"), r("p95", 4).alias("p95"))


def histogram(spark, d):
    return G.per_class_bins(table(spark, d, "lineitem"), ["l_returnflag"], 0.0, 100000.0, 20, "l_extendedprice", outside=True)


def kde(spark, d):
    out = T.kde(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", 0.0, 50.0, 51, 2.0)
    return out.select("l_returnflag", r("x", 6).alias("x"), r("density").alias("density"))


def histogram_peaks(spark, d):
    h = G.per_class_bins(table(spark, d, "lineitem"), ["l_returnflag"], 0.0, 100000.0, 20, "l_extendedprice", outside=True)
    a = T.peak(h, ["l_returnflag"], "bin", "n", 0, 9).select("l_returnflag", F.col("bin").alias("peak_bin"), F.col("n").alias("peak_n"))
    b = T.peak(h, ["l_returnflag"], "bin", "n", -math.inf, math.inf, trough=True).select("l_returnflag", F.col("bin").alias("trough_bin"), F.col("n").alias("trough_n"))
    return a.join(b, "l_returnflag")


def genome_size(spark, d):
    """Depth spectrum by group of customers: how many spent how many times 20,000."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    h = o.groupBy((F.col("o_custkey") % 7).alias("k"), F.floor(F.col("t") / 20_000).cast("bigint").alias("depth")).agg(F.count(F.lit(1)).alias("count"))
    return T.genome_size(h, ["k"], "depth", "count", 5)


def size_frequencies(spark, d):
    """Events (type and place, in steps of 100 kb) by size class and number of samples that call them."""
    c = table(spark, d, "sv_calls").where("type in ('DEL', 'INS') and chrom is not null and pos is not null")
    e = c.groupBy("type", "chrom", F.floor(F.col("pos") / 100_000).alias("at")).agg(F.max("len").alias("len"), F.count_distinct("sample").alias("n"))
    return T.size_frequencies(e, "len", "n", 12).withColumn("share", r("share").alias("share"))


def leaf_order(spark, d):
    """Nations in the order of the tree of their mean balances."""
    m = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("v"))
    pairs = R.unordered_pairs(m.withColumn("k", F.lit(1)), ["k"], "c_nationkey")
    return T.leaf_order(pairs.select(F.col("l.c_nationkey").alias("a"), F.col("r.c_nationkey").alias("b"), F.abs(F.col("l.v") - F.col("r.v")).alias("d")), "a", "b", "d")


def command_text(spark, d):
    c = table(spark, d, "chunks").where("chunk_id is not null").select("chunk_id", "chrom", "start", "vcf").distinct()
    return c.select(S.command_text("genotype -r {chrom}:{start} -i {vcf} -o {chunk_id}.vcf").alias("line"))


def consensus(spark, d):
    """Majority base per column of the bases named in the texts of each source."""
    docs = table(spark, d, "documents").where("source is not null and text is not null").withColumn("seq", F.explode(F.regexp_extract_all("text", F.lit("([ACGTN]{60,})"), F.lit(1))))
    return T.consensus(docs, ["source"], "seq")


def nucleotide_diversity(spark, d):
    docs = table(spark, d, "documents").where("source is not null and text is not null").withColumn("seq", F.explode(F.regexp_extract_all("text", F.lit("([ACGTN]{60,})"), F.lit(1))))
    return T.nucleotide_diversity(docs, ["source"], "seq").select("source", r("pi", 8).alias("pi"), "sites")


def pairwise_identity(spark, d):
    """Region names as a small alignment."""
    reg = table(spark, d, "region").select("r_name", F.rpad("r_name", 12, "-").alias("seq"))
    return T.pairwise_identity(reg, "r_name", "seq").select("a", "b", "columns", r("identity").alias("identity"))


def best_pair_similarity(spark, d):
    m = table(spark, d, "sv_matches").where("id_a is not null and id_b is not null").withColumns({"cov": F.coalesce("score", F.lit(0.0)) * 100, "la": F.lit(100.0), "lb": F.lit(90.0)})
    return T.best_pair_similarity(m, "id_a", "id_b", "score", "cov", "la", "lb", 0.5)


def threshold_grid(spark, d):
    li = table(spark, d, "lineitem")
    return T.threshold_grid(li, ["l_suppkey"], [(10.0, 0.05), (40.0, 0.09), (49.0, 0.1)], "l_quantity", "l_discount", F.col("l_returnflag") == "R")


def fixed_categories(spark, d):
    out = R.fixed_categories(table(spark, d, "orders"), "o_orderstatus", ["O", "F", "P", "X"])
    return out.select("o_orderstatus", "n", r("pct").alias("pct"))


def count_by_key(spark, d):
    return table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


def left_default(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return R.with_default(table(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], {"n": 0})


def outer_multiway(spark, d):
    ev = table(spark, d, "events")
    return R.outer_all([ev.where(F.col("event_type") == t).groupBy("user_id").agg(F.count(F.lit(1)).alias(t)) for t in ("click", "view", "error")], ["user_id"])


def distinct_strings(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(R.distinct_string("p_type").alias("types"))


def top_k_strings(spark, d):
    return R.top_k_string(table(spark, d, "events"), ["user_id"], "event_type", 3)


def top_n_role(spark, d):
    return R.top_n(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rank", "role")


def top_or_other(spark, d):
    return R.top_or_other(table(spark, d, "part"), "p_brand", 5).groupBy("display").agg(F.count(F.lit(1)).alias("n"))


def surrogate_ids(spark, d):
    return R.surrogate_ids(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "ORD").select("o_orderkey", "sid")


def natural_sort(spark, d):
    w = Window.partitionBy(F.lit(0)).orderBy(*R.natural_key(F.col("p_brand")))
    return table(spark, d, "part").select("p_brand").distinct().withColumn("pos", F.row_number().over(w))


def preferred_sort(spark, d):
    return table(spark, d, "orders").select("o_orderpriority").distinct().withColumn("rank", R.preferred_rank(F.col("o_orderpriority"), ["2-HIGH", "1-URGENT"]))


def contig_ranks(spark, d):
    order = table(spark, d, "gap_bed").groupBy("chrom").agg(F.min("start").alias("rank0")).withColumn("rk", F.col("rank0").cast("int"))
    c = table(spark, d, "chunks").where("chrom is not null").select("chunk_id", "chrom").distinct()
    return R.ranked_contigs(c, "chrom", order, "chrom", "rk").select("chunk_id", "contig_rank")


def global_top(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


def hash_sample(spark, d):
    return R.sample_rows(table(spark, d, "orders"), 100, 1, ["o_orderkey"]).select("o_orderkey")


def set_union(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, d, "customer").select("c_custkey")).distinct()


def set_intersect(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey"))


def set_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


def union_all(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n"), F.lit("s").alias("kind"))
    return a.unionByName(table(spark, d, "customer").select(F.col("c_nationkey").alias("n"), F.lit("c").alias("kind"))).groupBy("n", "kind").agg(F.count(F.lit(1)).alias("rows"))


def set_equality(spark, d):
    return R.same_sets(table(spark, d, "customer").select("c_nationkey"), table(spark, d, "nation").select("n_nationkey"))


def distinct_rows(spark, d):
    return table(spark, d, "sv_calls").dropDuplicates(["id", "sample", "chrom", "pos", "end", "type"]).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def two_scopes(spark, d):
    out = R.two_scopes(table(spark, d, "lineitem"), F.col("l_discount") >= 0.05, ["l_returnflag"], [F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity"), 2).alias("qty")])
    return out


def chunk_split(spark, d):
    c = table(spark, d, "sv_calls").where("chrom is not null and pos is not null and end is not null").groupBy("id", "chrom", "pos", "end").agg(F.count(F.lit(1)).alias("copies"))
    return R.chunks(c, ["chrom"], ["pos", "end", "id"], 50, "pos", "end", 20_000)


def wide_pivot(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(r(F.sum("o_totalprice"), 2).alias("v"))
    return R.wide_matrix(g, "o_orderpriority", "o_orderstatus", "v", ["F", "O", "P"])


def long_unpivot(spark, d):
    return table(spark, d, "part").unpivot(["p_partkey"], ["p_brand", "p_type", "p_name"], "field", "value")


def dense_grid(spark, d):
    m = table(spark, d, "sv_matches").where("id_a is not null and id_b is not null").groupBy(F.least(F.substring("id_a", 1, 3), F.substring("id_b", 1, 3)).alias("a"), F.greatest(F.substring("id_a", 1, 3), F.substring("id_b", 1, 3)).alias("b")).agg(r(F.max("score"), 6).alias("v"))
    return R.dense_grid(m, "a", "b", "v", ["asm", "lrc", "pbx", "zzz"])


def semi_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    semi = c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit("semi").alias("kind"), "n")
    anti = c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("anti").alias("kind"), "n")
    return semi.unionByName(anti)


def dimension_chain(spark, d):
    li, o, c, n, g = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(g, n["n_regionkey"] == g["r_regionkey"])
    return j.groupBy("r_name", "l_returnflag").agg(r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


def length_bins(spark, d):
    c = table(spark, d, "sv_calls").where("len is not null")
    return c.groupBy(S.length_bin(F.col("len")).alias("bin"), S.size_class(F.col("len")).alias("cls")).agg(F.count(F.lit(1)).alias("n"))


def distance_bins(spark, d):
    """Events by the bin of a signed distance; every seventh counts as within a gene, every eleventh as unknown."""
    sd = F.when(F.col("event_id") % 11 != 0, F.round((F.col("value") - 50) * 130).cast("bigint"))
    ev = table(spark, d, "events").withColumn("b", S.distance_bin(sd, F.col("event_id") % 7 == 0))
    return ev.groupBy("b.label", "b.center").agg(F.count(F.lit(1)).alias("n"))


def safe_numbers(spark, d):
    x = F.when(F.col("event_id") % 4 == 0, F.col("value").cast("string")).when(F.col("event_id") % 4 == 1, F.lit("NA")).when(F.col("event_id") % 4 == 2, F.lit(" -3.9 ")).otherwise(F.lit("nan"))
    e = table(spark, d, "events").select("event_id", x.alias("x"))
    return e.select("event_id", S.safe_int(F.col("x")).alias("i"))


def ratios(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return g.select("o_custkey", r(S.percent(F.col("p"), F.col("f"))).alias("pct"), r(S.log2_ratio(F.col("p"), F.col("f"))).alias("l2"))


def reverse_complements(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([ACGTN]{60,})"), 1)).alias("s")).distinct()
    s = F.col("s")
    return docs.select("doc_id", F.md5(S.reverse_complement(s)).alias("rc"), F.md5(S.codon_positions_12(s)).alias("c12"), F.length(S.fourfold_sites(s)).cast("bigint").alias("ff"), F.md5(S.translate_codons(s)).alias("aa"))


def translated_codons(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([ACGTN]{60,})"), 1)).alias("s"))
    return docs.select(F.explode(F.split(S.translate_codons(F.col("s")), "")).alias("aa")).where("aa <> ''").groupBy("aa").agg(F.count(F.lit(1)).alias("n"))


def kmer_spectrum(spark, d):
    """How many 6-mers of the sequences in the texts occur how often."""
    from loomspan.operators.matching import kmers

    docs = table(spark, d, "documents").where("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit("([ACGTN]{60,})"), 1)).alias("s"))
    k = docs.select(F.explode(kmers(F.col("s"), 6)).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("depth"))
    return k.groupBy("depth").agg(F.count(F.lit(1)).alias("count"))


def interval_texts(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"((?:msv|tru|orb)_(?:chr|ctg)\d+:\d[\d,]*-\d[\d,]*)"), 1)).alias("t"))
    c, a, b = S.parse_interval(F.col("t"))
    return docs.select("doc_id", c.alias("chrom"), a.alias("a"), b.alias("b")).groupBy("doc_id", "chrom").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count(F.lit(1)).alias("n"))


#: (feature, classification) as annotations give them, and rows of the domain-based classifier.
REPEATS = [
    ("Copia_LTR_retrotransposon", "LTR/Copia"), ("Gypsy_LTR_retrotransposon", "LTR/Gypsy"), ("LTR_retrotransposon", "LTR/unknown"), ("LTR_retrotransposon", "LTR/CRM"), ("long_repeat", "LTR/ERV/Unknown"), ("helitron", "DNA/Helitron"), ("CACTA_TIR_transposon", "DNA/DTC"),
    ("repeat_region", "MITE/DTM"), ("terminal_inverted_repeat", None), ("LINE_element", "LINE/L1"), ("SINE_element", "SINE/tRNA"), ("repeat_fragment", None), ("repeat_region", ""), ("Copia_LTR_retrotransposon", None), (None, "unknown"), (None, None),
    ("dna_like", "Satellite"), ("target_site", "LTR"), ("x", "TIR"), ("y", "Helitron"), ("z", "LINE"), (" gypsy_LTR_retrotransposon ", " LTR/Gypsy "),
]
CLASSIFIED = [(None, None, None), ("LTR", "Ale", "Copia"), ("ltr", "unknown", "Gypsy"), ("LTR", " ", "other"), ("TIR", "unknown", "hAT")]


def repeat_classes(spark, d):
    """Repeats by the five class ladders; which repeat an event stands for follows from its id."""
    kinds = spark.createDataFrame([(i, *x) for i, x in enumerate(REPEATS)], "i bigint, f string, c string")
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(CLASSIFIED)], "j bigint, o string, clade string, sf string")
    e = table(spark, d, "events").select((F.col("event_id") % len(REPEATS)).alias("i"), (F.col("event_id") % len(CLASSIFIED)).alias("j"))
    e = e.join(F.broadcast(kinds), "i").join(F.broadcast(rows), "j")
    f, c = F.col("f"), F.col("c")
    sub = S.te_subtype(c, F.col("o"), F.col("clade"), F.col("sf"))
    cols = e.select(S.te_broad(f, c).alias("broad"), S.te_of_text(F.concat_ws("\t", f, c)).alias("text_class"), S.te_composition(f, c).alias("composition"), sub["subtype"].alias("subtype"), sub["major"].alias("subtype_major"), S.te_major(c, f).alias("major"), S.family_name(F.coalesce(f, F.lit("x"))).alias("family"))
    return cols.groupBy(*cols.columns).agg(F.count(F.lit(1)).alias("n"))


def ltr_ages(spark, d):
    e = table(spark, d, "lineitem").select("l_returnflag", (1 - F.col("l_discount")).alias("ident"))
    return e.groupBy("l_returnflag").agg(r(F.avg(S.ltr_age(F.col("ident"))), 6).alias("raw"), r(F.avg(S.ltr_age(F.col("ident"), jukes_cantor=True)), 6).alias("jc"), r(F.avg(S.age_from_k(1 - F.col("ident"))), 6).alias("k"))


def evidence_rules(spark, d):
    li = table(spark, d, "lineitem")
    rule = S.evidence_rule(F.col("l_extendedprice") / 100, F.col("l_linenumber"), F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_discount") > 0.05)
    return li.groupBy(F.coalesce(rule, F.lit("none")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def gene_contexts(spark, d):
    ev = table(spark, d, "events").withColumn("sd", F.round((F.col("value") - 50) * 100))
    lab = S.gene_context(F.col("event_type") == "click", F.col("event_type").isin("click", "view"), F.col("sd"))
    return ev.groupBy(lab.alias("context")).agg(F.count(F.lit(1)).alias("n"))


def json_props(spark, d):
    ev = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    return ev.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("k"), F.max("k").alias("top"))


def info_maps(spark, d):
    c = table(spark, d, "sv_calls").where("id is not null").groupBy("id").agg(F.max("type").alias("type"), F.max("len").alias("len"), F.max("filt").alias("filt"))
    info = F.concat(F.lit("SVTYPE="), F.coalesce("type", F.lit(".")), F.lit(";PRECISE;SVLEN="), F.coalesce(F.col("len").cast("string"), F.lit(".")), F.lit(";"))
    return c.select("id", S.info_text(info).alias("info"), S.info_map(info)["SVLEN"].try_cast("bigint").alias("len"), S.passes(F.col("filt")).alias("pass"))


def packed_arrays(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))), lambda x: x["l_quantity"].cast("string")), "_").alias("cell"))
    x = K.packed_numbers(F.col("cell"))
    return li.select("l_orderkey", F.size(x).alias("n"), r(F.aggregate(x, F.lit(0.0), lambda a, b: a + b), 2).alias("total"), r(K.share_at_most(x, 10.0)).alias("low"))


def longest_isoform(spark, d):
    g = table(spark, d, "gtf").where("type = 'CDS' and transcript_id is not null and gene_id is not null and left is not null and right is not null").select("gene_id", "transcript_id", F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b")).distinct()
    t = g.groupBy("gene_id", "transcript_id").agg(F.sum(F.col("b") - F.col("a") + 1).alias("bp"))
    w = Window.partitionBy("gene_id").orderBy(F.desc("bp"), "transcript_id")
    return t.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("gene_id", "transcript_id", "bp")


def merge_identical(spark, d):
    """Features that agree in place and strand, with summed evidence and the best score's source."""
    g = table(spark, d, "gtf").where("seq_id is not null and type is not null and left is not null and right is not null")
    return g.groupBy("seq_id", "type", F.col("left").alias("lo"), F.col("right").alias("hi"), "strand").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


def type_audit(spark, d):
    """Counts per feature type of two sources, with their ratio."""
    g = table(spark, d, "gtf").where("type is not null")
    a = g.where("source = 'liftset'").groupBy("type").agg(F.count(F.lit(1)).alias("a"))
    b = g.where("source = 'weaver'").groupBy("type").agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "type", "left").select("type", "a", "b", r(F.try_divide(F.col("a").cast("double"), F.col("b"))).alias("ratio"))


def annotation_coverage(spark, d):
    """Genes per kind of evidence, their union, and what is left of all genes."""
    g = table(spark, d, "gtf").where("gene_id is not null and source is not null")
    per = g.groupBy("source").agg(F.count_distinct("gene_id").alias("genes"))
    whole = g.agg(F.count_distinct("gene_id").alias("all_genes"))
    return per.join(F.broadcast(whole)).select("source", "genes", F.greatest(F.col("all_genes") - F.col("genes"), F.lit(0)).alias("missing"), r(S.percent(F.col("genes"), F.col("all_genes"))).alias("pct"))


def filter_funnel(spark, d):
    c = table(spark, d, "sv_calls")
    steps = {"raw": F.lit(True), "pass": F.col("filt") == "PASS", "long": (F.col("filt") == "PASS") & (F.col("len") >= 50), "good": (F.col("filt") == "PASS") & (F.col("len") >= 50) & (F.col("qual") >= 20)}
    return c.groupBy("sample").agg(*(F.count_if(F.coalesce(x, F.lit(False))).alias(n) for n, x in steps.items()))


def length_sweep(spark, d):
    c = table(spark, d, "sv_calls").where("type is not null")
    return c.groupBy("type").agg(*(F.count_if(F.col("len") >= n).alias(f"ge_{n}") for n in (0, 50, 100, 500, 1000, 5000, 10000, 20000)))


def tumbling_windows(spark, d):
    ev = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = SW.tumbling(ev, "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n"), r(F.sum("value"), 4).alias("v")])
    return out.select(F.unix_seconds("win_start").alias("win"), "event_type", "n", "v")


def session_windows(spark, d):
    ev = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = SW.sessions(ev, "ts", "30 minutes", ["user_id"], [F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")])
    return out.select("user_id", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "n")


def first_seen(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return SW.first_seen(ev, ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id")


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and n not in ("r",) and not n.startswith("_")}



def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join([str(i), *("NULL" if x is None else f"'{x}'" for x in row)]) + ")" for i, row in enumerate(rows))


def _boot(rows: str, cols: str, rounds: int, seed: int) -> str:
    """Rows b: each row in each round r, with its Poisson(1) weight w by splitmix64 of id, seed and round."""
    m, g, a, c = 2**64, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
    cuts, p = [], 0.0
    for k in range(8):
        p += math.exp(-1) / math.factorial(k)
        cuts.append(p)
    weight = " + ".join(f"CAST(u >= CAST({x!r} AS DOUBLE) AS INTEGER)" for x in cuts)
    u = lambda x: f"CAST({x} AS UHUGEINT)"
    return f"""WITH q AS ({rows}), r AS (SELECT *, CAST(unnest(range(1, {rounds + 1})) AS UHUGEINT) AS r FROM q),
z0 AS (SELECT *, CAST((id * {u(a)} % {u(m)} + r * {u(g)} % {u(m)} + {u(seed)} * {u(c)} % {u(m)}) % {u(m)} AS UBIGINT) AS z FROM r),
z1 AS (SELECT * REPLACE (CAST({u("xor(z, z >> 30)")} * {u(a)} % {u(m)} AS UBIGINT) AS z) FROM z0), z2 AS (SELECT * REPLACE (CAST({u("xor(z, z >> 27)")} * {u(c)} % {u(m)} AS UBIGINT) AS z) FROM z1),
z3 AS (SELECT *, CAST(xor(z, z >> 31) >> 11 AS DOUBLE) / 9007199254740992 AS u FROM z2), b AS (SELECT {cols}, r, {weight} AS w FROM z3)"""


_RANK = "rank() OVER (PARTITION BY {p} ORDER BY {c}) + (count(*) OVER (PARTITION BY {p}, {c}) - 1) / 2.0::DOUBLE"
_SEQ = "q AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '[ACGTN]{60,}')) AS s FROM documents WHERE text IS NOT NULL)"
_AA = "WITH " + _SEQ + ", c AS (SELECT doc_id, s, unnest(list_transform(range(1, length(s) // 3 + 1), lambda i: substring(s, 3 * i - 2, 3))) AS c, unnest(range(1, length(s) // 3 + 1)) AS i FROM q)"
_CODE = "CASE WHEN c LIKE '%N%' THEN 'X' ELSE substring('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST(16 * (strpos('TCAG', c[1]) - 1) + 4 * (strpos('TCAG', c[2]) - 1) + strpos('TCAG', c[3]) AS INTEGER), 1) END"

SQL = {
    "grouped_quantiles": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS q50, quantile_cont(l_extendedprice, 0.9) AS q90 FROM lineitem GROUP BY ALL",
    "nearest_rank": "SELECT l_suppkey, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1",
    "spearman": f"WITH k AS (SELECT l_returnflag, {_RANK.format(p='l_returnflag', c='l_quantity')} AS a, {_RANK.format(p='l_returnflag', c='l_discount')} AS b FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL) SELECT l_returnflag, round(corr(a, b), 8) AS spearman, count(*) AS n FROM k GROUP BY 1",
    "average_rank": f"SELECT p_partkey, {_RANK.format(p='p_brand', c='p_size')} AS avg_rank FROM part",
    "pearson_distance": "SELECT l_suppkey, round(1 - corr(l_quantity, l_extendedprice), 8) AS distance FROM lineitem GROUP BY 1",
    "mann_whitney": f"""WITH k AS (SELECT *, {_RANK.format(p='l_linestatus', c='l_quantity')} AS r, count(*) OVER (PARTITION BY l_linestatus, l_quantity) AS t FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity IS NOT NULL),
      g AS (SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') AS n1, count(*) FILTER (l_returnflag = 'R') AS n2, sum(r) FILTER (l_returnflag = 'A') AS r1, sum(CAST(t AS DOUBLE) * t - 1) AS ties, count(*) AS n FROM k GROUP BY 1),
      u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS u FROM g) SELECT l_linestatus, n1, n2, round(u, 3) AS u, round(greatest(abs(u - n1 * n2 / 2.0::DOUBLE) - 0.5, 0) / sqrt(n1 * n2 / 12.0::DOUBLE * ((n + 1) - ties / (CAST(n AS DOUBLE) * (n - 1)))), 8) AS z FROM u""",
    "bootstrap_mean": _boot("SELECT event_type, CAST(event_id AS UHUGEINT) AS id, value AS v FROM events WHERE value IS NOT NULL", "event_type, v", 60, 7) + ", m AS (SELECT event_type, r, sum(w * v) / nullif(sum(w), 0) AS m FROM b GROUP BY ALL) SELECT event_type, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m GROUP BY 1",
    "bootstrap_distance": _boot("SELECT l_linestatus, l_returnflag, CAST(l_orderkey * 100 + l_linenumber AS UHUGEINT) AS id, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL", "l_linestatus, l_returnflag, x, y", 20, 3) + """,
      s AS (SELECT l_linestatus, l_returnflag, r, sum(w) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * x) / sum(w) AS xx, sum(w * x * y) / sum(w) AS xy, sum(w * y * y) / sum(w) AS yy FROM b GROUP BY ALL),
      d AS (SELECT l_linestatus, l_returnflag, 1 - (xy - mx * my) / sqrt((xx - mx * mx) * (yy - my * my)) AS d FROM s), e AS (SELECT l_linestatus, l_returnflag, avg(d) AS mean, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi, count(d) AS rounds FROM d GROUP BY ALL),
      k AS (SELECT l_linestatus, l_returnflag, count(*) AS n, 1 - corr(l_quantity, l_extendedprice) AS distance FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY ALL)
      SELECT l_linestatus, l_returnflag, n, round(distance, 6) AS distance, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, rounds FROM k JOIN e USING (l_linestatus, l_returnflag)""",
    "hash_sample": "SELECT o_orderkey FROM orders ORDER BY md5('1:' || o_orderkey), o_orderkey LIMIT 100",
    "command_text": """SELECT 'genotype -r ' || coalesce(chrom, '') || ':' || coalesce(CAST(start AS VARCHAR), '') || ' -i ' || coalesce(vcf, '') || ' -o ' || chunk_id || '.vcf' AS line FROM (SELECT DISTINCT chunk_id, chrom, "start" AS start, vcf FROM chunks WHERE chunk_id IS NOT NULL)""",
    "empirical_p": "SELECT l_suppkey, count(*) FILTER (l_extendedprice >= 30000) AS ge, count(*) AS n, round((count(*) FILTER (l_extendedprice >= 30000) + 1) / (count(*) + 1), 9) AS p, round((30000 - avg(l_extendedprice)) / stddev_pop(l_extendedprice), 6) AS z, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1",
    "histogram": "SELECT l_returnflag, CAST(CASE WHEN l_extendedprice = 100000 THEN 19 ELSE floor(l_extendedprice / 5000) END AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY ALL",
    "kde": "WITH v AS (SELECT l_returnflag, l_quantity AS v, count(*) AS c FROM lineitem GROUP BY ALL), x AS (SELECT CAST(unnest(range(0, 51)) AS DOUBLE) AS x) SELECT l_returnflag, x, round(sum(c * exp(-0.5 * ((x - v) / 2) ** 2)) / sum(c) / (2 * sqrt(2 * pi())), 9) AS density FROM v, x GROUP BY ALL",
    "histogram_peaks": """WITH h AS (SELECT l_returnflag, CAST(CASE WHEN l_extendedprice = 100000 THEN 19 ELSE floor(l_extendedprice / 5000) END AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY ALL), a AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, bin) AS rn FROM h WHERE bin BETWEEN 0 AND 9), b AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n, bin) AS rn FROM h)
      SELECT a.l_returnflag, a.bin AS peak_bin, a.n AS peak_n, b.bin AS trough_bin, b.n AS trough_n FROM a JOIN b ON a.l_returnflag = b.l_returnflag AND a.rn = 1 AND b.rn = 1""",
    "consensus": """WITH q AS (SELECT source, unnest(regexp_extract_all(text, '[ACGTN]{60,}')) AS s FROM documents WHERE source IS NOT NULL AND text IS NOT NULL), p AS (SELECT source, unnest(range(0, length(s))) AS pos, unnest(string_split(s, '')) AS base FROM q WHERE s <> ''), n AS (SELECT source, pos, base, count(*) AS n FROM p GROUP BY ALL),
      t AS (SELECT *, sum(n) OVER (PARTITION BY source, pos) AS w, row_number() OVER (PARTITION BY source, pos ORDER BY n DESC, base) AS rn FROM n) SELECT source, string_agg(CASE WHEN n >= w * 0.5 THEN base ELSE 'N' END, '' ORDER BY pos) AS consensus FROM t WHERE rn = 1 GROUP BY source""",
    "nucleotide_diversity": """WITH q AS (SELECT source, unnest(regexp_extract_all(text, '[ACGTN]{60,}')) AS s FROM documents WHERE source IS NOT NULL AND text IS NOT NULL), p AS (SELECT source, unnest(range(0, length(s))) AS pos, unnest(string_split(s, '')) AS base FROM q WHERE s <> ''), n AS (SELECT source, pos, base, count(*) AS n FROM p WHERE base <> 'N' GROUP BY ALL),
      c AS (SELECT source, pos, sum(n) AS m, sum(n * (n - 1)) AS same FROM n GROUP BY ALL) SELECT source, round(avg(CASE WHEN m > 1 THEN 1 - same / (m * (m - 1)) END), 8) AS pi, count(CASE WHEN m > 1 THEN 1 END) AS sites FROM c GROUP BY source""",
    "pairwise_identity": "WITH s AS (SELECT r_name, rpad(r_name, 12, '-') AS q FROM region), j AS (SELECT a.r_name AS a, b.r_name AS b, unnest(string_split(a.q, '')) AS x, unnest(string_split(b.q, '')) AS y FROM s a JOIN s b ON a.r_name < b.r_name) SELECT a, b, CAST(count(*) AS INTEGER) AS columns, round(count(*) FILTER (x = y) / count(*), 9) AS identity FROM j WHERE x <> '-' AND y <> '-' GROUP BY a, b",
    "best_pair_similarity": "SELECT least(id_a, id_b) AS a, greatest(id_a, id_b) AS b, max(score) AS identity FROM sv_matches WHERE id_a <> id_b AND coalesce(score, 0) * 100 >= 45 GROUP BY 1, 2",
    "threshold_grid": "WITH g AS (SELECT l_suppkey, " + ", ".join(f"count(*) FILTER (l_quantity >= {a} AND l_discount >= {b} AND l_returnflag = 'R') AS f{i}, count(*) FILTER (l_quantity >= {a} AND l_discount >= {b} AND l_returnflag <> 'R') AS r{i}" for i, (a, b) in enumerate([("10", "0.05"), ("40", "0.09"), ("49", "0.1")])) + " FROM lineitem GROUP BY 1) SELECT l_suppkey, "
    + ", ".join(f"CASE WHEN f{i} > 0 AND r{i} > 0 THEN 'both' WHEN f{i} > 0 THEN 'forward' WHEN r{i} > 0 THEN 'reverse' ELSE 'none' END AS support_{i}" for i in range(3)) + ", " + " + ".join(f"CAST(f{i} > 0 AND r{i} > 0 AS INTEGER)" for i in range(3)) + " AS settings_both FROM g",
    "fixed_categories": "WITH k(o_orderstatus) AS (VALUES ('O'), ('F'), ('P'), ('X')) SELECT k.o_orderstatus, count(o_orderkey) AS n, round(count(o_orderkey) * 100.0::DOUBLE / (SELECT count(*) FROM orders WHERE o_orderstatus IN ('O', 'F', 'P', 'X')), 9) AS pct FROM k LEFT JOIN orders o ON o.o_orderstatus = k.o_orderstatus GROUP BY 1",
    "count_by_key": "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL",
    "left_default": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "outer_multiway": "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1",
    "distinct_strings": "SELECT p_brand, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS types FROM part GROUP BY 1",
    "top_k_strings": "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM n) SELECT user_id, string_agg(event_type || ':' || n, ';' ORDER BY rn) AS top FROM r WHERE rn <= 3 GROUP BY 1",
    "top_n_role": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) SELECT o_custkey, o_orderkey, CAST(rn AS INTEGER) AS rank, CASE WHEN rn = 1 THEN 'primary' ELSE 'secondary' END AS role FROM r WHERE rn <= 3",
    "top_or_other": "WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS rn FROM n) SELECT CASE WHEN rn <= 5 THEN p_brand ELSE 'other' END AS display, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1",
    "surrogate_ids": "SELECT o_orderkey, 'ORD' || lpad(CAST(row_number() OVER (ORDER BY o_orderkey) AS VARCHAR), 8, '0') AS sid FROM orders",
    "natural_sort": "SELECT p_brand, CAST(row_number() OVER (ORDER BY regexp_replace(p_brand, '[0-9]+$', ''), TRY_CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) NULLS FIRST, p_brand) AS INTEGER) AS pos FROM (SELECT DISTINCT p_brand FROM part)",
    "preferred_sort": "SELECT DISTINCT o_orderpriority, CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 999 END AS rank FROM orders",
    "contig_ranks": "WITH o AS (SELECT chrom, CAST(min(\"start\") AS INTEGER) AS rk FROM gap_bed GROUP BY 1) SELECT DISTINCT chunk_id, coalesce(rk, 2147483647) AS contig_rank FROM chunks LEFT JOIN o USING (chrom) WHERE chrom IS NOT NULL",
    "global_top": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "set_union": "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer",
    "set_intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "union_all": "SELECT n, kind, count(*) AS rows FROM (SELECT s_nationkey AS n, 's' AS kind FROM supplier UNION ALL SELECT c_nationkey, 'c' FROM customer) GROUP BY ALL",
    "set_equality": "SELECT NOT EXISTS (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation) AND NOT EXISTS (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer) AS equal",
    "distinct_rows": 'SELECT type, count(*) AS n FROM (SELECT DISTINCT id, sample, chrom, pos, "end", type FROM sv_calls) GROUP BY type',
    "two_scopes": "SELECT 'all' AS scope, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 2 UNION ALL SELECT 'region', l_returnflag, count(*), round(sum(l_quantity), 2) FROM lineitem WHERE l_discount >= 0.05 GROUP BY 2",
    "chunk_split": 'WITH c AS (SELECT DISTINCT id, chrom, pos, "end" AS e FROM sv_calls WHERE chrom IS NOT NULL AND pos IS NOT NULL AND "end" IS NOT NULL), r AS (SELECT *, (row_number() OVER (PARTITION BY chrom ORDER BY pos, e, id) - 1) // 50 AS chunk FROM c) SELECT chrom, CAST(chunk AS BIGINT) AS chunk, count(*) AS n, greatest(min(pos) - 20000, 0) AS chunk_start, max(e) + 20000 AS chunk_end FROM r GROUP BY 1, 2',
    "wide_pivot": "SELECT o_orderpriority, " + ", ".join(f"coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = '{s}'), 2), 0) AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY 1",
    "long_unpivot": "SELECT p_partkey, 'p_brand' AS field, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part UNION ALL SELECT p_partkey, 'p_name', p_name FROM part",
    "dense_grid": "WITH m AS (SELECT least(id_a[1:3], id_b[1:3]) AS x, greatest(id_a[1:3], id_b[1:3]) AS y, round(max(score), 6) AS v FROM sv_matches WHERE id_a IS NOT NULL AND id_b IS NOT NULL GROUP BY 1, 2), k(n) AS (VALUES ('asm'), ('lrc'), ('pbx'), ('zzz')) SELECT a.n AS a, b.n AS b, v FROM k a CROSS JOIN k b LEFT JOIN m ON least(a.n, b.n) = x AND greatest(a.n, b.n) = y",
    "semi_anti": "SELECT 'semi' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') UNION ALL SELECT 'anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "dimension_chain": "SELECT r_name, l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "length_bins": "SELECT CAST(CASE WHEN len > 10000 THEN 11000 ELSE ceil(len / 1000) * 1000 END AS BIGINT) AS bin, CASE WHEN len < 50 THEN NULL WHEN len < 500 THEN '50-499' WHEN len < 5000 THEN '500-4999' ELSE '>=5000' END AS cls, count(*) AS n FROM sv_calls WHERE len IS NOT NULL GROUP BY ALL",
    "distance_bins": """WITH e AS (SELECT event_id % 7 = 0 AS g, CASE WHEN event_id % 11 <> 0 THEN CAST(round((value - 50) * 130) AS BIGINT) END AS sd FROM events), b AS (SELECT *, CAST(floor(sd / 500) * 500 AS BIGINT) AS lo FROM e),
      l AS (SELECT CASE WHEN g THEN 'Gene' WHEN sd IS NULL OR sd > 5000 THEN '>5k' WHEN sd < -5000 THEN '<-5k' ELSE regexp_replace(CAST(lo / 1000 AS VARCHAR), '[.]0$', '') || 'k~' || regexp_replace(CAST((lo + 500) / 1000 AS VARCHAR), '[.]0$', '') || 'k' END AS label,
        CAST(CASE WHEN g THEN 0 WHEN sd IS NULL OR sd > 5000 THEN 5500 WHEN sd < -5000 THEN -5500 ELSE lo + 250 END AS BIGINT) AS center FROM b) SELECT label, center, count(*) AS n FROM l GROUP BY ALL""",
    "genome_size": """WITH o AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1), h AS (SELECT o_custkey % 7 AS k, CAST(floor(t / 20000) AS BIGINT) AS d, count(*) AS c FROM o GROUP BY ALL),
      t AS (SELECT k, sum(d * c) AS a, coalesce(sum(d * c) FILTER (d >= 2), 0) AS b, coalesce(sum(d * c) FILTER (d >= 3), 0) AS e FROM h GROUP BY k), s AS (SELECT k, d, avg(c) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS y FROM h WHERE d >= 5 AND c > 0),
      m AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY y DESC, d) AS rn FROM (SELECT *, lag(y, 1, -1) OVER w AS p, lead(y, 1, -1) OVER w AS n FROM s WINDOW w AS (PARTITION BY k ORDER BY d)) WHERE y >= p AND y >= n),
      f AS (SELECT k, d AS d1, y AS y1 FROM m WHERE rn = 1), x AS (SELECT m.k, arg_min(d, rn) AS d2 FROM m JOIN f ON m.k = f.k WHERE rn BETWEEN 2 AND 12 AND d BETWEEN 1.75 * d1 AND 2.25 * d1 AND y >= 0.08 * y1 GROUP BY m.k), p AS (SELECT t.*, coalesce(d2, d1) AS peak, CASE WHEN d2 IS NOT NULL THEN 'higher_depth_peak_near_2x_top' WHEN d1 IS NOT NULL THEN 'highest_smoothed_peak' ELSE 'no_peak_after_min_depth' END AS rule FROM t LEFT JOIN f USING (k) LEFT JOIN x USING (k))
      SELECT k, peak, round_even(a / peak, 0) AS size_all, round_even(b / peak, 0) AS size_ge2, round_even(e / peak, 0) AS size_ge3, rule FROM p""",
    "size_frequencies": """WITH e AS (SELECT type, chrom, pos // 100000 AS at, max(len) AS len, count(DISTINCT sample) AS n FROM sv_calls WHERE type IN ('DEL', 'INS') AND chrom IS NOT NULL AND pos IS NOT NULL GROUP BY ALL),
      c AS (SELECT CASE WHEN len < 500 THEN '50-499' WHEN len < 5000 THEN '500-4999' ELSE '>=5000' END AS size_class, n AS n_samples, count(*) AS events FROM e WHERE len >= 50 AND n > 0 GROUP BY ALL),
      g AS (SELECT s AS size_class, CAST(unnest(range(1, 13)) AS BIGINT) AS n_samples FROM (VALUES ('50-499'), ('500-4999'), ('>=5000')) v(s)), j AS (SELECT g.*, coalesce(events, 0) AS events FROM g LEFT JOIN c USING (size_class, n_samples)), t AS (SELECT *, CAST(sum(events) OVER (PARTITION BY size_class) AS BIGINT) AS class_events FROM j)
      SELECT *, round(events / nullif(class_events, 0), 9) AS share FROM t""",
    "safe_numbers": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(trunc(value) AS BIGINT) WHEN 2 THEN -3 END AS i FROM events",
    "ratios": "WITH g AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1) SELECT o_custkey, round(coalesce(p * 100.0::DOUBLE / nullif(f, 0), 0), 9) AS pct, round(log2(p + 1) - log2(f + 1), 9) AS l2 FROM g",
    "reverse_complements": _AA + f""", a AS (SELECT doc_id, s, string_agg({_CODE}, '' ORDER BY i) AS aa, count(*) FILTER (c[1:2] IN ('CT', 'GT', 'TC', 'CC', 'AC', 'GC', 'CG', 'GG') AND c[3] <> 'N') AS ff FROM (SELECT DISTINCT doc_id, s, i, c FROM c) GROUP BY 1, 2)
      SELECT doc_id, md5(reverse(translate(s, 'ACGTN', 'TGCAN'))) AS rc, md5(regexp_replace(s, '(..).', '\\1', 'g')) AS c12, ff, md5(aa) AS aa FROM a""",
    "translated_codons": _AA + f" SELECT {_CODE} AS aa, count(*) AS n FROM c GROUP BY 1",
    "kmer_spectrum": "WITH " + _SEQ + ", k AS (SELECT k, count(*) AS depth FROM (SELECT unnest(list_transform(range(1, length(s) - 4), lambda i: substring(s, i, 6))) AS k FROM q) GROUP BY k) SELECT depth, count(*) AS count FROM k GROUP BY depth",
    "interval_texts": r"WITH t AS (SELECT doc_id, replace(unnest(regexp_extract_all(text, '(?:msv|tru|orb)_(?:chr|ctg)[0-9]+:[0-9][0-9,]*-[0-9][0-9,]*')), ',', '') AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, split_part(t, ':', 1) AS chrom, min(CAST(split_part(split_part(t, ':', 2), '-', 1) AS BIGINT)) AS a, max(CAST(split_part(split_part(t, ':', 2), '-', 2) AS BIGINT)) AS b, count(*) AS n FROM t GROUP BY 1, 2",
    "repeat_classes": f"""WITH k(i, f, c) AS (VALUES {_values(REPEATS)}), y(j, o, clade, sf) AS (VALUES {_values(CLASSIFIED)}), e AS (SELECT f, c, o, clade, sf FROM events JOIN k ON i = event_id % {len(REPEATS)} JOIN y ON j = event_id % {len(CLASSIFIED)}),
      a AS (SELECT *, trim(coalesce(c, '')) AS tc, trim(coalesce(f, '')) AS tf, lower(trim(coalesce(c, '')) || ' ' || trim(coalesce(f, ''))) AS low, lower(concat_ws(chr(9), f, c)) AS whole, coalesce(nullif(c, ''), 'unknown') AS c3, coalesce(nullif(c, ''), 'Unknown') AS c4, coalesce(nullif(c, ''), nullif(f, ''), 'unknown') AS c5 FROM e),
      b AS (SELECT CASE WHEN tc = 'LTR/Copia' OR low LIKE '%copia_ltr_retrotransposon%' THEN 'LTR/Copia' WHEN tc = 'LTR/Gypsy' OR low LIKE '%gypsy_ltr_retrotransposon%' THEN 'LTR/Gypsy' WHEN tc = 'LTR/unknown' OR tc LIKE 'LTR/%' AND lower(tc) LIKE '%/unknown' OR tf = 'LTR_retrotransposon' THEN 'LTR/unknown'
          WHEN low LIKE '%helitron%' THEN 'Helitron' WHEN tc LIKE 'DNA/%' OR tc LIKE 'MITE/%' OR low LIKE '%tir_transposon%' OR low LIKE '%terminal_inverted_repeat%' THEN 'DNA transposons' ELSE 'Other / unclassified' END AS broad,
        CASE WHEN contains(whole, 'ltr') THEN 'LTR' WHEN contains(whole, 'helitron') OR contains(whole, 'tir') OR contains(whole, 'mite') OR contains(whole, '/dt') OR contains(whole, 'dna') THEN 'DNA' ELSE 'Other_TE' END AS text_class,
        CASE WHEN starts_with(c3, 'LTR/Gypsy') THEN 'LTR/Gypsy' WHEN starts_with(c3, 'LTR/Copia') THEN 'LTR/Copia' WHEN starts_with(c3, 'LTR/') THEN 'LTR unknown' WHEN starts_with(c3, 'SINE') THEN 'SINEs' WHEN starts_with(c3, 'DNA/') OR starts_with(c3, 'MITE/') OR f = 'helitron' THEN 'DNA transposons' WHEN c3 = 'unknown' OR f IN ('repeat_fragment', 'repeat_region') THEN 'Unclassified TE' END AS composition,
        CASE WHEN lower(o) = 'ltr' THEN CASE WHEN lower(trim(clade)) NOT IN ('', '?', 'na', 'nan', 'none', 'unknown', 'unclassified') THEN trim(clade) WHEN lower(trim(sf)) IN ('copia', 'gypsy') THEN 'Unclassified LTR-RTs' ELSE 'Unknown' END
          WHEN starts_with(c4, 'LTR/') THEN CASE WHEN o IS NULL AND lower(c4) = 'ltr/unknown' THEN 'Unknown' ELSE 'Unclassified LTR-RTs' END WHEN contains(c4, '/') THEN substring(c4, strpos(c4, '/') + 1) ELSE c4 END AS subtype,
        CASE WHEN lower(o) = 'ltr' OR starts_with(c4, 'LTR/') THEN 'LTR-RT' ELSE split_part(c4, '/', 1) END AS subtype_major,
        CASE WHEN contains(c5, '/') THEN split_part(c5, '/', 1) WHEN contains(c5, 'LTR') THEN 'LTR' WHEN contains(c5, 'TIR') THEN 'TIR' WHEN contains(c5, 'LINE') THEN 'LINE' WHEN contains(c5, 'Helitron') THEN 'Helitron' ELSE c5 END AS major,
        regexp_replace(coalesce(f, 'x'), '[0-9]+$', '') AS family FROM a) SELECT *, count(*) AS n FROM b GROUP BY ALL""",
    "ltr_ages": "WITH e AS (SELECT l_returnflag, 1 - (1 - l_discount) AS d FROM lineitem) SELECT l_returnflag, round(avg(d / 2.6e-8 / 1e6), 6) AS raw, round(avg(-0.75 * ln(1 - 4 * d / 3) / 2.6e-8 / 1e6), 6) AS jc, round(avg(d / 1.02e-8 / 1e6), 6) AS k FROM e GROUP BY 1",
    "evidence_rules": "SELECT CASE WHEN aa >= 100 AND l_linenumber >= 2 THEN 'two_sources' WHEN aa >= 200 AND (l_returnflag = 'R' OR l_linestatus = 'O') THEN 'long_with_evidence' WHEN aa >= 500 AND l_discount > 0.05 THEN 'very_long' WHEN aa >= 50 AND l_returnflag = 'R' AND l_linestatus = 'O' THEN 'short_with_both' ELSE 'none' END AS rule, count(*) AS n FROM (SELECT *, l_extendedprice / 100 AS aa FROM lineitem) GROUP BY 1",
    "gene_contexts": "WITH e AS (SELECT *, round((value - 50) * 100) AS sd FROM events) SELECT CASE WHEN event_type = 'click' THEN 'exon' WHEN event_type = 'view' THEN 'intron' WHEN sd < 0 AND sd >= -2000 THEN 'upstream' WHEN sd > 0 AND sd <= 2000 THEN 'downstream' ELSE 'intergenic' END AS context, count(*) AS n FROM e GROUP BY 1",
    "json_props": "WITH e AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS k, max(k) AS top FROM e GROUP BY 1",
    "info_maps": "WITH c AS (SELECT id, max(type) AS type, max(len) AS len, max(filt) AS filt FROM sv_calls WHERE id IS NOT NULL GROUP BY id) SELECT id, 'PRECISE;SVLEN=' || coalesce(CAST(len AS VARCHAR), '.') || ';SVTYPE=' || coalesce(type, '.') AS info, len, coalesce(filt IN ('PASS', '.'), false) AS pass FROM c",
    "packed_arrays": "SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n, round(sum(l_quantity), 2) AS total, round(count(*) FILTER (l_quantity <= 10) / count(*), 9) AS low FROM lineitem GROUP BY 1",
    "longest_isoform": """WITH c AS (SELECT DISTINCT gene_id, transcript_id, least("left", "right") AS a, greatest("left", "right") AS b FROM gtf WHERE type = 'CDS' AND transcript_id IS NOT NULL AND gene_id IS NOT NULL AND "left" IS NOT NULL AND "right" IS NOT NULL), t AS (SELECT gene_id, transcript_id, CAST(sum(b - a + 1) AS BIGINT) AS bp FROM c GROUP BY 1, 2)
      SELECT gene_id, transcript_id, bp FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY bp DESC, transcript_id) AS rn FROM t) WHERE rn = 1""",
    "merge_identical": 'SELECT seq_id, type, "left" AS lo, "right" AS hi, strand, count(*) AS n, max(score) AS best FROM gtf WHERE seq_id IS NOT NULL AND type IS NOT NULL AND "left" IS NOT NULL AND "right" IS NOT NULL GROUP BY 1, 2, 3, 4, 5',
    "type_audit": "WITH a AS (SELECT type, count(*) AS a FROM gtf WHERE source = 'liftset' AND type IS NOT NULL GROUP BY 1), b AS (SELECT type, count(*) AS b FROM gtf WHERE source = 'weaver' AND type IS NOT NULL GROUP BY 1) SELECT type, a, b, round(a / b, 9) AS ratio FROM a LEFT JOIN b USING (type)",
    "annotation_coverage": "WITH g AS (SELECT * FROM gtf WHERE gene_id IS NOT NULL AND source IS NOT NULL), w AS (SELECT count(DISTINCT gene_id) AS n FROM g) SELECT source, count(DISTINCT gene_id) AS genes, greatest((SELECT n FROM w) - count(DISTINCT gene_id), 0) AS missing, round(count(DISTINCT gene_id) * 100.0::DOUBLE / (SELECT n FROM w), 9) AS pct FROM g GROUP BY source",
    "filter_funnel": "SELECT sample, count(*) AS raw, count(*) FILTER (filt = 'PASS') AS pass, count(*) FILTER (filt = 'PASS' AND len >= 50) AS long, count(*) FILTER (filt = 'PASS' AND len >= 50 AND qual >= 20) AS good FROM sv_calls GROUP BY 1",
    "length_sweep": "SELECT type, " + ", ".join(f"count(*) FILTER (len >= {n}) AS ge_{n}" for n in (0, 50, 100, 500, 1000, 5000, 10000, 20000)) + " FROM sv_calls WHERE type IS NOT NULL GROUP BY 1",
    "tumbling_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS win, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL",
    "session_windows": """WITH l AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM l)
      SELECT user_id, min(t) AS first_us, max(t) AS last_us, count(*) AS n FROM s GROUP BY user_id, k""",
    "first_seen": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS rn FROM events) WHERE rn = 1",
}
