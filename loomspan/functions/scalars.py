"""Scalar functions on sequences, intervals, names and numbers, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the standard genetic code in TCAG order
_BASES = "TCAG"
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Codon prefixes whose third base is free: all four codons give one amino acid.
FOURFOLD = tuple(a + b for i, a in enumerate(_BASES) for j, b in enumerate(_BASES) if len(set(_AMINO[16 * i + 4 * j : 16 * i + 4 * j + 4])) == 1)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), "ACGTN", "TGCAN"))


def insertion_sequence(ref: Column, alt: Column, least: int = 30) -> Column:
    """Inserted bases: ALT without the REF anchor, known letters only; null if shorter than ``least``."""
    body = F.when(F.startswith(F.upper(alt), F.upper(ref)), F.expr("1")).otherwise(0)
    rest = F.when(body == 1, F.substring(alt, F.length(ref) + 1, F.length(alt))).otherwise(alt)
    clean = F.regexp_replace(F.upper(rest), "[^ACGTN]", "")
    return F.when(F.length(clean) >= least, clean)


def breakend(alt: Column) -> tuple[Column, Column]:
    """(chromosome, position) of the mate in a breakend allele; null if there is none."""
    pat = r"[\[\]]([^:\[\]]+):(\d+)[\[\]]"
    return F.nullif(F.regexp_extract(alt, pat, 1), F.lit("")), F.regexp_extract(alt, pat, 2).try_cast("bigint")


def list_cell(cell: Column, sep: str = ",", prefix: str | None = None, suffix: str | None = None) -> Column:
    """Trimmed, non-empty entries of a list cell, without an optional prefix and suffix pattern."""

    def clean(x: Column) -> Column:
        x = F.trim(x)
        if prefix:
            x = F.regexp_replace(x, f"^(?:{prefix})", "")
        return F.regexp_replace(x, f"(?:{suffix})$", "") if suffix else x

    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), sep), clean), lambda x: x != "")


def parse_interval(text: Column) -> tuple[Column, Column, Column]:
    """(chromosome or null, start, end) of 'chr:a-b', 'chr:a..b' or 'a-b', thousands separators allowed."""
    t = F.regexp_replace(text, ",", "")
    pat = r"^(?:(.*):)?(\d+)(?:-|\.\.)(\d+)$"
    return F.nullif(F.regexp_extract(t, pat, 1), F.lit("")), F.regexp_extract(t, pat, 2).try_cast("bigint"), F.regexp_extract(t, pat, 3).try_cast("bigint")


def safe_int(text: Column) -> Column:
    """Integer part of a numeric text; null for anything else."""
    d = F.trim(text).try_cast("double")
    return F.when(~F.isnan(d), F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)).try_cast("bigint"))


def missing_to_null(text: Column, marks: tuple[str, ...] = ("", ".", "NA", "N", "nan", "None", "-")) -> Column:
    return F.when(~F.trim(text).isin(*marks), text)


def percent(part: Column, whole: Column) -> Column:
    """part * 100 / whole; 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def log2_ratio(a: Column, b: Column) -> Column:
    return F.log2(a + 1.0) - F.log2(b + 1.0)


def distance_bin(signed: Column, in_gene: Column | None = None, width: int = 500, most: int = 5000) -> Column:
    """struct(label, center) of a signed distance: bins of ``width`` going down to minus infinity, tails
    beyond +-most (a distance of just ``most`` is in the bin that starts there). Rows in a gene are
    'Gene' with center 0; an unknown distance is in the upper tail."""
    low = (F.floor(signed / width) * width).cast("bigint")
    kilo = lambda x: F.concat(F.regexp_replace((x / F.lit(1000.0)).cast("string"), r"\.0$", ""), F.lit("k"))
    over = F.struct(F.lit(f">{most // 1000}k").alias("label"), F.lit(most + width).cast("bigint").alias("center"))
    under = F.struct(F.lit(f"<-{most // 1000}k").alias("label"), F.lit(-most - width).cast("bigint").alias("center"))
    inner = F.struct(F.concat(kilo(low), F.lit("~"), kilo(low + width)).alias("label"), (low + width // 2).alias("center"))
    out = F.when(signed.isNull() | (signed > most), over).when(signed < -most, under).otherwise(inner)
    if in_gene is None:
        return out
    return F.when(in_gene, F.struct(F.lit("Gene").alias("label"), F.lit(0).cast("bigint").alias("center"))).otherwise(out)


def gene_context(in_exon: Column, in_gene: Column, signed: Column, flank: int = 2000) -> Column:
    """exon, intron, upstream, downstream or intergenic."""
    return F.when(in_exon, "exon").when(in_gene, "intron").when((signed < 0) & (signed >= -flank), "upstream").when((signed > 0) & (signed <= flank), "downstream").otherwise("intergenic")


def length_bin(length: Column, width: int = 1000, tail: int = 10_000) -> Column:
    """(lo, hi] bins by their upper edge; one bin above ``tail``."""
    return F.when(length > tail, F.lit(tail + width)).otherwise(F.ceil(length / width) * width).cast("bigint")


# --- fixed values: size classes of variants
SIZE_CLASSES = ("50-499", "500-4999", ">=5000")


def size_class(length: Column) -> Column:
    """Class of an absolute length; null below 50."""
    n = F.abs(length)
    return F.when(n >= 5000, SIZE_CLASSES[2]).when(n >= 500, SIZE_CLASSES[1]).when(n >= 50, SIZE_CLASSES[0])


def te_broad(feature: Column, classification: Column) -> Column:
    """Six broad classes of a repeat, for sweeps by priority."""
    c, f = F.trim(F.coalesce(classification, F.lit(""))), F.trim(F.coalesce(feature, F.lit("")))
    low = F.lower(F.concat(c, F.lit(" "), f))
    return (
        F.when((c == "LTR/Copia") | low.contains("copia_ltr_retrotransposon"), "LTR/Copia")
        .when((c == "LTR/Gypsy") | low.contains("gypsy_ltr_retrotransposon"), "LTR/Gypsy")
        .when((c == "LTR/unknown") | (c.startswith("LTR/") & F.lower(c).endswith("/unknown")) | (f == "LTR_retrotransposon"), "LTR/unknown")
        .when(low.contains("helitron"), "Helitron")
        .when(c.startswith("DNA/") | c.startswith("MITE/") | low.contains("tir_transposon") | low.contains("terminal_inverted_repeat"), "DNA transposons")
        .otherwise("Other / unclassified")
    )


def te_of_text(text: Column) -> Column:
    """LTR, DNA or Other_TE from any text of an annotation row."""
    t = F.lower(text)
    return F.when(t.contains("ltr"), "LTR").when(t.contains("helitron") | t.contains("tir") | t.contains("mite") | t.contains("/dt") | t.contains("dna"), "DNA").otherwise("Other_TE")


def te_composition(feature: Column, classification: Column) -> Column:
    """Classes of the composition of a region; null for what doesn't count."""
    c = F.coalesce(F.nullif(classification, F.lit("")), F.lit("unknown"))
    return (
        F.when(c.startswith("LTR/Gypsy"), "LTR/Gypsy")
        .when(c.startswith("LTR/Copia"), "LTR/Copia")
        .when(c.startswith("LTR/"), "LTR unknown")
        .when(c.startswith("SINE"), "SINEs")
        .when(c.startswith("DNA/") | c.startswith("MITE/") | (F.coalesce(feature, F.lit("")) == "helitron"), "DNA transposons")
        .when((c == "unknown") | F.coalesce(feature, F.lit("")).isin("repeat_fragment", "repeat_region"), "Unclassified TE")
    )


def te_subtype(classification: Column, order: Column, clade: Column, superfamily: Column, unknown: tuple[str, ...] = ("", "?", "na", "nan", "none", "unknown", "unclassified")) -> Column:
    """struct(subtype, major) from an annotation's class and, where a row of the domain-based classifier
    exists (``order`` not null), its clade and superfamily."""
    c = F.coalesce(F.nullif(classification, F.lit("")), F.lit("Unknown"))
    row, ltr = order.isNotNull(), F.lit("LTR-RT")
    major = F.split_part(c, F.lit("/"), F.lit(1))
    sub = (
        F.when(row & (F.lower(order) == "ltr"), F.when(~F.lower(F.trim(clade)).isin(list(unknown)), F.trim(clade)).when(F.lower(F.trim(superfamily)).isin("copia", "gypsy"), "Unclassified LTR-RTs").otherwise("Unknown"))
        .when(c.startswith("LTR/"), F.when(row, "Unclassified LTR-RTs").when(F.lower(c) == "ltr/unknown", "Unknown").otherwise("Unclassified LTR-RTs"))
        .when(c.contains("/"), F.regexp_replace(c, "^[^/]*/", ""))
        .otherwise(c)
    )
    return F.struct(sub.alias("subtype"), F.when((row & (F.lower(order) == "ltr")) | c.startswith("LTR/"), ltr).otherwise(major).alias("major"))


def te_major(classification: Column, feature: Column) -> Column:
    """Major class: what stands in front of the slash, else by name."""
    c = F.coalesce(F.nullif(classification, F.lit("")), F.nullif(feature, F.lit("")), F.lit("unknown"))
    out = c
    for name in ("Helitron", "LINE", "TIR", "LTR"):
        out = F.when(c.contains(name), F.lit(name)).otherwise(out)
    return F.when(c.contains("/"), F.split_part(c, F.lit("/"), F.lit(1))).otherwise(out)


def family_name(name: Column) -> Column:
    """A name without its trailing digits."""
    return F.regexp_extract(name, r"^(.*?)\d*$", 1)


def strip_prefix(name: Column, prefixes: list[str]) -> Column:
    return F.regexp_replace(name, "^(?:" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")", "")


def canonical_labels(cell: Column, aliases: dict[str, str], drop: list[str], sep: str = ",") -> Column:
    """Distinct sample labels of a list cell in order, aliases resolved, dropped ones left out."""
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    table = F.create_map(*pairs) if pairs else None
    tokens = list_cell(cell, sep)
    mapped = F.transform(tokens, lambda x: F.coalesce(F.element_at(table, x), x)) if pairs else tokens
    return F.array_distinct(F.filter(mapped, lambda x: ~x.isin(*drop)) if drop else mapped)


def ltr_age(identity: Column, rate: float = 1.3e-8, jukes_cantor: bool = False) -> Column:
    """Insertion time in Myr from the identity of two repeats; null where Jukes-Cantor saturates."""
    d = 1.0 - identity
    k = F.when(d < 0.74, -0.75 * F.ln(1.0 - 4.0 * d / 3.0)) if jukes_cantor else d
    return k / (2 * rate) / 1e6


def age_from_k(k: Column, rate: float = 5.1e-9) -> Column:
    return k / (2 * rate) / 1e6


def codons(seq: Column) -> Column:
    return F.regexp_extract_all(F.upper(seq), F.lit("(...)"), 1)


def codon_positions_12(seq: Column) -> Column:
    """First and second codon positions; an incomplete last codon stays."""
    return F.regexp_replace(seq, "(..).", "$1")


def fourfold_sites(seq: Column) -> Column:
    """Third bases of the codons in which they are free."""
    kept = F.filter(codons(seq), lambda c: F.substring(c, 1, 2).isin(*FOURFOLD) & F.substring(c, 3, 1).isin("A", "C", "G", "T"))
    return F.array_join(F.transform(kept, lambda c: F.substring(c, 3, 1)), "")


def translate_codons(seq: Column) -> Column:
    """Amino acids by the standard code; X for a codon with an unknown base."""
    table = {a + b + c: _AMINO[16 * i + 4 * j + k] for i, a in enumerate(_BASES) for j, b in enumerate(_BASES) for k, c in enumerate(_BASES)}
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.array_join(F.transform(codons(seq), lambda c: F.coalesce(F.try_element_at(m, c), F.lit("X"))), "")


def sub_sequence(seq: Column, start: Column, end: Column, strand: Column) -> Column:
    """Bases of a half-open interval, reverse complemented on '-'."""
    part = F.substring(seq, start.cast("int") + 1, (end - start).cast("int"))
    return F.when(strand == "-", reverse_complement(part)).otherwise(part)


def gap_fraction(seq: Column) -> Column:
    return F.try_divide(F.length(seq) - F.length(F.replace(seq, F.lit("-"), F.lit(""))), F.length(seq))


def p_stars(p: Column) -> Column:
    return F.when(p.isNull(), "NA").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def relative_position(pos: Column, start: Column, end: Column) -> Column:
    """'within' (both ends count), or the side and the distance in Mb."""
    side = lambda name, d: F.format_string(f"{name} %.2f Mb", (d / 1e6).cast("double"))
    return F.when(pos < start, side("left", start - pos)).when(pos > end, side("right", pos - end)).otherwise("within")


def info_map(info: Column) -> Column:
    """Map of a k=v;FLAG cell; a flag has a null value."""
    return F.str_to_map(F.regexp_replace(info, ";+$", ""), F.lit(";"), F.lit("="))


def info_text(info: Column) -> Column:
    """The cell in a fixed order: flags first, then keys, both sorted."""
    entries = F.map_entries(info_map(info))
    flags = F.array_sort(F.transform(F.filter(entries, lambda e: e["value"].isNull()), lambda e: e["key"]))
    pairs = F.array_sort(F.transform(F.filter(entries, lambda e: e["value"].isNotNull()), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.array_join(F.concat(flags, pairs), ";")


def evidence_rule(aa: Column, sources: Column, expressed: Column, protein: Column, general: Column) -> Column:
    """The first rule that supports a gene model, or null."""
    return (
        F.when((aa >= 100) & (sources >= 2), "two_sources")
        .when((aa >= 200) & (expressed | protein), "long_with_evidence")
        .when((aa >= 500) & general, "very_long")
        .when((aa >= 50) & expressed & protein, "short_with_both")
    )


def read_confidence(confidence: Column, support: Column) -> Column:
    """Final label of an event found in reads, from its confidence and its number of assembly calls."""
    own = F.coalesce(F.nullif(confidence, F.lit("")), F.lit("."))
    return F.when((support > 0) & (own == "high"), "high_read_svgap_supported").when(support > 0, "medium_read_svgap_supported").otherwise(own)


def assembly_confidence(svtype: Column, support: Column) -> Column:
    """Final label of an event that only assemblies show, from its type and number of samples."""
    return F.when(svtype.isin("DEL", "INS") & (support >= 2), "medium_svgap_combined").when(svtype.isin("CNV", "INV", "TRL"), "medium_svgap_only").otherwise("low_svgap_only")


def trim_core(start: Column, end: Column, cut: int) -> tuple[Column, Column]:
    """An exon without ``cut`` bases on both sides (closed); one that is too short keeps its middle codon."""
    n = end - start + 1
    mid = start + F.floor((n - 3) / 2)
    short = n < 2 * cut + 3
    return F.when(short, mid).otherwise(start + cut), F.when(short, mid + 2).otherwise(end - cut)


def translocation_type(svtype: Column) -> Column:
    return F.when(svtype.isin("BND", "TRA"), "TRA").otherwise(svtype)


def passes(filt: Column) -> Column:
    return F.coalesce(filt.isin("PASS", "."), F.lit(False))


def command_text(template: str) -> Column:
    """A text from a template with columns in braces, as in 'run -i {file} -o {sample}.out'; a null column is empty."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))
