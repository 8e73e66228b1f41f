"""Regions, genes, variants, text sources, scalar functions, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.adapters.driver_tables import load, view, view_sql
from crestline.catalog.common import READS, SIGNAL, TOTALS, experiment, q4, r4, rounded, with_parts
from crestline.functions import regions as rg
from crestline.functions import stats as st
from crestline.operators import genes as gn
from crestline.operators import variants as vr
from crestline.operators.overlap import count_overlaps, not_overlapping, overlap_join, overlapping
from crestline.operators.running import position_in_group, tile_of
from crestline.operators.tags import downsample, pile_tags
from crestline.session import stage
from crestline.sources import text as tx

TAG = 50


# --- regions --------------------------------------------------------------------


def _tag_blocks(spark: SparkSession, sf: str) -> DataFrame:
    piled = pile_tags(view(spark, sf, "reads"), ["chrom", "pos"])
    return piled.select("chrom", F.col("pos").alias("start"), (F.col("pos") + TAG - 1).alias("stop"), "n")


def overlap_all(spark: SparkSession, sf: str) -> DataFrame:
    left = _tag_blocks(spark, sf).withColumnsRenamed({"start": "l_start", "stop": "l_stop"})
    right = view(spark, sf, "regions").withColumnsRenamed({"start": "r_start", "stop": "r_stop"})
    return overlap_join(left, right).select("chrom", "l_start", "l_stop", "n", "payload")


def overlap_count(spark: SparkSession, sf: str) -> DataFrame:
    return count_overlaps(_tag_blocks(spark, sf), view(spark, sf, "regions"))


def region_semi(spark: SparkSession, sf: str) -> DataFrame:
    return overlapping(view(spark, sf, "regions"), _tag_blocks(spark, sf))


def region_anti(spark: SparkSession, sf: str) -> DataFrame:
    return not_overlapping(_tag_blocks(spark, sf), view(spark, sf, "regions")).select("chrom", "start", "stop")


def common_contigs(spark: SparkSession, sf: str) -> DataFrame:
    """Contigs both samples have, within a whitelist."""
    reads = view(spark, sf, "reads").where(F.col("chrom").isin("chr1", "chr2", "chr4", "chrX"))
    treat = reads.where("sample = 'T'").select("chrom")
    return treat.intersect(reads.where("sample = 'C'").select("chrom"))


def region_parse(spark: SparkSession, sf: str) -> DataFrame:
    thousands = F.format_number(F.col("start") + 1, 0)
    text = (
        F.when(F.col("payload") % 3 == 0, F.concat("chrom", F.lit(":"), thousands, F.lit("-"), F.col("stop").cast("string")))
        .when(F.col("payload") % 3 == 1, F.concat("chrom", F.lit(":"), thousands))
        .otherwise(F.col("chrom"))
    )
    rows = view(spark, sf, "regions").select("payload", rg.parse_region(text).alias("r"))
    return rows.select("payload", "r.chrom", "r.beg", "r.stop")


def region_bins(spark: SparkSession, sf: str) -> DataFrame:
    wide = F.when(F.col("payload") % 4 == 0, F.col("stop") + 300_000).otherwise(F.col("stop"))
    return view(spark, sf, "regions").select("payload", rg.region_bin(F.col("start"), wide).alias("bin"))


def range_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Every bin that a query on the region has to look into."""
    wide = F.when(F.col("payload") % 4 == 0, F.col("stop") + 300_000).otherwise(F.col("stop"))
    bins = rg.bins_over(F.col("start"), wide)
    return view(spark, sf, "regions").select("payload", F.explode(bins).alias("bin"))


# --- text sources ------------------------------------------------------------------


def bed_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "regions")
    lines = rows.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("stop").cast("string"), F.col("payload").cast("string")).alias("value"))
    return tx.parse_bed(lines)


def tab_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "regions")
    end = F.when(F.col("payload") % 2 == 0, F.col("stop").cast("string"))
    lines = rows.select(F.concat_ws("\t", "chrom", (F.col("start") + 1).cast("string"), end).alias("value"))
    return tx.parse_tab(lines)


def gtf_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "exons")
    strand = F.when(F.col("strand") == 0, "+").otherwise("-")
    attributes = F.concat(F.lit('gene_id "g'), F.col("gene").cast("string"), F.lit('"; transcript_id "t";'))
    kind = F.when(F.col("type") == "CDS", "CDS").when(F.col("type") == "UTR5", "exon").otherwise("start_codon")
    lines = rows.select(
        F.concat_ws("\t", "chrom", F.lit("src"), kind, F.col("start").cast("string"), F.col("stop").cast("string"), F.lit("."), strand, F.lit("."), attributes).alias("value")
    )
    return tx.parse_gtf(lines)


def vcf_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "variants")
    sites = rows.select(
        "chrom",
        "pos",
        F.col("vid").cast("string").alias("id"),
        "ref",
        F.array("alt").alias("alts"),
        "qual",
        F.split("filter", ";").alias("filters"),
        F.str_to_map("info", F.lit(";"), F.lit("=")).alias("info"),
        F.array(F.lit("GT:DP"), F.concat(F.lit("0/1:"), F.col("qual").cast("string"))).alias("genotypes"),
    )
    parsed = tx.parse_vcf(tx.vcf_lines(sites))
    return parsed.select(
        "chrom",
        "pos",
        F.col("id").cast("long").alias("vid"),
        "ref",
        F.array_join("alts", ",").alias("alt"),
        F.col("qual").cast("int").alias("qual"),
        F.size("filters").alias("n_filters"),
        tx.info_int(F.col("info"), "DP").alias("dp"),
        r4(tx.info_float(F.col("info"), "AF")).alias("af"),
        tx.info_flag(F.col("info"), "DB").alias("db"),
        tx.format_value(parsed, 0, "DP").cast("int").alias("sample_dp"),
    )


def info_edit(spark: SparkSession, sf: str) -> DataFrame:
    """Set one INFO key, delete another, add and remove filters."""
    rows = view(spark, sf, "variants")
    info = F.str_to_map("info", F.lit(";"), F.lit("="))
    edited = tx.delete_info(tx.set_info(info, "DP", F.col("qual") * 2), "AF")
    filters = F.split("filter", ";")
    return rows.select(
        "vid",
        tx.info_int(edited, "DP").alias("dp"),
        tx.info_flag(edited, "AF").alias("has_af"),
        tx.info_flag(edited, "DB").alias("db"),
        F.array_join(tx.add_filter(filters, "low"), ";").alias("added"),
        F.array_join(tx.remove_filter(filters, "q10"), ";").alias("removed"),
    )


def site_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Place of each site in a forward and in a backward pass over its contig."""
    rows = view(spark, sf, "variants").select("chrom", "pos", "vid").withColumn("tile", tile_of("pos", 12))
    forward = position_in_group(rows, ["chrom"], ["pos", "vid"], ["tile"], "forward")
    sizes = rows.groupBy("chrom").agg(F.count(F.lit(1)).alias("size"))
    both = forward.join(sizes, "chrom")
    return both.select("chrom", "pos", "vid", "forward", (F.col("size") - F.col("forward") + 1).alias("backward"))


def candidate_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate table lines, with heading and comment, read back."""
    rows = view(spark, sf, "regions")
    line = F.concat_ws(
        "\t", "chrom", F.col("start").cast("string"), F.col("stop").cast("string"), F.col("payload").cast("string"), F.lit("2.5"), F.lit("0")
    )
    # every line comes with a heading and a comment, which the reader leaves out
    heading = F.array(F.lit("chrom\tstar\tend\tpeakID\tpileup\tpscore"), F.lit("# comment"), F.lit(""), line)
    return tx.parse_candidates(rows.select(F.explode(heading).alias("value")))


def list_items(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part")
    items = tx.list_items(F.concat(F.lit(","), F.translate("p_name", " ", ","), F.lit(",,"), F.col("p_brand")))
    return part.select(F.explode(items).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def sequence_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """The middle half of every document, from its chunks."""
    docs = load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("seq"))
    chunks = tx.chunk_sequences(docs, 1000)
    ranges = tx.sequence_lengths(chunks).select(
        "name", F.floor(F.col("length") / 4).alias("beg"), F.floor(F.col("length") * 3 / 4).alias("stop")
    )
    return tx.fetch_sequence(chunks, ranges, 1000)


# --- genes ---------------------------------------------------------------------------


def introns(spark: SparkSession, sf: str) -> DataFrame:
    return gn.introns(view(spark, sf, "exons"))


def merged_exons(spark: SparkSession, sf: str) -> DataFrame:
    return gn.merge_exons(view(spark, sf, "exons"))


def gene_flanks(spark: SparkSession, sf: str) -> DataFrame:
    return gn.flanks(view(spark, sf, "exons"))


def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return gn.percentile_positions(view(spark, sf, "exons"))


def annotation(spark: SparkSession, sf: str) -> DataFrame:
    exons = stage(view(spark, sf, "exons"), "exons")
    # nearly all rows differ, so they are not grouped before the shuffle
    columns = ["gene", "chrom", "strand", "type", "start", "stop"]
    named = exons.select(*columns).repartition(*columns).distinct()
    other = gn.introns(exons).withColumn("type", F.lit("INTRON")).unionByName(gn.flanks(exons))
    blocks = pile_tags(view(spark, sf, "reads"), ["chrom", "strand", "pos"]).select(
        "chrom", "strand", F.col("pos").alias("l_start"), (F.col("pos") + TAG - 1).alias("l_stop")
    )
    return gn.annotate(blocks, named.unionByName(other))


# --- variants ------------------------------------------------------------------------


def variant_types(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "variants")
    kind = vr.variant_type(F.col("ref"), F.col("alt"))
    return rows.select("vid", "ref", "alt", kind["type"].alias("type"), kind["size"].alias("size"))


def site_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Sites that pass a filter name test, inside a set of target regions."""
    sites = view(spark, sf, "variants").withColumn("filters", F.split("filter", ";"))
    kept = sites.where(F.array_contains("filters", "q10") | F.array_contains("filters", "PASS"))
    spans = kept.select("vid", "chrom", (F.col("pos") - 1).alias("start"), (F.col("pos") - 2 + F.length("ref")).alias("stop"))
    return overlapping(spans, view(spark, sf, "regions"))


def _call_sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf, "variants").withColumn("pos", F.col("pos") % 200)
    # two callers: the low-quality and the high-quality sites
    return rows.where("qual <= 25"), rows.where("qual > 25")


def _merge(policy: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        a, b = _call_sets(spark, sf)
        return vr.merge_sites(a, b, policy, ["ref", "alt", "vid"])

    return query


_GENOTYPES = "array(array(vid % 3, qual % 2), array(qual % 3, qual % 3), array(vid % 4 - 1))"


def genotypes(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "variants").withColumn("gt", F.expr(_GENOTYPES))
    counts = vr.allele_counts(F.col("gt"), F.lit(3))
    rows = rows.withColumn("ac", counts)
    return rows.select(
        "vid",
        *[F.col("ac")[i].alias(f"ac{i}") for i in range(3)],
        *[vr.genotype_class(F.col("gt")[i]).alias(f"class{i}") for i in range(3)],
        F.array_join(F.transform(vr.used_alleles(F.col("ac")), lambda x: x.cast("string")), ",").alias("used"),
    )


# --- scalar functions over tables --------------------------------------------------------


def round_top(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events")
    shifted = F.col("value") - 100.0
    return events.select("event_id", *[st.round_top(shifted / 7.0, k).alias(f"r{k}") for k in (0, 2, 5)])


def chi_square(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").withColumn("x", F.col("value") / 10.0)
    return events.select(
        "event_id",
        r4(st.chi2_log10_upper(F.col("x"), 2)).alias("k2"),
        r4(st.chi2_log10_upper(F.col("x"), 4)).alias("k4"),
        r4(st.chi2_upper(F.col("x"), 4)).alias("p4"),
        r4(st.chi2_upper(F.col("x"), 1)).alias("p1"),
    )


def gamma_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Log-gamma, and the lower incomplete gamma over the whole range of values."""
    events = load(spark, sf, "events")
    a, x = (F.col("user_id") % 500 + 1).cast("double"), F.col("value")
    return events.select("event_id", r4(st.lgamma(F.col("value") + 1.0)).alias("lg"), r4(st.gamma_p(a, x)).alias("gp"))


def upper_gamma(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events")
    a = (F.col("user_id") % 300 + 1).cast("double")
    return events.select("event_id", r4(st.gamma_q(a, F.col("value") * 3.0)).alias("gq"))


def error_functions(spark: SparkSession, sf: str) -> DataFrame:
    z = (F.col("value") - 50.0) / 40.0
    return load(spark, sf, "events").select("event_id", r4(st.erf(z)).alias("erf"), r4(st.erfc(z)).alias("erfc"))


def incomplete_beta(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("user_id") % 40 + 1, F.col("event_id") % 30 + 1
    return load(spark, sf, "events").select("event_id", r4(st.beta_i(a, b, F.col("value") / (F.col("value") + 60.0))).alias("ib"))


def fisher(spark: SparkSession, sf: str) -> DataFrame:
    """Association of brand and type, from the counts of parts."""
    part = load(spark, sf, "part")
    cells = part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    brands = part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("nb"))
    types = part.groupBy("p_type").agg(F.count(F.lit(1)).alias("nt"))
    total = part.agg(F.count(F.lit(1))).scalar()
    rows = cells.join(brands, "p_brand").join(types, "p_type").withColumn("total", total)
    n11, n12, n21 = F.col("n"), F.col("nb") - F.col("n"), F.col("nt") - F.col("n")
    n22 = F.col("total") - F.col("nb") - F.col("nt") + F.col("n")
    tests = rows.select("p_brand", "p_type", st.fisher_exact(*[c.cast("int") for c in (n11, n12, n21, n22)]).alias("f"))
    return tests.select("p_brand", "p_type", *[r4(f"f.{c}").alias(c) for c in ("left_p", "right_p", "two_tail_p")])


def max_dup(spark: SparkSession, sf: str) -> DataFrame:
    """Copies per position that chance explains, for each library."""
    ex = experiment(spark, sf)
    totals = ex.tracks.groupBy("sample").agg(F.sum(F.col("n_unique") + F.col("multi_reads")).alias("total"))
    return totals.select("sample", "total", st.max_duplicates_of(ex.options.genome_size, F.col("total")).alias("max_dup"))


def base_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Reverse complement and the sum of four-bit base codes of each read."""
    rows = view(spark, sf, "alignments")
    # Base letters in the order of their four-bit codes, and their complements.
    letters, plain, paired = "=ACMGRSVTWYHKDBN", "ACGTN", "TGCAN"
    codes = F.transform(F.split("seq", ""), lambda c: F.instr(F.lit(letters), c) - 1)
    return rows.select(
        "qname", F.translate(F.reverse("seq"), plain, paired).alias("revcomp"), F.aggregate(codes, F.lit(0), lambda a, c: a + c).alias("code_sum")
    )


def downsampled(spark: SparkSession, sf: str) -> DataFrame:
    """Tags left per sample, contig and strand after drawing three tenths."""
    kept = downsample(view(spark, sf, "reads"), 0.3, 7)
    return kept.groupBy("sample", "chrom", "strand").agg(F.count(F.lit(1)).alias("n"))


# error function of z >= 0: a series of positive terms, one from six on
_ERF = (
    "(CASE WHEN {z} > 6 THEN 1e0 WHEN {z} <= 0 THEN 0e0 ELSE 2e0 / sqrt(pi()) * list_sum(list_transform(range(0, 250), lambda n:"
    " exp(2e0 * n * ln(2e0) + (2e0 * n + 1e0) * ln({z}) - {z} * {z} + lgamma(n + 1e0) - lgamma(2e0 * n + 2e0)))) END)"
)

QUERIES = {
    "j7_overlap_all": overlap_all,
    "j7_overlap_count": overlap_count,
    "j13_region_semi": region_semi,
    "u6_region_anti": region_anti,
    "j12_common_contigs": common_contigs,
    "s19_region_parse": region_parse,
    "s20_region_bin": region_bins,
    "s20_range_bins": range_bins,
    "a13_bed_lines": bed_lines,
    "a13_tab_lines": tab_lines,
    "a8_gtf_lines": gtf_lines,
    "a9_vcf_round_trip": vcf_round_trip,
    "s21_info_edit": info_edit,
    "t4_site_passes": site_ranks,
    "a7_candidate_lines": candidate_lines,
    "a14_list_items": list_items,
    "a12_sequence_fetch": sequence_fetch,
    "w14_introns": introns,
    "w14_merged_exons": merged_exons,
    "w14_flanks": gene_flanks,
    "w15_percentiles": percentiles,
    "j15_annotate": annotation,
    "s18_variant_type": variant_types,
    "p20_site_filter": site_filter,
    "j14_merge_none": _merge("none"),
    "j14_merge_snps": _merge("snps"),
    "j14_merge_any": _merge("any"),
    "g20_genotypes": genotypes,
    "s4_round_top": round_top,
    "s9_chi_square": chi_square,
    "s16_gamma": gamma_functions,
    "s16_gamma_q": upper_gamma,
    "s16_erfc": error_functions,
    "s16_beta": incomplete_beta,
    "s17_fisher": fisher,
    "s6_max_dup": max_dup,
    "s22_base_codes": base_codes,
    "o5_downsample": downsampled,
}

REGIONS = [("regions", view_sql("regions"))]
BLOCKS = [*READS, ("blocks", f"SELECT chrom, pos AS start, pos + {TAG - 1} AS stop, count(*) AS n FROM reads GROUP BY ALL"), *REGIONS]
EXONS = [("exons", view_sql("exons"))]
VARIANTS = [("variants", view_sql("variants"))]
_HIT = "b.chrom = r.chrom AND b.stop >= r.start AND b.start <= r.stop"

_MERGED = [
    *EXONS,
    (
        "reached",
        "SELECT gene, chrom, strand, start, stop, max(stop) OVER (PARTITION BY gene ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM exons",
    ),
    (
        "numbered",
        "SELECT *, sum(CASE WHEN start <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY gene ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS grp FROM reached",
    ),
    (
        "merged",
        "SELECT gene, chrom, strand, min(start) AS start, max(stop) AS stop FROM numbered GROUP BY gene, chrom, strand, grp",
    ),
    (
        "introns",
        "SELECT gene, chrom, strand, before + 1 AS start, start - 1 AS stop FROM (SELECT *, lag(stop) OVER (PARTITION BY gene ORDER BY start) AS before FROM merged) WHERE before IS NOT NULL",
    ),
    ("span", "SELECT gene, chrom, strand, min(start) AS a, max(stop) AS b FROM exons GROUP BY ALL"),
    (
        "flanks",
        "SELECT gene, chrom, strand, CASE WHEN strand = 0 THEN 'ITGUP1K' ELSE 'ITGDN1K' END AS type, greatest(a - 1000, 0) AS start, greatest(a - 1, 0) AS stop FROM span"
        " UNION ALL SELECT gene, chrom, strand, CASE WHEN strand = 0 THEN 'ITGDN1K' ELSE 'ITGUP1K' END, b + 1, b + 1000 FROM span",
    ),
]
_PREFIX = "len(list_filter(range(1, least(length({0}), length({1})) + 1), lambda i: substring({0}, 1, i) = substring({1}, 1, i)))"
_TYPES = [
    *VARIANTS,
    ("t1", f"SELECT *, {_PREFIX.format('ref', 'alt')} AS lead FROM variants"),
    ("t2", "SELECT *, substring(ref, lead + 1) AS rr, substring(alt, lead + 1) AS aa FROM t1"),
    (
        "t3",
        "SELECT *, CASE WHEN length(rr) > 1 AND length(aa) > 1 THEN least(len(list_filter(range(1, least(length(rr), length(aa)) + 1),"
        " lambda i: right(rr, i) = right(aa, i))), least(length(rr), length(aa)) - 1) ELSE 0 END AS trail FROM t2",
    ),
    ("t4", "SELECT *, left(rr, length(rr) - trail) AS x, left(aa, length(aa) - trail) AS y FROM t3"),
    (
        "typed",
        "SELECT chrom, pos, vid, qual, ref, alt, CASE WHEN rr = '' AND aa = '' THEN 'REF' WHEN rr = '' OR aa = '' THEN 'INDEL' WHEN length(x) = 1 AND length(y) = 1 THEN 'SNP'"
        " WHEN (length(x) = 1 OR length(y) = 1) AND right(x, 1) = right(y, 1) THEN 'INDEL' WHEN length(x) = 1 OR length(y) = 1 THEN 'OTHER'"
        " WHEN length(x) = length(y) THEN 'MNP' ELSE 'OTHER' END AS type,"
        " CAST(CASE WHEN rr = '' AND aa = '' THEN 0 WHEN rr = '' OR aa = '' THEN length(aa) - length(rr) WHEN length(x) = 1 AND length(y) = 1 THEN 1"
        " WHEN length(x) = 1 OR length(y) = 1 THEN length(y) - length(x) WHEN length(x) > length(y) THEN -length(x) ELSE length(y) END AS INT) AS size FROM t4",
    ),
]


def _merge_sql(match: str) -> str:
    return with_parts(
        [
            *_TYPES,
            ("sets", f"SELECT CASE WHEN qual <= 25 THEN 0 ELSE 1 END AS side, chrom, pos % 200 AS pos, ref, alt, vid, {match} AS match FROM typed"),
            ("r", "SELECT *, row_number() OVER (PARTITION BY side, chrom, pos, match ORDER BY ref, alt, vid) AS rn FROM sets"),
        ],
        "SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.pos, b.pos) AS pos, coalesce(a.match, b.match) AS match,"
        " a.ref AS ref_1, a.alt AS alt_1, a.vid AS vid_1, b.ref AS ref_2, b.alt AS alt_2, b.vid AS vid_2"
        " FROM (SELECT * FROM r WHERE side = 0) a FULL JOIN (SELECT * FROM r WHERE side = 1) b"
        " ON a.chrom = b.chrom AND a.pos = b.pos AND a.match = b.match AND a.rn = b.rn",
    )


def _class_sql(alleles: str) -> str:
    known = f"list_filter({alleles}, lambda x: x >= 0)"
    alts = f"len(list_distinct(list_filter({alleles}, lambda x: x > 0)))"
    ref = f"list_contains({alleles}, 0)"
    return (
        f"CASE WHEN len({known}) = 0 THEN 'UNKN' WHEN len({known}) = 1 THEN CASE WHEN {ref} THEN 'HAPL_R' ELSE 'HAPL_A' END"
        f" WHEN NOT {ref} THEN CASE WHEN {alts} = 1 THEN 'HOM_AA' ELSE 'HET_AA' END WHEN {alts} = 0 THEN 'HOM_RR' ELSE 'HET_RA' END"
    )


_GT = ["[vid % 3, CAST(qual % 2 AS BIGINT)]", "[CAST(qual % 3 AS BIGINT), CAST(qual % 3 AS BIGINT)]", "[vid % 4 - 1]"]
_LCHOOSE = "lgamma({0} + 1e0) - lgamma({1} + 1e0) - lgamma({0} - {1} + 1e0)"
_MASS = f"exp({_LCHOOSE.format('nb', '{0}')} + {_LCHOOSE.format('(total - nb)', '(nt - {0})')} - ({_LCHOOSE.format('total', 'nt')}))"

ORACLE = {
    "j7_overlap_all": with_parts(BLOCKS, f"SELECT b.chrom, b.start AS l_start, b.stop AS l_stop, n, payload FROM blocks b JOIN regions r ON {_HIT}"),
    "j7_overlap_count": with_parts(
        BLOCKS,
        f"SELECT b.chrom, b.start, b.stop, b.n, count(r.payload) AS n_overlap FROM blocks b LEFT JOIN regions r ON {_HIT} GROUP BY ALL",
    ),
    "j13_region_semi": with_parts(BLOCKS, f"SELECT * FROM regions r WHERE EXISTS (SELECT 1 FROM blocks b WHERE {_HIT})"),
    "u6_region_anti": with_parts(BLOCKS, f"SELECT chrom, start, stop FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE {_HIT})"),
    "j12_common_contigs": with_parts(
        READS,
        "SELECT chrom FROM reads WHERE sample = 'T' AND chrom IN ('chr1', 'chr2', 'chr4', 'chrX') INTERSECT SELECT chrom FROM reads WHERE sample = 'C'",
    ),
    "s19_region_parse": with_parts(
        REGIONS,
        "SELECT payload, chrom, CASE WHEN payload % 3 = 2 THEN 0 ELSE start END AS beg, CASE WHEN payload % 3 = 0 THEN stop ELSE 2147483647 END AS stop FROM regions",
    ),
    "s20_region_bin": with_parts(
        [*REGIONS, ("w", "SELECT payload, start AS b, CASE WHEN payload % 4 = 0 THEN stop + 300000 ELSE stop END - 1 AS e FROM regions")],
        "SELECT payload, CAST(CASE "
        + " ".join(f"WHEN b >> {s} = e >> {s} THEN {(8**d - 1) // 7} + (b >> {s})" for d, s in ((5, 14), (4, 17), (3, 20), (2, 23), (1, 26)))
        + " ELSE 0 END AS INT) AS bin FROM w",
    ),
    "s20_range_bins": with_parts(
        [*REGIONS, ("w", "SELECT payload, start AS b, CASE WHEN payload % 4 = 0 THEN stop + 300000 ELSE stop END - 1 AS e FROM regions")],
        "SELECT payload, CAST(0 AS INT) AS bin FROM w"
        + "".join(
            f" UNION ALL SELECT payload, CAST({(8**d - 1) // 7} + unnest(range(b >> {s}, (e >> {s}) + 1)) AS INT) FROM w"
            for d, s in ((5, 14), (4, 17), (3, 20), (2, 23), (1, 26))
        ),
    ),
    "a13_bed_lines": with_parts(REGIONS, "SELECT chrom, start, stop - 1 AS stop, CAST(payload AS VARCHAR) AS payload FROM regions"),
    "a13_tab_lines": with_parts(REGIONS, "SELECT chrom, start, CASE WHEN payload % 2 = 0 THEN stop - 1 ELSE start END AS stop FROM regions"),
    "a8_gtf_lines": with_parts(
        EXONS,
        "SELECT concat('g', gene) AS gene, chrom, strand, CASE WHEN type = 'CDS' THEN 'CDS' ELSE 'exon' END AS type, start, stop FROM exons WHERE type <> 'UTR3'",
    ),
    "a9_vcf_round_trip": with_parts(
        VARIANTS,
        "SELECT chrom, pos, vid, ref, alt, qual, CASE WHEN filter LIKE '%;%' THEN 2 ELSE 1 END AS n_filters, CAST(qual AS BIGINT) AS dp,"
        f" {q4('(vid % 10) / 10e0')} AS af, vid % 4 = 0 AS db, qual AS sample_dp FROM variants",
    ),
    "s21_info_edit": with_parts(
        VARIANTS,
        "SELECT vid, CAST(qual * 2 AS BIGINT) AS dp, false AS has_af, vid % 4 = 0 AS db,"
        " CASE WHEN filter = 'PASS' THEN 'low' ELSE concat(filter, ';low') END AS added,"
        " CASE filter WHEN 'q10' THEN 'PASS' WHEN 'q10;s50' THEN 's50' ELSE filter END AS removed FROM variants",
    ),
    "t4_site_passes": with_parts(
        VARIANTS,
        "SELECT chrom, pos, vid, row_number() OVER (PARTITION BY chrom ORDER BY pos, vid) AS forward,"
        " row_number() OVER (PARTITION BY chrom ORDER BY pos DESC, vid DESC) AS backward FROM variants",
    ),
    "a7_candidate_lines": with_parts(
        REGIONS, "SELECT chrom, start, stop, CAST(payload AS VARCHAR) AS peak_id, 2.5e0 AS pileup, 0e0 AS pscore FROM regions"
    ),
    "a14_list_items": "SELECT item, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS item FROM part UNION ALL SELECT p_brand FROM part)"
    " WHERE item <> '' GROUP BY item",
    "a12_sequence_fetch": "SELECT CAST(doc_id AS VARCHAR) AS name, length(text) // 4 AS beg, (length(text) * 3) // 4 AS stop,"
    " substring(text, length(text) // 4 + 1, (length(text) * 3) // 4 - length(text) // 4) AS seq FROM documents"
    " WHERE (length(text) * 3) // 4 > length(text) // 4",
    "w14_introns": with_parts(_MERGED, "SELECT * FROM introns"),
    "w14_merged_exons": with_parts(_MERGED, "SELECT * FROM merged"),
    "w14_flanks": with_parts(_MERGED, "SELECT * FROM flanks"),
    "w15_percentiles": with_parts(
        [
            *_MERGED,
            ("bases", "SELECT gene, chrom, strand, unnest(range(start, stop + 1)) AS p FROM merged"),
            ("lists", "SELECT gene, chrom, strand, list(p ORDER BY p) AS ps, min(p) AS g FROM bases GROUP BY ALL"),
            (
                "grid",
                "SELECT gene, chrom, strand, ps, g, j, (len(ps) - 1) * j // 100 AS f, ((len(ps) - 1) * j) % 100 AS rest FROM lists, range(0, 101) t(j)",
            ),
        ],
        "SELECT gene, chrom, strand, CASE WHEN strand = 0 THEN j ELSE 100 - j END AS pct,"
        " ((ps[f + 1] - g) * (100 - rest) + (coalesce(ps[f + 2], ps[f + 1]) - g) * rest + 50) // 100 AS offset FROM grid",
    ),
    "j15_annotate": with_parts(
        [
            *_MERGED,
            *READS,
            ("b", f"SELECT DISTINCT chrom, strand, pos AS l_start, pos + {TAG - 1} AS l_stop FROM reads"),
            (
                "features",
                "SELECT DISTINCT gene, chrom, strand, CASE type WHEN 'CDS' THEN 1 WHEN 'UTR5' THEN 2 ELSE 3 END AS kind, start, stop FROM exons"
                " UNION ALL SELECT gene, chrom, strand, 4, start, stop FROM introns"
                " UNION ALL SELECT gene, chrom, strand, CASE type WHEN 'ITGUP1K' THEN 5 ELSE 6 END, start, stop FROM flanks",
            ),
            (
                "per_gene",
                "SELECT b.chrom, b.strand, l_start, l_stop, gene, sum(least(l_stop, stop) - greatest(l_start, start) + 1) FILTER (kind <= 3) AS overlap, min(kind) AS kind"
                " FROM b JOIN features f ON b.chrom = f.chrom AND b.strand = f.strand AND l_stop >= start AND l_start <= stop GROUP BY ALL",
            ),
            ("ranked", "SELECT *, max(overlap) OVER (PARTITION BY chrom, strand, l_start, l_stop) AS best FROM per_gene"),
        ],
        "SELECT chrom, strand, l_start, l_stop, gene, CAST(coalesce(overlap, 0) AS BIGINT) AS overlap, kind FROM ranked WHERE best IS NULL OR overlap = best",
    ),
    "s18_variant_type": with_parts(_TYPES, "SELECT vid, ref, alt, type, size FROM typed"),
    "p20_site_filter": with_parts(
        [*VARIANTS, *REGIONS],
        "SELECT vid, chrom, pos - 1 AS start, pos - 2 + length(ref) AS stop FROM variants v WHERE (filter LIKE '%q10%' OR filter LIKE '%PASS%')"
        " AND EXISTS (SELECT 1 FROM regions r WHERE r.chrom = v.chrom AND pos - 2 + length(ref) >= r.start AND pos - 1 <= r.stop)",
    ),
    "j14_merge_none": _merge_sql("concat(ref, '>', alt)"),
    "j14_merge_snps": _merge_sql("CASE WHEN type = 'SNP' THEN 'SNP' ELSE concat(ref, '>', alt) END"),
    "j14_merge_any": _merge_sql("''"),
    "g20_genotypes": with_parts(
        VARIANTS,
        "SELECT vid, "
        + ", ".join(f"CAST(len(list_filter(flatten([{', '.join(_GT)}]), lambda x: x = {i})) AS INT) AS ac{i}" for i in range(3))
        + ", "
        + ", ".join(f"{_class_sql(g)} AS class{i}" for i, g in enumerate(_GT))
        + ", concat('0', "
        + ", ".join(f"CASE WHEN list_contains(flatten([{', '.join(_GT)}]), {i}) THEN ',{i}' ELSE '' END" for i in (1, 2))
        + ") AS used FROM variants",
    ),
    "s4_round_top": "SELECT event_id, "
    + ", ".join(f"floor((value - 100e0) / 7e0 * {10**k}e0 + 0.5e0) / {10**k}e0 AS r{k}" for k in (0, 2, 5))
    + " FROM events",
    "s9_chi_square": "SELECT event_id, "
    + f"{q4('-x / 2e0 / ln(10e0)')} AS k2, {q4('(-x / 2e0 + ln(1e0 + x / 2e0)) / ln(10e0)')} AS k4, {q4('exp(-x / 2e0) * (1e0 + x / 2e0)')} AS p4,"
    + f" {q4('1e0 - ' + _ERF.format(z='sqrt(x / 2e0)'))} AS p1"
    + " FROM (SELECT event_id, value / 10e0 AS x FROM events)",
    "s16_gamma": f"SELECT event_id, {q4('lgamma(value + 1e0)')} AS lg,"
    f" {q4('1e0 - list_sum(list_transform(range(0, a), lambda i: exp(i * ln(x) - x - lgamma(i + 1e0))))')} AS gp"
    " FROM (SELECT event_id, value, user_id % 500 + 1 AS a, value AS x FROM events)",
    "s16_gamma_q": f"SELECT event_id, {q4('list_sum(list_transform(range(0, a), lambda i: exp(i * ln(x) - x - lgamma(i + 1e0))))')} AS gq"
    " FROM (SELECT event_id, user_id % 300 + 1 AS a, value * 3e0 AS x FROM events)",
    "s16_erfc": f"SELECT event_id, {q4('e')} AS erf, {q4('1e0 - e')} AS erfc FROM"
    f" (SELECT event_id, sign(z) * {_ERF.format(z='abs(z)')} AS e FROM (SELECT event_id, (value - 50e0) / 40e0 AS z FROM events))",
    "s16_beta": f"SELECT event_id, {q4('list_sum(list_transform(range(a, a + b), lambda j: exp(lgamma(a + b) - lgamma(j + 1e0) - lgamma(a + b - j) + j * ln(x) + (a + b - 1 - j) * ln(1e0 - x))))')} AS ib"
    " FROM (SELECT event_id, user_id % 40 + 1 AS a, event_id % 30 + 1 AS b, value / (value + 60e0) AS x FROM events)",
    "s17_fisher": with_parts(
        [
            ("cells", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL"),
            (
                "t",
                "SELECT p_brand, p_type, n, sum(n) OVER (PARTITION BY p_brand)::BIGINT AS nb, sum(n) OVER (PARTITION BY p_type)::BIGINT AS nt, sum(n) OVER ()::BIGINT AS total FROM cells",
            ),
            ("grid", "SELECT *, unnest(range(greatest(0, nb + nt - total), least(nb, nt) + 1)) AS i FROM t"),
            ("masses", f"SELECT *, {_MASS.format('i')} AS p, {_MASS.format('n')} AS p0 FROM grid"),
            (
                "tests",
                "SELECT p_brand, p_type, least(sum(p) FILTER (i <= n), 1e0) AS l, least(sum(p) FILTER (i >= n), 1e0) AS r,"
                " least(sum(p) FILTER (p <= p0 * (1e0 + 1e-8)), 1e0) AS t FROM masses GROUP BY ALL",
            ),
        ],
        f"SELECT p_brand, p_type, {q4('l')} AS left_p, {q4('r')} AS right_p, {q4('t')} AS two_tail_p FROM tests",
    ),
    "s6_max_dup": with_parts(
        TOTALS,
        "SELECT sample, u + m AS total, CAST(list_min(list_filter(range(0, 60), lambda i: list_sum(list_transform(range(0, i + 1), lambda j:"
        " exp(lgamma(u + m + 1e0) - lgamma(j + 1e0) - lgamma(u + m - j + 1e0) + j * ln(1e-6) + (u + m - j) * ln(1e0 - 1e-6)))) > 0.99999e0)) AS INT) AS max_dup FROM counts",
    ),
    "s22_base_codes": with_parts(
        [("al", view_sql("alignments"))],
        "SELECT qname, translate(reverse(seq), 'ACGTN', 'TGCAN') AS revcomp,"
        " CAST(list_sum(list_transform(string_split(seq, ''), lambda c: instr('=ACMGRSVTWYHKDBN', c) - 1)) AS INT) AS code_sum FROM al",
    ),
    "o5_downsample": with_parts(READS, "SELECT sample, chrom, strand, CAST(floor(count(*) * 0.3e0) AS BIGINT) AS n FROM reads GROUP BY ALL"),
}
