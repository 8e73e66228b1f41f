"""Call sets with allele lists, variant headers, untranslated regions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.adapters.driver_tables import load, view, view_sql
from crestline.catalog.common import r4, with_parts
from crestline.catalog.library import _TYPES
from crestline.operators import call_sets
from crestline.operators import genes as gn
from crestline.session import stage, staging_root
from crestline.sources import tabbed, vcf_header
from crestline.sources.text import parse_vcf


def _text(merged: DataFrame, sides: int) -> DataFrame:
    columns = [c for k in range(1, sides + 1) for c in (F.col(f"ref_{k}"), F.array_join(f"alts_{k}", ",").alias(f"alts_{k}"))]
    return merged.select("chrom", "pos", *columns)


def _sites(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "variants").withColumn("pos", F.col("pos") % 200).withColumn("alts", F.array("alt"))


def merge_indels(spark: SparkSession, sf: str) -> DataFrame:
    """Two callers; sites with the same alleles, or two indels, go together."""
    rows = _sites(spark, sf)
    return _text(call_sets.merge_call_sets([rows.where("qual <= 25"), rows.where("qual > 25")], "indels", ["vid"]), 2)


def three_way(spark: SparkSession, sf: str) -> DataFrame:
    """Three callers; only the same alleles go together."""
    rows = _sites(spark, sf)
    return _text(call_sets.merge_call_sets([rows.where(f"qual % 3 = {k}") for k in range(3)], "none", ["vid"]), 3)


def merge_some(spark: SparkSession, sf: str) -> DataFrame:
    """Three callers with two alternate alleles a site; one shared allele is enough."""
    rows = _sites(spark, sf).withColumn("alts", F.array_distinct(F.array("alt", F.substring(F.lit("GTACCA"), F.col("vid") % 5 + 1, F.col("vid") % 2 + 1))))
    return _text(call_sets.merge_call_sets([rows.where(f"qual % 3 = {k}") for k in range(3)], "some", ["vid"]), 3)


_GENOTYPES = "array(array(vid % 2, CAST(0 AS INT)), array(qual % 2 * 2, qual % 2 * 2), array(vid % 4 - 1))"
_VALUES = [
    ("array('A1', 'A2')", "alts"),
    ("array(vid % 7, CAST(qual AS BIGINT))", "a"),
    ("array(CAST(1 AS BIGINT), vid % 5, CAST(qual % 9 AS BIGINT))", "r"),
    ("transform(sequence(0, 5), x -> (vid * (x + 3)) % 50)", "g"),
    ("array(transform(sequence(0, 5), x -> (vid * (x + 1)) % 40), transform(sequence(0, 5), x -> (vid + x) % 30), transform(sequence(0, 2), x -> (vid + x) % 20))", "pl"),
]


def trim(spark: SparkSession, sf: str) -> DataFrame:
    """Sites of three alleles without those that no genotype has; two samples of ploidy 2 and one of ploidy 1."""
    rows = view(spark, sf, "variants").withColumn("gt", F.expr(_GENOTYPES).cast("array<array<int>>"))
    rows = rows.select("vid", "ref", "gt", *[F.expr(e).alias(a) for e, a in _VALUES])
    out = call_sets.trim_alleles(rows, a=["a"], r=["r"], g=["g"], sample_g=["pl"])
    flat = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    nested = lambda c: F.array_join(F.transform(c, flat), ";")
    return out.select("vid", "n_removed", flat("alts").alias("alts"), *[flat(c).alias(c) for c in "arg"], nested("gt").alias("gt"), nested("pl").alias("pl"))


_HEAD = [
    "##fileformat=VCFv4.2",
    '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, all samples">',
    '##INFO=<ID=AF,Number=A,Type=Float,Description="Frequency">',
    '##INFO=<ID=DB,Number=0,Type=Flag,Description="Known">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">',
    '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Depth by allele">',
    '##FILTER=<ID=q10,Description="Low">',
    "##contig=<ID=chr1,length=250000>",
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\tS3",
]


def _vcf(spark: SparkSession, sf: str) -> tuple[vcf_header.Header, DataFrame]:
    sample = lambda k: F.concat(F.lit(f"0/{k % 2}:"), F.when(F.col("vid") % (k + 2) == 0, ".").otherwise((F.col("vid") % 50).cast("string")), F.lit(f":{k},"), F.col("qual"))
    data = view(spark, sf, "variants").select(
        F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.col("vid").cast("string"), "ref", "alt", F.col("qual").cast("string"), "filter", "info", F.lit("GT:DP:AD"), *[sample(k) for k in (1, 2, 3)]).alias("value")
    )
    head = spark.createDataFrame([(x,) for x in _HEAD], "value string").coalesce(1)
    lines = head.unionByName(data)
    return vcf_header.read_header(lines), parse_vcf(lines)


def typed_header(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of sites and samples in the types their header gives them."""
    header, sites = _vcf(spark, sf)
    rows = vcf_header.typed_samples(vcf_header.typed_info(sites, header), header)
    return rows.select(
        F.col("id").cast("long").alias("vid"),
        F.col("info.DP").alias("dp"),
        r4(F.col("info.AF")[0]).alias("af"),
        F.col("info.DB").alias("db"),
        *[F.col("samples")[k]["GT"].alias(f"gt_{k + 1}") for k in range(3)],
        *[F.col("samples")[k]["DP"].alias(f"dp_{k + 1}") for k in range(3)],
        F.aggregate(F.col("samples")[2]["AD"], F.lit(0), lambda s, x: s + x).alias("ad_3"),
    )


def sample_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Two of three samples, and all but those, with their typed depth."""
    header, sites = _vcf(spark, sf)
    parts = []
    for exclude in (False, True):
        chosen, own = vcf_header.subset_samples(sites, header, ["S3", "S1"], exclude)
        rows = vcf_header.typed_samples(chosen, own)
        depths = F.array_join(F.transform("samples", lambda s: F.coalesce(s["DP"].cast("string"), F.lit("."))), ",")
        parts.append(rows.select(F.col("id").cast("long").alias("vid"), F.lit(",".join(own.samples)).alias("names"), depths.alias("depths")))
    return parts[0].unionByName(parts[1])


_ENTRIES = [
    ("CAST(p_partkey % 40 AS INT)", "file"),
    ("p_partkey", "at"),
    ("CASE p_size % 4 WHEN 0 THEN 'FILTER' WHEN 1 THEN 'INFO' WHEN 2 THEN 'FORMAT' ELSE 'contig' END", "kind"),
    ("concat('T', CAST(p_partkey % 97 AS STRING))", "id"),
    ("CASE WHEN p_size % 4 IN (0, 3) THEN NULL WHEN p_partkey % 11 = 0 THEN 'A' ELSE '1' END", "number"),
    ("CASE WHEN p_size % 4 IN (0, 3) THEN NULL WHEN p_partkey % 97 < 50 THEN 'Integer' WHEN p_partkey % 5 = 0 THEN 'Float' ELSE 'String' END", "type"),
]


def header_merge(spark: SparkSession, sf: str) -> DataFrame:
    """One dictionary of forty headers, and how many names each of their numbers moves."""
    entries = load(spark, sf, "part").selectExpr(*[f"{e} AS {a}" for e, a in _ENTRIES])
    merged = vcf_header.merge_headers(entries)
    moved = vcf_header.translations(entries, merged).where("own <> number_in").groupBy(F.col("id"), "space").agg(F.count(F.lit(1)).alias("n_moved"))
    space = F.when(F.col("kind") == "contig", "CONTIG").otherwise("ID")
    joined = merged.withColumn("space", space).join(moved, ["id", "space"], "left")
    return joined.select("kind", "id", "number_in", "number", "type", "other_length", "other_type", F.coalesce("n_moved", F.lit(0)).alias("n_moved"))


def utrs(spark: SparkSession, sf: str) -> DataFrame:
    """Exons of a gene outside its coding span; every seventh gene has no stop codon."""
    exons = stage(view(spark, sf, "exons"), "gene_exons")  # read by each part below
    cds = exons.where("type = 'CDS'")
    keys = ["gene", "chrom", "strand"]
    span = cds.where("gene % 7 <> 0").groupBy(*keys).agg(F.min("start").alias("a"), F.max("stop").alias("b"))
    codon = span.select(*keys, F.expr("CASE WHEN strand = 0 THEN b - 2 ELSE a END").alias("start"), F.expr("CASE WHEN strand = 0 THEN b ELSE a + 2 END").alias("stop"))
    return gn.untranslated(exons, cds, codon)


RANGES = [("chr1", 1000, 60000), ("chr1", 50000, 70000), ("chr3", 100000, 150000)]


def tabbed_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Regions written as tab-separated text, and those that overlap a few ranges read back by column roles."""
    path = f"{staging_root(spark)}/tabbed-{uuid.uuid4().hex}"
    view(spark, sf, "regions").select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("stop").cast("string"), F.col("payload").cast("string")).alias("value")).write.text(path)
    roles = tabbed.PRESETS["bed"]
    found = tabbed.in_regions(tabbed.read_tabbed(spark, path, roles, 4), roles, RANGES)
    return found.select("chrom", "start", "stop", F.col("c4").cast("long").alias("payload"))


QUERIES = {
    "j14_merge_indels": merge_indels,
    "j14_three_way": three_way,
    "j14_merge_some": merge_some,
    "g20_trim_alleles": trim,
    "a9_vcf_header": typed_header,
    "p20_sample_subset": sample_subset,
    "j17_header_merge": header_merge,
    "w14_utrs": utrs,
    "a11_tabbed_ranges": tabbed_ranges,
}


def _ranked_sql(side: str, match: str, sides: int) -> str:
    return with_parts(
        [
            *_TYPES,
            ("sets", f"SELECT {side} AS side, chrom, pos % 200 AS pos, ref, alt, {match} AS match FROM typed"),
            ("r", "SELECT *, row_number() OVER (PARTITION BY side, chrom, pos, match ORDER BY ref, alt) AS rn FROM sets"),
        ],
        "SELECT chrom, pos, "
        + ", ".join(f"max({c}) FILTER (side = {k}) AS {a}_{k}" for k in range(1, sides + 1) for c, a in (("ref", "ref"), ("alt", "alts")))
        + " FROM r GROUP BY chrom, pos, match, rn",
    )


_USED = "list_concat([0], list_filter([1, 2], lambda i: list_contains(flatten(gt), i)))"
_PAIRS = "flatten(list_transform(used, lambda b: list_transform(list_filter(used, lambda a: a <= b), lambda a: {0}[b * (b + 1) // 2 + a + 1])))"
_NEW = "list_transform({0}, lambda x: CASE WHEN x < 0 THEN x ELSE list_position(used, x) - 1 END)"


def _joined(x: str) -> str:
    return f"array_to_string({x}, ',')"


ORACLE = {
    "j14_merge_indels": _ranked_sql("CASE WHEN qual <= 25 THEN 1 ELSE 2 END", "CASE WHEN type = 'INDEL' THEN 'INDEL' ELSE concat(ref, '>', alt) END", 2),
    "j14_three_way": _ranked_sql("1 + qual % 3", "concat(ref, '>', alt)", 3),
    "g20_trim_alleles": with_parts(
        [
            ("variants", view_sql("variants")),
            ("s", "SELECT *, [[vid % 2, 0], [qual % 2 * 2, qual % 2 * 2], [vid % 4 - 1]] AS gt FROM variants"),
            ("u", f"SELECT *, {_USED} AS used FROM s"),
            (
                "v",
                "SELECT vid, used, gt, [vid % 7, qual] AS a, [1, vid % 5, qual % 9] AS r, list_transform(range(0, 6), lambda x: (vid * (x + 3)) % 50) AS g,"
                " list_transform(range(0, 6), lambda x: (vid * (x + 1)) % 40) AS p1, list_transform(range(0, 6), lambda x: (vid + x) % 30) AS p2,"
                " list_transform(range(0, 3), lambda x: (vid + x) % 20) AS p3 FROM u",
            ),
        ],
        "SELECT vid, CAST(3 - len(used) AS INT) AS n_removed,"
        + f" {_joined('list_transform(list_filter(used, lambda i: i > 0), lambda i: concat(chr(65), i))')} AS alts,"
        + f" {_joined('list_transform(list_filter(used, lambda i: i > 0), lambda i: a[i])')} AS a,"
        + f" {_joined('list_transform(used, lambda i: r[i + 1])')} AS r, {_joined(_PAIRS.format('g'))} AS g,"
        + " concat_ws(';', " + ", ".join(_joined(_NEW.format(f"gt[{k}]")) for k in (1, 2, 3)) + ") AS gt,"
        + f" concat_ws(';', {_joined(_PAIRS.format('p1'))}, {_joined(_PAIRS.format('p2'))}, {_joined('list_transform(used, lambda i: p3[i + 1])')}) AS pl FROM v",
    ),
    "a9_vcf_header": with_parts(
        [("variants", view_sql("variants"))],
        "SELECT vid, qual AS dp, floor(((vid % 10) / 10e0) * 10000e0 + 0.5e0) / 10000e0 AS af, vid % 4 = 0 AS db, "
        + ", ".join(f"'0/{k % 2}' AS gt_{k}, CASE WHEN vid % {k + 2} = 0 THEN NULL ELSE CAST(vid % 50 AS INT) END AS dp_{k}" for k in (1, 2, 3))
        + ", 3 + qual AS ad_3 FROM variants",
    ),
    "p20_sample_subset": with_parts(
        [
            ("variants", view_sql("variants")),
            ("d", "SELECT vid, " + ", ".join(f"CASE WHEN vid % {k + 2} = 0 THEN '.' ELSE CAST(vid % 50 AS VARCHAR) END AS d{k}" for k in (1, 2, 3)) + " FROM variants"),
        ],
        "SELECT vid, 'S1,S3' AS names, concat(d1, ',', d3) AS depths FROM d UNION ALL SELECT vid, 'S2', d2 FROM d",
    ),
    "j17_header_merge": with_parts(
        [
            ("e", f"SELECT {', '.join(f'{x} AS {a}' for x, a in _ENTRIES)}, CASE WHEN p_size % 4 = 3 THEN 'CONTIG' ELSE 'ID' END AS space FROM part"),
            (
                "d",
                "SELECT space, kind, id, arg_min(coalesce(number, ''), (file, \"at\")) AS number, arg_min(coalesce(type, ''), (file, \"at\")) AS type,"
                " count(DISTINCT number) > 1 AS other_length, count(DISTINCT type) > 1 AS other_type FROM e GROUP BY ALL",
            ),
            ("n", "SELECT space, id, row_number() OVER (PARTITION BY space ORDER BY p) - 1 AS number_in FROM (SELECT space, id, min((file, \"at\")) AS p FROM e GROUP BY ALL)"),
            ("o", "SELECT file, space, id, row_number() OVER (PARTITION BY file, space ORDER BY p) - 1 AS own FROM (SELECT file, space, id, min(\"at\") AS p FROM e GROUP BY ALL)"),
            ("m", "SELECT space, id, count(*) AS n_moved FROM o JOIN n USING (space, id) WHERE own <> number_in GROUP BY ALL"),
        ],
        "SELECT kind, id, number_in, nullif(number, '') AS number, nullif(type, '') AS type, other_length, other_type, coalesce(n_moved, 0) AS n_moved"
        " FROM d JOIN n USING (space, id) LEFT JOIN m USING (space, id)",
    ),
    "a11_tabbed_ranges": with_parts(
        [("regions", view_sql("regions"))],
        "SELECT chrom, start, stop, payload FROM regions WHERE " + " OR ".join(f"(chrom = '{c}' AND start < {b} AND stop > {a})" for c, a, b in RANGES),
    ),
    "w14_utrs": with_parts(
        [
            ("exons", view_sql("exons")),
            ("span", "SELECT gene, chrom, strand, min(start) AS a, max(stop) AS b FROM exons WHERE type = 'CDS' AND gene % 7 <> 0 GROUP BY ALL"),
            ("bases", "SELECT DISTINCT gene, chrom, strand, unnest(range(start, stop + 1)) AS p FROM exons"),
            ("left_over", "SELECT x.*, a FROM bases x LEFT JOIN span USING (gene, chrom, strand) WHERE a IS NULL OR p < a OR p > b"),
            ("grp", "SELECT *, p - row_number() OVER (PARTITION BY gene, chrom, strand ORDER BY p) AS run FROM left_over"),
        ],
        "SELECT gene, chrom, strand, CASE WHEN coalesce(min(p) < min(a), true) = (strand = 0) THEN 'UTR5' ELSE 'UTR3' END AS type, min(p) AS start, max(p) AS stop"
        " FROM grp GROUP BY gene, chrom, strand, run",
    ),
}
