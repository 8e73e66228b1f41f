"""Variant sites: type of change, genotypes, and merging of call sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.functions.let import let
from crestline.operators.running import position_in_group


def _shared_prefix(a: Column, b: Column) -> Column:
    """Number of leading characters two non-empty strings share."""
    lengths = F.sequence(F.lit(1), F.least(F.length(a), F.length(b)))
    return F.size(F.filter(lengths, lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i)))


def variant_type(ref: Column, alt: Column) -> Column:
    """struct(type, size): REF, SNP, MNP, INDEL or OTHER of one alternate allele.

    Shared leading bases are set aside first, then shared trailing ones as long
    as a base stays on each side.
    """
    def out(kind: str, size: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), size.cast("int").alias("size"))

    def after_lead(n: Column) -> Column:
        parts = F.struct(
            F.substr(ref, n + 1, F.length(ref)).alias("r"), F.substr(alt, n + 1, F.length(alt)).alias("a")
        )
        return let(parts, after_trail)

    def after_trail(s: Column) -> Column:
        r, a = F.length(s["r"]), F.length(s["a"])
        shared = F.when(
            (r > 1) & (a > 1),
            F.least(_shared_prefix(F.reverse(s["r"]), F.reverse(s["a"])), F.least(r, a) - 1),
        ).otherwise(F.lit(0))
        return let(F.struct(s["r"].alias("r"), s["a"].alias("a"), shared.alias("n")), classify)

    def classify(s: Column) -> Column:
        left_r, left_a = F.length(s["r"]), F.length(s["a"])
        r, a = left_r - s["n"], left_a - s["n"]
        # the base that stays last on each side; equal ones mean a shifted indel
        same_last = F.substr(s["r"], r, F.lit(1)) == F.substr(s["a"], a, F.lit(1))
        one = (r == 1) | (a == 1)
        return (
            F.when((left_r == 0) & (left_a == 0), out("REF", F.lit(0)))
            .when((left_r == 0) | (left_a == 0), out("INDEL", left_a - left_r))
            .when((r == 1) & (a == 1), out("SNP", F.lit(1)))
            .when(one & same_last, out("INDEL", a - r))
            .when(one, out("OTHER", a - r))
            .when(r == a, out("MNP", a))
            .otherwise(out("OTHER", F.when(r > a, -r).otherwise(a)))
        )

    single = (F.length(ref) == 1) & (F.length(alt) == 1)
    return (
        F.when(single & (alt.isin(".", "X") | (ref == alt)), out("REF", F.lit(0)))
        .when(single, out("SNP", F.lit(1)))
        .when(alt == "<X>", out("REF", F.lit(0)))
        .when(alt.startswith("<"), out("OTHER", F.lit(0)))
        .otherwise(let(_shared_prefix(ref, alt), after_lead))
    )


def genotype_class(alleles: Column) -> Column:
    """Class of a genotype given allele numbers; negative ones are missing."""
    # The names of the classes are those of the format's genotype types.
    known = F.filter(alleles, lambda x: x >= 0)
    alts = F.array_distinct(F.filter(known, lambda x: x > 0))
    has_ref = F.array_contains(known, 0)
    return (
        F.when(F.size(known) == 0, "UNKN")
        .when((F.size(known) == 1) & has_ref, "HAPL_R")
        .when(F.size(known) == 1, "HAPL_A")
        .when(~has_ref & (F.size(alts) == 1), "HOM_AA")
        .when(~has_ref, "HET_AA")
        .when(F.size(alts) == 0, "HOM_RR")
        .otherwise("HET_RA")
    )


def allele_counts(genotypes: Column, n_alleles: Column) -> Column:
    """Count of each allele over the genotypes of a site."""
    every = F.flatten(genotypes)
    return F.transform(F.sequence(F.lit(0), n_alleles - 1), lambda a: F.size(F.filter(every, lambda x: x == a)))


def used_alleles(counts: Column) -> Column:
    """Allele numbers to keep: the reference and every one that is seen."""
    numbers = F.sequence(F.lit(0), F.size(counts) - 1)
    return F.filter(numbers, lambda i: (i == 0) | (F.get(counts, i) > 0))


def with_match_key(sites: DataFrame, policy: str) -> DataFrame:
    """Add ``match``: what two sites at one position must share to be merged.

    ``none``: the same alleles; ``snps``/``indels``/``both``: the same alleles or
    both of that type; ``any``: the position alone.
    """
    exact = F.concat_ws(">", "ref", "alt")
    if policy == "none":
        return sites.withColumn("match", exact)
    if policy == "any":
        return sites.withColumn("match", F.lit(""))
    kinds = {"snps": ["SNP"], "indels": ["INDEL"], "both": ["SNP", "INDEL"]}[policy]
    # the type on its own first, so that it is worked out once per site
    typed = sites.withColumn("_kind", variant_type(F.col("ref"), F.col("alt")))
    kind = F.col("_kind.type")
    return typed.withColumn("match", F.when(kind.isin(kinds), kind).otherwise(exact)).drop("_kind")


def merge_sites(left: DataFrame, right: DataFrame, policy: str, carry: Sequence[str]) -> DataFrame:
    """Full outer merge of two call sets by position under a matching policy.

    The k-th matching site of one side meets the k-th of the other, as readers
    in step would; no site is paired with every other one.
    """
    keys = ["chrom", "pos", "match"]
    sides = []
    for df, suffix in ((left, "_1"), (right, "_2")):
        keyed = with_match_key(df, policy)
        keyed = keyed.withColumn("_slice", F.substring("ref", 1, 1))
        ranked = position_in_group(keyed, keys, ["ref", "alt", *[c for c in carry if c not in ("ref", "alt")]], ["_slice"], "rn")
        sides.append(ranked.select(*keys, "rn", *[F.col(c).alias(c + suffix) for c in carry]))
    return sides[0].join(sides[1], [*keys, "rn"], "full_outer").drop("rn")
