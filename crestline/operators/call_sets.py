"""Call sets with lists of alleles: merging any number of them in step, and taking alleles out of a site."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.operators.running import position_in_group
from crestline.operators.variants import allele_counts, used_alleles, variant_type

#: What two sites at one position may share instead of alleles, per policy: bits of the types of change.
POLICIES = {"none": 0, "some": 0, "snps": 1, "indels": 2, "both": 3, "any": 0}


def type_bits(ref: Column, alts: Column) -> Column:
    """1 if any alternate allele is a SNP, plus 2 if any is an indel."""

    def bit(kinds: Column, kind: str, value: int) -> Column:
        return F.when(F.array_contains(kinds, kind), value).otherwise(0)

    kinds = F.transform(alts, lambda a: variant_type(ref, a)["type"])
    return (bit(kinds, "SNP", 1) + bit(kinds, "INDEL", 2)).cast("int")


def matches(policy: str, one: tuple, other: tuple) -> bool:
    """Whether two sites at one position go together; a site is (ref, alternate alleles, type bits).

    ``none`` asks for the same reference and the same set of alleles.  ``some`` asks for the same reference and a shared
    alternate allele, or none on both sides.  ``snps``, ``indels`` and ``both`` also take two sites of that type;
    ``any`` takes all.
    """
    if policy == "any" or one[2] & other[2] & POLICIES[policy]:
        return True
    if one[0] != other[0]:
        return False
    if policy == "none":
        return len(one[1]) == len(other[1]) and set(one[1]) == set(other[1])
    return not (one[1] or other[1]) or not set(one[1]).isdisjoint(other[1])


def in_step(sites: list[tuple[int, tuple, int]], policy: str) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """Merged rows at one position: (first row number, how many rows, [(input, index of its site, first copy)]).

    ``sites`` are (input, site, copies) in order.  The first site that is left of the first input that has any is the
    template; each later input gives its first site that matches and is left.  Copies of a site go in one go.
    """
    left = [copies for _, _, copies in sites]
    given = [0] * len(sites)
    out, row = [], 0
    for t, (input_, site, _) in enumerate(sites):
        while left[t]:
            chosen = {input_: t}
            for j in range(t + 1, len(sites)):
                other = sites[j][0]
                if other not in chosen and left[j] and matches(policy, site, sites[j][1]):
                    chosen[other] = j
            many = min(left[j] for j in chosen.values())
            out.append((row, many, [(i, j, given[j] + 1) for i, j in chosen.items()]))
            for j in chosen.values():
                left[j] -= many
                given[j] += many
            row += many
    return out


def merge_call_sets(inputs: Sequence[DataFrame], policy: str, carry: Sequence[str] = ()) -> DataFrame:
    """Merge of any number of call sets by position, as readers in step would.

    Each input has chrom, pos, ref, alts (list) and ``carry``.  A row of the result has, for input k, ref_k, alts_k and
    the carried columns with that suffix, null where the input has no site for it.

    What is matched in one place are the distinct lists of alleles at a position with their number of copies; the
    records themselves are numbered within their list by the levelled scan and joined to their row by that number.  So
    however many records one position has, they are spread by hash and no task holds them together.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {', '.join(POLICIES)}")
    keys, carry = ["chrom", "pos"], list(carry)
    every = None
    for k, df in enumerate(inputs, 1):
        one = df.select(F.lit(k).alias("input"), *keys, "ref", "alts", *carry)
        every = one if every is None else every.unionByName(one)
    every = every.withColumn("_alleles", F.array_join("alts", ","))
    ranked = every.withColumn("_h", F.xxhash64(*carry, F.lit(0))).withColumn("_slice", F.shiftright("_h", 56))
    ranked = position_in_group(ranked, [*keys, "input", "ref", "_alleles"], ["_h", *carry], ["_slice"], "copy").drop("_h", "_slice")

    lists = every.groupBy(*keys, "input", "ref", "_alleles").agg(F.count(F.lit(1)).alias("copies"), F.first("alts").alias("alts"))
    lists = lists.withColumn("bits", type_bits(F.col("ref"), F.col("alts")))

    def match(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["input", "ref", "_alleles"], ignore_index=True)
        sites = [(i, (r, tuple(a), b), c) for i, r, a, b, c in zip(group["input"], group["ref"], group["alts"], group["bits"], group["copies"])]
        rows = [(first, many, i, group["ref"][j], group["_alleles"][j], copy) for first, many, chosen in in_step(sites, policy) for i, j, copy in chosen]
        out = pd.DataFrame(rows, columns=["first", "many", "input", "ref", "_alleles", "copy"])
        return out.assign(chrom=group["chrom"].iloc[0], pos=group["pos"].iloc[0])[["chrom", "pos", *out.columns]]

    spans = lists.groupBy(*keys).applyInPandas(match, "chrom string, pos long, first long, many long, input int, ref string, _alleles string, copy long")
    one = spans.select(*keys, "first", "copy", "input", "ref", "_alleles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("_k"))
    placed = one.select(*keys, (F.col("first") + F.col("_k")).alias("row"), "input", "ref", "_alleles", (F.col("copy") + F.col("_k")).alias("copy"))
    found = placed.join(ranked, [*keys, "input", "ref", "_alleles", "copy"])
    columns = ["ref", "alts", *carry]
    sides = [F.max(F.when(F.col("input") == k, F.struct(*columns))).alias(f"_{k}") for k in range(1, len(inputs) + 1)]
    rows = found.groupBy(*keys, "row").agg(*sides)
    return rows.select(*keys, *[F.col(f"_{k}.{c}").alias(f"{c}_{k}") for k in range(1, len(inputs) + 1) for c in columns])


# --- taking alleles out -----------------------------------------------------------------


def pick_alternates(values: Column, keep: Column) -> Column:
    """Values per alternate allele (Number=A) of the alleles in ``keep``, which starts with the reference, 0."""
    return F.transform(F.filter(keep, lambda a: a > 0), lambda a: F.get(values, a - 1))


def pick_alleles(values: Column, keep: Column) -> Column:
    """Values per allele, the reference too (Number=R), or per genotype of one allele."""
    return F.transform(keep, lambda a: F.get(values, a))


def pick_genotypes(values: Column, keep: Column, n_alleles: Column) -> Column:
    """Values per genotype (Number=G): of pairs of alleles, where pair (a, b), a <= b, is value b (b + 1) / 2 + a.

    As many values as alleles are those of genotypes of one allele; any other number than these two gives null.
    """
    pairs = F.flatten(F.transform(keep, lambda b: F.transform(F.filter(keep, lambda a: a <= b), lambda a: F.get(values, (b * (b + 1) / 2).cast("int") + a))))
    return F.when(F.size(values) == n_alleles * (n_alleles + 1) / 2, pairs).when(F.size(values) == n_alleles, pick_alleles(values, keep))


def renumbered(genotype: Column, keep: Column) -> Column:
    """A genotype in the numbers the alleles have after the others have gone; an allele that went is missing, -1."""
    return F.transform(genotype, lambda a: F.when(a < 0, a).otherwise(F.when(F.array_contains(keep, a), F.array_position(keep, a).cast("int") - 1).otherwise(-1)))


def remove_alleles(sites: DataFrame, keep: Column, a: Sequence[str] = (), r: Sequence[str] = (), g: Sequence[str] = (), sample_g: Sequence[str] = ()) -> DataFrame:
    """``sites`` (ref, alts, gt) with the alleles in ``keep`` only, which holds 0.

    ``a``, ``r`` and ``g`` name list columns with a value per alternate allele, allele and genotype; ``sample_g`` names
    lists over samples of such genotype lists.
    """
    # as columns of their own: inside a lambda the new list of alleles would be seen
    rows = sites.withColumn("_keep", keep).withColumn("_n", F.size("alts") + 1)
    kept, n = F.col("_keep"), F.col("_n")
    new = {c: pick_alternates(F.col(c), kept) for c in ("alts", *a)}
    new |= {c: pick_alleles(F.col(c), kept) for c in r}
    new |= {c: pick_genotypes(F.col(c), kept, n) for c in g}
    new |= {c: F.transform(c, lambda values: pick_genotypes(values, kept, n)) for c in sample_g}
    new["gt"] = F.transform("gt", lambda x: renumbered(x, kept))
    return rows.withColumns(new).drop("_keep", "_n")


def trim_alleles(sites: DataFrame, **numbers: Sequence[str]) -> DataFrame:
    """``sites`` without the alternate alleles that no genotype has, and ``n_removed``."""
    keep = used_alleles(allele_counts(F.col("gt"), F.size("alts") + 1))
    counted = sites.withColumn("_used", keep).withColumn("n_removed", F.size("alts") + 1 - F.size("_used"))
    return remove_alleles(counted, F.col("_used"), **numbers).drop("_used")
