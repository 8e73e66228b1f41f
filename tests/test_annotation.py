import random

from crestline.operators import genes
from crestline.operators.genes import FEATURE_TYPES, annotate


def test_best_genes_match_brute_force(spark, monkeypatch):
    """More features than blocks, so that genes are dealt to parts; intervals straddle bins; some blocks hit no exon."""
    monkeypatch.setattr(genes, "TARGETS_PER_TASK", 100)
    rng = random.Random(5)
    features, kinds = [], list(FEATURE_TYPES)
    for gene in range(60):
        start = rng.randrange(0, 3000)
        for _ in range(8):
            s = start + rng.randrange(0, 900)
            features.append((gene, rng.choice("ab"), gene % 2, rng.choice(kinds), s, s + rng.choice([0, 20, 80, 1200])))
    features += [(70, "a", 0, "INTRON", 9000, 12000), (71, "a", 0, "ITGUP1K", 9000, 12000)]
    blocks = sorted({(rng.choice("ab"), rng.randrange(2), s, s + rng.choice([0, 49, 600])) for s in rng.choices(range(4200), k=60)})
    blocks += [("a", 0, 9500, 9549), ("a", 0, 20000, 20049)]
    want = []
    for c, d, s, e in blocks:
        hit = {}
        for g, fc, fd, t, a, b in features:
            if (fc, fd) == (c, d) and e >= a and s <= b:
                hit.setdefault(g, []).append((FEATURE_TYPES[t], min(e, b) - max(s, a) + 1))
        shared = {g: sum(n for k, n in h if k <= 3) for g, h in hit.items()}
        best = max(shared.values(), default=0)
        want += [(c, d, s, e, g, shared[g], min(k for k, _ in hit[g])) for g in hit if shared[g] == best]
    left = spark.createDataFrame(blocks, "chrom string, strand int, l_start long, l_stop long")
    right = spark.createDataFrame(features, "gene long, chrom string, strand int, type string, start long, stop long")
    got = annotate(left, right)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_gene_hit_beside_its_exons_stays_out_where_exons_are_hit(spark):
    left = spark.createDataFrame([("a", 0, 100, 149)], "chrom string, strand int, l_start long, l_stop long")
    rows = [(g, "a", 0, "INTRON", 0, 500) for g in range(40)] + [(50, "a", 0, "CDS", 149, 160)]
    right = spark.createDataFrame(rows, "gene long, chrom string, strand int, type string, start long, stop long")
    assert [tuple(r) for r in annotate(left, right).collect()] == [("a", 0, 100, 149, 50, 1, 1)]


def test_pairs_are_added_up_where_they_were_joined(spark, monkeypatch):
    """No exchange between the join on bins and the sum over a gene's features, whose input is every hit."""
    left = spark.createDataFrame([("a", 0, 100, 149)], "chrom string, strand int, l_start long, l_stop long")
    right = spark.createDataFrame([(g, "a", 0, "CDS", 90, 160) for g in range(8)], "gene long, chrom string, strand int, type string, start long, stop long")
    monkeypatch.setattr(genes, "TARGETS_PER_TASK", 2)
    seen = []
    original, genes_stage = genes.stage, lambda df, label: seen.append((label, df)) or original(df, label)
    genes.stage = genes_stage
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        annotate(left, right).collect()
        plan = dict(seen)["leading"]._jdf.queryExecution().executedPlan().toString()
    finally:
        genes.stage = original
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2, plan


BLOCK_FORM = "chrom string, strand int, l_start long, l_stop long"
FEATURE_FORM = "gene long, chrom string, strand int, type string, start long, stop long"


def _staged(run, label):
    """The frame that ``run`` stages under a label."""
    seen = []
    original = genes.stage
    genes.stage = lambda df, name: seen.append((name, df)) or original(df, name)
    try:
        run()
    finally:
        genes.stage = original
    return dict(seen)[label]


def test_no_pair_of_block_and_feature_is_formed(spark):
    """Before, blocks and features of a bin were joined: rows grew as genes times their features times blocks."""
    blocks = [("a", 0, s, s + 49) for s in range(1000, 1200)]
    rows = [(g, "a", 0, "CDS", s, s + g % 7) for g in range(300) for s in range(1000 + g % 3, 1250, 50)]
    left, right = spark.createDataFrame(blocks, BLOCK_FORM), spark.createDataFrame(rows, FEATURE_FORM)
    plan = _staged(lambda: annotate(left, right).collect(), "leading")._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" in plan and "Join" not in plan, plan


def test_parts_tiles_and_odd_rows_match_brute_force(spark, monkeypatch):
    """Tiles whose genes are dealt to parts, features over several tiles or that end before they start, nulls and types without a number."""
    rng = random.Random(11)
    kinds = [*FEATURE_TYPES, "other"]
    features = []
    for gene in [*range(30), None]:
        start = rng.randrange(0, 500)
        for _ in range(10):
            s = start + rng.randrange(0, 300)
            features.append((gene, "a", (gene or 0) % 2, rng.choice(kinds), s, s + rng.choice([-5, 0, 20, 80, 400])))
    features += [(40, None, 0, "CDS", 0, 900), (41, "a", 0, "CDS", None, 900), (42, "a", 0, "CDS", 0, None), (43, "a", 0, "CDS", 5000, 5100)]
    blocks = sorted({("a", rng.randrange(2), s, s + rng.choice([0, 49, 130])) for s in rng.choices(range(900), k=150)})
    blocks += [(None, 0, 100, 149), ("a", 0, None, 149), ("a", 0, 100, None)]
    want = []
    for c, d, s, e in blocks:
        hit = {}
        for g, fc, fd, t, a, b in features:
            if None not in (c, s, e, fc, a, b) and (fc, fd) == (c, d) and e >= a and s <= b:
                hit.setdefault(g, []).append((FEATURE_TYPES.get(t), min(e, b) - max(s, a) + 1))
        exonic = {g: [n for k, n in h if k and k <= 3] for g, h in hit.items()}
        best = max((sum(x) for x in exonic.values() if x), default=None)
        for g, h in hit.items():
            if best is None or exonic[g] and sum(exonic[g]) == best:
                want.append((c, d, s, e, g, sum(exonic[g]), min((k for k, _ in h if k), default=None)))
    left, right = spark.createDataFrame(blocks, BLOCK_FORM), spark.createDataFrame(features, FEATURE_FORM)
    for bits, here, cells in ((14, 50_000, 1 << 18), (6, 20, 64), (8, 20, 1)):
        monkeypatch.setattr(genes, "ANNOTATION_BITS", bits)
        monkeypatch.setattr(genes, "TARGETS_PER_PLACE", here)
        monkeypatch.setattr(genes, "CELLS", cells)
        got = annotate(left, right)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)), (bits, here, cells)


def test_introns_shuffle_exons_once_and_odd_genes_keep_the_sweep(spark):
    """Before, every gene went by the tiled sweep: the ends of exons were shuffled by position and by tile."""
    rng = random.Random(3)
    form = "gene long, chrom string, strand int, start long, stop long"
    usual = [(g, "a", g % 2, s, s + rng.choice([0, 5, 30])) for g in range(20) for s in rng.choices(range(1, 400), k=8)]
    usual += usual[:10] + [(30, "a", 0, 5, 9), (30, "a", 0, 10, 19), (30, "a", 0, 21, 25), (None, "a", 0, 1, 2), (None, "a", 0, 9, 12)]
    odd = [(50, "a", 0, -9, -5), (50, "a", 0, 4, 9), (50, "a", 0, 20, 30), (51, "a", 0, 5, None), (51, "a", 0, 50, 60), (51, "a", 0, 2, 3)]
    odd += [(52, "a", 0, 5, 9), (52, "a", 0, 20, 14), (52, "a", 0, 30, 40), (53, "a", 0, None, None), (53, "a", 0, 3, 4), (53, "a", 0, 9, 10)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = genes.introns(spark.createDataFrame(usual, form))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1, plan
    everything = spark.createDataFrame(usual + odd, form)
    got = sorted(map(tuple, genes.introns(everything).collect()))
    assert got == sorted(map(tuple, genes._gaps_tiled(everything).collect()))
    assert (30, "a", 0, 20, 20) in got and (30, "a", 0, 10, 9) not in got
