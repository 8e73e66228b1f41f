import json
import random

import pytest
from pyspark.sql import functions as F

from crestline import cli
from crestline.sources import bam, sam
from crestline.sources.sinks import subpeak_letters
from crestline.sources.sniff import sniff


HEADER = "@SQ\tSN:chr1\tLN:200000\n@SQ\tSN:chr2\tLN:200000\n"


def write_sam(path, seed, sites, background, header=HEADER):
    rng = random.Random(seed)
    with open(path, "w") as out:
        out.write(header)
        n = 0
        for chrom, centre, count in sites:
            for _ in range(count):
                n += 1
                reverse = rng.random() < 0.5
                pos = centre + (rng.randint(20, 120) if reverse else -rng.randint(20, 120))
                copies = [(chrom, pos)] if rng.random() < 0.8 else [(chrom, pos), ("chr2" if chrom == "chr1" else "chr1", pos)]
                for c, p in copies:
                    out.write(f"r{n}\t{16 if reverse else 0}\t{c}\t{p}\t60\t40M\t*\t0\t0\t{'A' * 40}\t*\n")
        for i in range(background):
            out.write(f"b{i}\t0\tchr{1 + i % 2}\t{rng.randint(1000, 190000)}\t60\t40M\t*\t0\t0\t{'A' * 40}\t*\n")


def test_narrow_run_finds_the_planted_peaks(spark, tmp_path):
    treat, control, out = (str(tmp_path / n) for n in ("t.sam", "c.sam", "out"))
    centres = [20000, 60000, 110000, 150000]
    write_sam(treat, 1, [(c, x, 150) for c in ("chr1", "chr2") for x in centres], 1500)
    write_sam(control, 2, [], 6000)
    cli.main(["narrow", "-t", treat, "-c", control, "-o", out, "-n", "run", "-g", "400000"])
    rows = spark.read.csv(f"{out}/run_uniqpeaks_xls", sep="\t", header=True).collect()
    found = {(r.chr, c) for r in rows for c in centres if abs(int(r.abs_summit) - c) < 150}
    assert found == {(c, x) for c in ("chr1", "chr2") for x in centres}
    multi = spark.read.csv(f"{out}/run_multiRead_peaks", sep="\t", header=True)
    assert multi.count() >= 8 and multi.columns[0] == "chrom"
    bdg = spark.read.text(f"{out}/run_treat_uniq_bdg")
    assert bdg.count() > 100 and {r.contig for r in bdg.select("contig").distinct().collect()} == {"chr1", "chr2"}
    narrow = [r.value for r in spark.read.text(f"{out}/run_uniqpeaks").collect()]
    assert 'track type=narrowPeak name="run" description="run" nextItemButton=on' in narrow
    steps = spark.read.text(f"{out}/run_treat_multi_bdg")
    assert steps.count() > 0


@pytest.fixture
def libraries(tmp_path):
    """A treatment with two peaks and its control; chr1 alone is in the header, or nothing is."""

    def write(header):
        treat, control = str(tmp_path / "t.any"), str(tmp_path / "c.any")
        write_sam(treat, 1, [("chr1", 20000, 150), ("chr2", 60000, 150)], 600, header)
        write_sam(control, 2, [], 2500, header)
        return treat, control, str(tmp_path / "out")

    return write


@pytest.mark.parametrize("header", ["", "@SQ\tSN:chr1\tLN:200000\n"])
def test_contigs_that_the_header_lacks(spark, libraries, header):
    treat, control, out = libraries(header)
    cli.main(["narrow", "-t", treat, "-c", control, "-o", out, "-n", "run", "-g", "400000", "--no-wig"])
    rows = spark.read.csv(f"{out}/run_uniqpeaks_xls", sep="\t", header=True).collect()
    assert {r.chr for r in rows} == {"chr1", "chr2"}


def test_broad_run_of_bam_files_on_p(spark, libraries, tmp_path):
    bam.register(spark)
    treat, control, out = libraries(HEADER)
    contigs = json.dumps([("chr1", 200000), ("chr2", 200000)])
    for path in (treat, control):
        sam.read_sam(spark, path)[1].coalesce(1).write.format("bam").option("contigs", contigs).mode("append").save(path + "_b")
    one = [str(next((tmp_path / f"{n}.any_b").glob("*.bam"))) for n in "tc"]
    assert sniff(one[0]) == ("bam", "bgzf") and sniff(treat) == ("sam", "none")
    cli.main(["narrow", "-t", one[0], "-c", one[1], "-o", out, "-n", "run", "-g", "400000", "--no-wig", "--broad", "-p", "1e-5", "--keepDup", "auto", "--toLarge"])
    assert spark.read.csv(f"{out}/run_broadpeaks", sep="\t").count() >= 2


def test_paired_run_with_long_templates(spark, tmp_path, caplog):
    def write(path, seed, sites, background):
        rng = random.Random(seed)
        with open(path, "w") as out:
            out.write(HEADER)
            for n, centre in enumerate([c for c in sites for _ in range(200)] + [rng.randint(5000, 190000) for _ in range(background)]):
                begin = max(1, centre - 750 + rng.randint(-60, 60))
                for copy in range(2 if n % 9 == 0 else 1):
                    for flag, pos, tlen in ((99, begin, 1500), (147, begin + 1460, -1500)):
                        out.write(f"p{n}\t{flag}\tchr{1 + (n + copy) % 2}\t{pos}\t60\t40M\t=\t{begin}\t{tlen}\t{'A' * 40}\t*\n")

    treat, control, out = (str(tmp_path / n) for n in ("t.sam", "c.sam", "out"))
    write(treat, 1, [40000, 120000], 300)
    write(control, 2, [], 2000)
    with caplog.at_level("WARNING"):
        cli.main(["narrow", "-t", treat, "-c", control, "-o", out, "-n", "run", "-g", "400000", "--no-wig", "--auto"])
    assert spark.read.csv(f"{out}/run_uniqpeaks_xls", sep="\t", header=True).count() >= 2
    assert "left out" not in caplog.text and "no model is fitted" in caplog.text
    multi = spark.read.csv(f"{out}/run_multiRead_peaks", sep="\t", header=True)
    found = {(r.chrom, c) for r in multi.collect() for c in (40000, 120000) if int(r.start) < c < int(r["end"])}
    assert found == {(f"chr{k}", c) for k in (1, 2) for c in (40000, 120000)}
    single = str(tmp_path / "s.sam")
    write_sam(single, 2, [], 300)
    with pytest.raises(SystemExit, match="both"):
        cli.main(["narrow", "-t", treat, "-c", single, "-o", out, "-n", "x", "-g", "400000"])


@pytest.mark.parametrize("value", ["12", "", "0", "x"])
def test_keep_dup_is_checked(value):
    with pytest.raises(SystemExit):
        cli.options_of(cli.parser().parse_args(["narrow", "-t", "a", "-c", "b", "--keepDup", value]))


def test_letters(spark):
    def plain(i):
        out = ""
        while i >= 0:
            i, out = i // 26 - 1, chr(97 + i % 26) + out
        return out

    got = spark.range(20_001).select("id", subpeak_letters(F.col("id")).alias("l"))
    assert all(r.l == plain(r.id) for r in got.collect())
