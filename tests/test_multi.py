from crestline.operators import em
from crestline.operators.joins import lookup
from crestline.plans.multi import merge_overlapping


def test_overlapping_peaks_join(spark):
    rows = [
        (1, "c", 10, 100, 1.0, 2.0, 3.0, 1.5, 4.0),
        (2, "c", 50, 70, 1.0, 2.0, 3.0, 2.5, 1.0),
        (3, "c", 90, 70000, 1.0, 2.0, 3.0, 1.0, 9.0),
        (4, "c", 69999, 80000, 1.0, 2.0, 3.0, 1.0, 1.0),
        (5, "c", 80000, 90000, 1.0, 2.0, 3.0, 1.0, 1.0),
        (6, "d", 20, 30, 1.0, 2.0, 3.0, 1.0, 1.0),
    ]
    names = "pid long, chrom string, start long, stop long, ip_tags double, input_tags double, pileup double, fold double, pscore double"
    got = sorted(map(tuple, merge_overlapping(spark.createDataFrame(rows, names)).collect()))
    assert got == [
        (1, "c", 10, 80000, 4.0, 8.0, 12.0, 2.5, 9.0),
        (5, "c", 80000, 90000, 1.0, 2.0, 3.0, 1.0, 1.0),
        (6, "d", 20, 30, 1.0, 2.0, 3.0, 1.0, 1.0),
    ]


def test_lookup_keeps_every_row_of_a_hot_key(spark):
    big = spark.range(0, 5000).selectExpr("id", "CASE WHEN id < 4900 THEN 0 ELSE id END AS k")
    small = spark.createDataFrame([(0, "hot"), (4950, "one")], "k long, v string")
    assert lookup(big, small, ["k"]).count() == 4901
    assert lookup(big, small, ["k"], "left").count() == 5000


def test_equal_weights_come_from_the_read_alone(spark):
    rows = [("C", 1, 5, 10), ("C", 1, 5, 20), ("C", 1, 6, 30), ("C", 2, 5, 10), ("T", 2, 5, 10), ("T", 2, 7, 10)]
    found = em.equal_by_read(spark.createDataFrame(rows, "sample string, read_id long, pid long, frag_start long"))
    assert sorted(map(tuple, found.collect())) == [("C", 1, 5, 2, 1 / 3), ("C", 1, 6, 1, 1 / 3), ("C", 2, 5, 1, 1.0), ("T", 2, 5, 1, 0.5), ("T", 2, 7, 1, 0.5)]
