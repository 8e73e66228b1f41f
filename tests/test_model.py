import math

from crestline.operators.model import ModelBounds, best_lags, cross_correlation


def test_flat_lines_correlate_with_nothing(spark):
    bounds = ModelBounds(20, 1, 9)
    flat = spark.range(0, 2 * 51).selectExpr("CAST(id % 2 AS INT) AS strand", "id DIV 2 AS i", "0L AS depth")
    found = cross_correlation(flat, bounds)
    rows = found.collect()
    assert len(rows) == 40 and all(math.isnan(r.corr) and math.isnan(r.smooth) for r in rows)
    assert best_lags(found).count() == 0
