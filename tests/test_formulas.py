from pyspark.sql import Row, functions as F

from tablegauge.functions.clock import boundaries, elapsed_text, minutes_text, ntz, seconds_text
from tablegauge.functions.numbers import auto_threshold, default_sample_rows, density_values, pages, ratio, threshold_type
from tablegauge.operators.querylog import clean_text, cut_statement, size_band


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_threshold_golden(spark):
    rows = spark.createDataFrame([(2_000_000,), (500,), (1000,), (25_001,), (25_000,), (None,)], "n long")
    got = [tuple(r) for r in rows.select(auto_threshold(F.col("n")), threshold_type(F.col("n"))).collect()]
    assert got == [(44721, "Dynamic"), (501, "Static"), (700, "Static"), (5000, "Dynamic"), (5500, "Static"), (501, "Static")]
    assert one(spark, auto_threshold(F.lit(2_000_000), dynamic=False)) == (400_500,)


def test_histogram_average_golden(spark):
    assert one(spark, ratio(F.lit(7772.338).cast("decimal(20,4)"), F.lit(33), 4)) == (235.5254,)


def test_boundaries_count_crossings(spark):
    a, b = ntz("2023-12-31 23:59:59"), ntz("2024-01-01 00:00:01")
    assert one(spark, *[boundaries(p, a, b) for p in ("MINUTE", "HOUR", "DAY", "YEAR")]) == (1, 1, 1, 1)
    assert one(spark, boundaries("HOUR", ntz("2024-01-01 10:00:00"), ntz("2024-01-01 10:59:59"))) == (0,)


def test_texts_of_time(spark):
    assert one(spark, minutes_text(F.lit(1500)), elapsed_text(ntz("2024-01-01"), ntz("2024-01-09 01:05:00")), seconds_text(F.lit(90061))) == (
        "1d 1hr 0min", "8d 1hr 5min", "1:01:01:01")


def test_ratio_and_division_by_zero(spark):
    assert one(spark, ratio(F.lit(201), F.lit(200), 2), ratio(F.lit(1), F.lit(0), 2), ratio(F.lit(1), F.lit(3), 2, 100)) == (1.01, None, 33.33)


def test_density_values(spark):
    assert one(spark, density_values(F.lit(1.0 / 49)), density_values(F.lit(0.0))) == (49, 1)


def test_sizes(spark):
    assert one(spark, pages(F.lit(8192)), pages(F.lit(8193)), default_sample_rows(F.lit(1_000_000))) == (1, 2, 29929)


def test_size_bands(spark):
    got = spark.createDataFrame([(v,) for v in (25.0, 15.0, 10.0, 5.0, 2.0, 1.9)], "mb double").select(size_band(F.col("mb"))).collect()
    assert [r[0].split()[0] for r in got] == ["Gigantic", "Enormous", "Colossal", "Huge", "Big", "Normal"]


def test_clean_and_cut(spark):
    df = spark.createDataFrame([Row(t="a\x00b\x01c\td\n\x1fe")])
    assert df.select(clean_text(F.col("t"))).first()[0] == "ab?c\td\n?e"
    assert one(spark, cut_statement(F.lit("SELECT 1; SELECT 2"), F.lit(20), F.lit(34)), cut_statement(F.lit("abc"), F.lit(100), F.lit(120))) == ("SELECT 2", "abc")


def test_ratio_rounds_once(spark):
    # 0.00514984: rounded to six places first it would become 0.0052
    assert one(spark, ratio(F.lit(675 * 8), F.lit(1024 * 1024), 4)) == (0.0051,)
