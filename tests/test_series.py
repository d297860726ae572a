import pytest
from pyspark.sql import functions as F

from tidemark.functions import policies, scalars as S
from tidemark.operators import aggregates as A, events as E, windows as W

SCHEMA = "indicator_id string, scope string, month_idx int, month string, value double, flag string"


@pytest.fixture
def series(spark):
    def make(*values, indicator="nino34", start=0):
        rows = [(indicator, "basin", start + i, f"{1990 + (start + i) // 12:04d}-{(start + i) % 12 + 1:02d}", v, "final") for i, v in enumerate(values)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


def column(df, name):
    return [r[name] for r in df.orderBy("month_idx").collect()]


@pytest.mark.parametrize("values, want", [((1.0, 2.0, 3.0, 4.0, 5.0), [None, None, 2, 3, 4]), ((1.0, None, 1.0, 1.0, 1.0), [None, None, None, None, 1])])
def test_trailing_mean(series, values, want):
    assert column(W.trailing_mean(series(*values)), "mean") == want


def test_trailing_mean_by_calendar_differs_on_gaps(spark):
    rows = [("a", "s", i, "", float(i), "final") for i in (1, 2, 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert column(W.trailing_mean(df), "mean")[-1] == pytest.approx(7 / 3)
    assert column(W.trailing_mean(df, calendar=True), "mean")[-1] is None


PERIODS = [
    ((0, 0.6, 0.9, 0.7, 0.1), [(1, 4, 2, 0.9, 4)]),
    ((0, 0.6, 0.8, None), [(1, 3, 2, 0.8, 3)]),
    ((0.7, -0.8, 0), [(0, 1, 0, 0.7, 2), (1, 2, 1, -0.8, 2)]),
    ((0, 0.9, 0.9, 0), [(1, 3, 1, 0.9, 3)]),
    ((0.6, None, 0.7, 0), [(0, 3, 2, 0.7, 4)]),
]


@pytest.mark.parametrize("values, want", PERIODS)
def test_periods(series, values, want):
    found = E.extract_periods(series(*(None if v is None else float(v) for v in values))).orderBy("start_idx").collect()
    assert [(r["start_idx"], r["end_idx"], r["peak_idx"], r["peak"], r["duration"]) for r in found] == want


def test_strict_end(series):
    assert E.extract_periods(series(0.0, 0.6, 0.9, 0.1), strict_end=True).first()["end_idx"] == 2


def test_alert_run_skips_unknown_months(series):
    r = W.alert_states(series(0.5, 0.2, 0.5, None, 0.6), 0.4, 3).first()
    assert (r["direction"], r["consecutive"], r["status"], r["progress"]) == ("warm", 2, "En vigilancia", 67)


def test_trend_orders_known_values(series):
    r = W.rolling_trend(series(1.0, None, 2.0, 3.0), 4).first()
    assert r["slope"] == pytest.approx(1) and r["r2"] == pytest.approx(1)
    flat = W.rolling_trend(series(2.0, 2.0, 2.0, 2.0), 4).first()
    assert (flat["slope"], flat["r2"]) == (0, 0)
    assert W.rolling_trend(series(1.0, None, None, None), 4).count() == 0


def test_correlation_of_a_constant_is_zero(series):
    both = series(*map(float, range(12))).unionByName(series(*[3.0] * 12, indicator="soi"))
    assert A.correlations(both).first()["r"] == 0
    assert W.rolling_correlation(both, 6).agg(F.max(F.abs("r"))).first()[0] == 0


def test_box_statistics(series):
    phased = series(*[0.0] * 5).unionByName(series(1.0, 2.0, 3.0, 4.0, 100.0, indicator="d20"))
    r = A.box_stats(phased).where("indicator_id = 'd20' and phase = 'Neutral'").first()
    assert (r["q1"], r["median"], r["q3"], r["whisker_low"], r["whisker_high"], r["outliers"]) == (2, 3, 4, 1, 7, [100.0])
    assert A.box_stats(phased).where("phase = 'El Niño'").agg(F.sum("n")).first()[0] == 0


def test_bands_are_clipped_at_the_ends(series):
    found = W.probability_bands(series(1.0, 1.0, 0.0, -1.0, -1.0), 4).orderBy("month_idx").collect()
    assert [r["prob_nino"] for r in found] == [67, 50, 40, 25, 0]


def test_percentile_ranks(series):
    assert [r["percentile"] for r in A.percentile_ranks(series(1.0, 2.0, 3.0, 4.0, 5.0)).orderBy("value").collect()] == [0, 20, 40, 60, 80]


EDGES = [(-0.7001, "Sin clasificar"), (-0.7, "Normal"), (0.5, "Normal"), (0.5001, "Sin clasificar"), (1.2999, "Sin clasificar"), (1.3, "Amarillo"), (2.0, "Amarillo"), (2.05, "Sin clasificar"), (2.1, "Rojo"), (None, "Sin datos")]


def test_threshold_edges(spark):
    df = spark.createDataFrame([(v, "coastal") for v, _ in EDGES], "value double, policy string")
    assert [r[0] for r in df.select(policies.evaluate(F.col("value"), "coastal")["label"]).collect()] == [x for _, x in EDGES]
    joined = policies.classify_by_rules(df, policies.rule_table(spark)).collect()
    assert {(r["value"], r["label"]) for r in joined} == set(EDGES)


def test_nan_is_no_data(spark):
    r = spark.sql("select double('nan') v").select(S.icen_category(F.col("v")), S.roni_category(F.col("v")), policies.evaluate(F.col("v"), "basin")["color"]).first()
    assert tuple(r) == ("Sin datos", "Sin datos", "gray")


def test_longitudes(spark):
    df = spark.createDataFrame([(180.0,), (-180.0,), (275.0,), (-90.0,)], "x double")
    assert [tuple(r) for r in df.select(S.to_negative(F.col("x")), S.to_positive(F.col("x"))).collect()] == [(180, 180), (180, 180), (-85, 275), (-90, 270)]
    box = df.select(S.in_box(F.lit(-5.0), F.col("x"), -10, 0, -90, -80).alias("i")).collect()
    assert [r["i"] for r in box] == [False, False, True, True]


def test_checksum_equals_a_plain_fold(spark, series):
    def fold(key, points):
        h = (2166136261 ^ len(key)) & 0xFFFFFFFF
        for month, v in points:
            h = ((h ^ (ord(month[0]) + len(month))) & 0xFFFFFFFF) * 16777619 & 0xFFFFFFFF
            h = ((h ^ ((9999 if v is None else round(v * 1000)) + 0x9E3779B9) & 0xFFFFFFFF) & 0xFFFFFFFF) * 16777619 & 0xFFFFFFFF
        return f"{h:08X}"

    from tidemark.sinks.publication import checksums

    values = (0.25, None, -1.3, 2.0)
    months = [f"1990-{i + 1:02d}" for i in range(4)]
    assert checksums(series(*values)).first()["checksum"] == fold("nino34", list(zip(months, values)))


def test_normal_cdf(spark):
    import math

    df = spark.createDataFrame([(x / 4,) for x in range(-12, 13)], "x double")
    assert all(abs(r[1] - 0.5 * (1 + math.erf(r[0] / math.sqrt(2)))) < 1e-6 for r in df.select("x", S.normal_cdf(F.col("x"))).collect())
