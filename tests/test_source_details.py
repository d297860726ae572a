import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import aggregates as A, quality as Q, retrieval as R, status as Z
from tidemark.sinks import publication as K
from tidemark.sources import documents as D, text_tables as T

CELLS = "k string, year int, cal_month int, value double"
ALERTS = [(r"(?i)\balerta de el ni.o\b", "Alerta"), (r"(?i)\bno activo\b", "No activo")]


def test_anomalies_against_rounded_base_means(spark):
    rows = spark.createDataFrame([("a", y, 1, v) for y, v in ((1980, 9.0), (1981, 1.0), (1982, 2.0), (1983, 2.0), (2000, None), (2001, 5.5))] + [("a", 2001, 2, 3.0)], CELLS)
    found = {(r["year"], r["cal_month"]): r["anomaly"] for r in A.base_anomalies(rows, "k", 1981, 1983).collect()}
    assert found == {(1980, 1): 7.33, (1981, 1): -0.67, (1982, 1): 0.33, (1983, 1): 0.33, (2000, 1): None, (2001, 1): 3.83, (2001, 2): None}


def test_climatology_must_be_complete(spark):
    rows = spark.createDataFrame([("a", 2001, 2, 3.0), ("a", 2001, 3, None)], CELLS)
    months = lambda n: spark.createDataFrame([("a", 0, m, float(m)) for m in n], CELLS)
    found = A.against_climatology(rows, months(range(1, 13)), "k")
    assert [(r["cal_month"], r["anomaly"]) for r in found.orderBy("cal_month").collect()] == [(2, 1.0), (3, None)]
    for short in (months(range(1, 12)), months([]), months(range(1, 13)).withColumn("value", F.when(F.col("cal_month") != 4, F.col("value")))):
        with pytest.raises(Exception, match="climatology is incomplete: a"):
            A.against_climatology(rows, short, "k").collect()
    lines = {r["year"]: r["line"] for r in A.year_lines(found, "k", "anomaly").collect()}
    assert lines == {2001: "2001 -99.99 1.00" + " -99.99" * 10}


def post(i, day="2026-07-01T10:00:00", title="COMUNICADO  OFICIAL N° 1", text="Se mantiene la Alerta de El Niño", link="https://h.org/x", links=""):
    return {"id": i, "date": day, "modified": "m", "link": link, "title": {"rendered": title}, "content": {"rendered": f"<p>{text}</p>{links}"}}


@pytest.mark.parametrize("posts, problem, found", [
    ([post(1), post(3, "2026-07-01"), post(2)], None, 3),
    ([post(1, "2026-07-02"), post(9, "2026-07-01")], None, 1),
    ([post(1), post(2, "soon"), post(3, title="Nota"), post(4, text="nada")], None, 1),
    ([post(1), post(2, link="https://evil.org/x")], "unexpected host", None),
    ([post(1), post(2, text="alerta de El Niño, no activo")], "ambiguous alert", None),
    ([post(1, title="Nota")], "no official communiqué", None),
    ([], "no official communiqué", None),
])
def test_the_newest_official_post(spark, posts, problem, found):
    body = spark.createDataFrame([(json.dumps(posts),)], "body string")
    r = D.official_post(body, r"(?i)COMUNICADO\s+OFICIAL", "h.org", ALERTS).first()
    assert (r["problem"], r["id"]) == (problem, found)
    if found:
        assert r["alert"] == "Alerta" and str(r["day"]).startswith("2026-07-0")


def test_downloads_of_the_host_only(spark):
    links = """<a href="https://h.org/download/2?a=1&amp;b=2">x</a><a href='https://h.org/download/1'>y</a><a href="https://h.org/download/1">y</a><a href="http://h.org/download/3">z</a>
    <a href="https://other.org/download/4">z</a><a href="https://h.org/page">z</a><a href="not a url">z</a>"""
    body = spark.createDataFrame([(json.dumps([post(1, links=links)]),)], "body string")
    assert D.official_post(body, "COMUNICADO", "h.org", ALERTS).first()["documents"] == ["https://h.org/download/1", "https://h.org/download/2?a=1&b=2"]
    broken = spark.createDataFrame([("no json",)], "body string")
    assert D.official_post(broken, "COMUNICADO", "h.org", ALERTS).first()["problem"] == "no official communiqué"


def test_shapes_of_year_tables(spark):
    row = "1990" + ",1.0" * 12
    files = {"good": ["# x", "year,1", row], "late": ["year,1"] + ["1990,1"] * 40 + [row], "short": ["year,1", row[:-4]], "other": ["months", row], "empty": ["# only"], "bare": [row, row]}
    lines = spark.createDataFrame([(k, n, x) for k, v in files.items() for n, x in enumerate(v)], "k string, n int, line string")
    found = sorted((r["k"], r["problem"]) for r in T.wide_problems(lines, ("k",)).collect())
    assert found == [("late", "no rows"), ("other", "no header"), ("short", "no rows")]  # a file of comments only has no line to look at


def test_signs_and_status_categories(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("b", float("-inf")), ("c", None)], "k string, v double")
    assert {r["k"]: r["ok"] for r in rows.groupBy("k").agg(S.consistent_sign(F.col("v")).alias("ok")).collect()} == {"a": True, "b": False, "c": True}
    cases = [("icen", 1.2), ("roni", 0.5), ("soi", 0.5), ("soi", -0.5), ("u850", 0.1), ("u850", 0.0), ("d20", 10.0), ("d20", -10.5), ("roni", None)]
    df = spark.createDataFrame(cases, "i string, v double")
    assert [r[0] for r in df.select(S.status_category(F.col("i"), F.col("v"))).collect()] == [
        "El Niño Costero moderado", "El Niño (cuenca)", "Componente atmosférica de La Niña", "Componente atmosférica de El Niño", "Viento hacia el este (westerly)", "Calmo",
        "Termoclina cerca de la profundidad normal", "Termoclina más somera de lo normal (La Niña)", "Sin datos",
    ]


def test_rapid_observations_prefer_final_of_one_day(spark):
    rows = [("m", "s", "2026-07-01", 1.0, "final", 3), ("m", "s", "2026-07-02", 2.0, "preliminary", 3), ("m", "s", "2026-07-02", 3.0, "final", 4), ("n", "s", "2026-07-03", 4.0, "preliminary", 1), ("n", "s", "2026-07-04", None, "final", 1), ("o", "s", "2026-06-01", 5.0, "final", 1)]
    df = spark.createDataFrame(rows, "metric_id string, source_id string, day string, value double, flag string, point_count int").withColumn("day", F.col("day").cast("date"))
    found = {r["metric_id"]: (r["state"], r["value"], r["last_known"]) for r in Z.rapid_rows(df, F.lit("2026-07-04").cast("date")).collect()}
    assert found == {"m": ("CURRENT", 3.0, 3.0), "n": ("PRELIMINARY", 4.0, 4.0), "o": ("STALE", None, 5.0)}


def test_fallbacks_follow_the_last_outcome(spark):
    rows = [("noaa-cpc-roni", 0, 1, True), ("noaa-cpc-roni", 0, 2, False), ("noaa-cpc-roni", 3, 1, True), ("noaa-cpc-wksst", 2, 5, True)]
    up = Q.available_sources(spark.createDataFrame(rows, "source_id string, level int, at int, ok boolean"), ["at"])
    found = {r["metric_id"]: (r["level"], r["source_id"]) for r in Q.resolve_fallback(Q.fallback_table(spark), up).collect()}
    assert len(found) == 9 and found["roni"] == (3, "noaa-cpc-roni") and found["nino12"] == found["nino34"] == (2, "noaa-cpc-wksst") and found["d20"] == (4, "")
    used = spark.createDataFrame([("d20", "d20-point"), ("coastal_official_status", "icen"), ("icen", "icen"), ("u850", "noaa-cpc-wpac850")], "metric_id string, source_id string")
    assert {r["metric_id"] for r in Q.prohibited_uses(used).collect()} == {"d20", "coastal_official_status"}


def test_evidence_has_all_kinds(spark):
    points = spark.createDataFrame([(i, m, f"1990-0{m + 1}", float(m), "final") for i in ("u850", "icen", "nino34") for m in range(3)], "indicator_id string, month_idx int, month string, value double, flag string")
    q = spark.createDataFrame([(1, "viento del este en 1990-02"), (2, "nada en particular"), (3, "soi 1990-02")], "question_id long, question string")
    topics = spark.createDataFrame([("t", "Viento/alisios", "texto")], "topic_id string, words string, text string")
    status = spark.createDataFrame([("1990-03", "resumen")], "month string, text string")
    found = sorted((r["question_id"], r["kind"], r["id"]) for r in R.evidence_rows(q, points, topics, status).collect())
    assert found == [(1, "calculation", "u850"), (1, "evidence", "u850"), (1, "snippet", "t"), (1, "statistics", "u850"), (1, "status", "status"), (2, "evidence", "icen"), (2, "evidence", "nino34"), (2, "status", "status"), (3, "calculation", "soi"), (3, "status", "status")]


def test_files_are_digested_in_pieces(spark, tmp_path):
    import hashlib

    spark.range(1000).repartition(2).write.parquet(str(tmp_path / "f"))
    found = {r["file"]: (r["length"], r["sha256"]) for r in K.manifest(spark, str(tmp_path / "f")).collect()}
    want = {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in (tmp_path / "f").glob("part-*")}
    assert found == want and len(want) == 2


def test_policies_from_files(spark, tmp_path):
    from tidemark.functions import policies as PO
    from tidemark.sources import policy_files as PF

    good = """# note\npolicy_id: "a"\npolicy_name: 'A: one'\nversion: v1 # first\napplies_to: icen\ndoes_not_apply_to:\n  - "roni"\n  - soi\nrules:\n  - label: "Normal # x"\n    color: green\n    min: -0.7\n    max: 0.5\n    min_inclusive: true\n\n  - label: Rojo\n    min: 2.1\n    max: ~\n"""
    files = {"a.yaml": good, "b.yml": good.replace('"a"', '"b"').replace("label: Rojo", "colour: red"), "c.yaml": "rules:\n  - label: x\n", "d.yaml": "policy_id: d\n", "e.yaml": good, "f.yaml": good.replace('"a"', "f").replace("-0.7", "0.7"), "g.txt": good}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    lines = PF.lines_of(spark, str(tmp_path))
    row = PF.policies(lines).where("file = 'a.yaml'").first()
    assert tuple(row) == ("a.yaml", "a", "A: one", "v1", "icen", ["roni", "soi"])
    assert sorted(tuple(r) for r in PF.problems(lines).collect()) == [("a.yaml", "id is taken"), ("b.yml", "rule without a label"), ("c.yaml", "no id"), ("d.yaml", "no rules"), ("e.yaml", "id is taken"), ("f.yaml", "limits in the wrong order")]
    (tmp_path / "e.yaml").unlink()
    rules = PF.load(spark, str(tmp_path))
    assert [tuple(r) for r in rules.orderBy("ord").collect()] == [("a", 0, "Normal # x", "green", -0.7, 0.5, True, False), ("a", 1, "Rojo", None, 2.1, None, False, False)]
    values = spark.createDataFrame([("a", v) for v in (-0.7, 0.5, 2.1, 2.2, None)] + [("z", 0.0)], "policy string, value double")
    assert [r["label"] for r in PO.classify_by_rules(values, rules).collect()] == ["Normal # x", "Sin clasificar", "Sin clasificar", "Rojo", "Sin datos", "Sin clasificar"]
