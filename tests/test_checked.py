import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import collated as CO
from tidemark.operators import observed as OB, retrieval as R, variants as V


def test_one_pass_checks_and_writes(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5.0), (2, -1.0), (3, None), (4, 200.0), (5, 7.0)], "id long, v double")
    rows.write.parquet(str(tmp_path / "in"))
    rules = {"positive": F.col("v") > 0, "small": F.col("v") < 100}
    read = spark.read.parquet(str(tmp_path / "in"))
    spark.sparkContext.setJobGroup("checked", "")
    done = OB.write_checked(read, str(tmp_path / "out"), rules, ["v"])
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("checked")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1  # metrics, accepted and rejected rows
    assert done.metrics == {"rows": 5, "rejected": 3, "broken_positive": 2, "broken_small": 2, "least_v": -1.0, "most_v": 200.0, "null_v": 1}
    want = read.agg(F.count("*"), F.count_if(~F.coalesce((F.col("v") > 0) & (F.col("v") < 100), F.lit(False))), F.min("v"), F.max("v")).first()
    assert tuple(want) == tuple(done.metrics[k] for k in ("rows", "rejected", "least_v", "most_v"))
    assert sorted(tuple(r) for r in done.accepted().collect()) == [(1, 5.0), (5, 7.0)] and done.accepted().columns == ["id", "v"]
    assert {r["id"]: r["broken"] for r in done.rejected().collect()} == {2: ["positive"], 3: ["positive", "small"], 4: ["small"]}
    assert tuple(done.quality().first()) == ("FAILED", 5, 3, 0.6) and done.quality(failed_from=0.7).first()["state"] == "DEGRADED"
    assert {tuple(r) for r in done.by_rule().collect()} == {("positive", 2), ("small", 2)}


def test_checks_of_good_and_of_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5.0)], "id long, v double")
    good = OB.write_checked(rows, str(tmp_path / "good"), {"positive": F.col("v") > 0})
    assert good.quality().first()["state"] == "OK" and good.rejected().count() == 0 and good.rejected().columns == ["id", "v", "broken"]
    none = OB.write_checked(rows.limit(0), str(tmp_path / "none"), {"positive": F.col("v") > 0}, ["v"])
    assert none.metrics["rows"] == 0 and none.metrics["least_v"] is None and none.quality().first()["state"] == "FAILED"


def test_spanish_order_and_search(spark):
    terms = ["zona", "ñandú", "nube", "Ñame", "nación", "oro", "ÁREA", "area", "área", "naçao", None, "nino", "niño"]
    random.Random(3).shuffle(terms)
    rows = spark.createDataFrame([(i, t, ["costero", "físico"][i % 2], None, "corriente de El Niño" if t == "oro" else None) for i, t in enumerate(terms)], "id long, term string, category string, short string, full string")
    order = [r["term"] for r in CO.in_order(rows).collect()]
    fold = lambda t: t.lower().translate(str.maketrans("áéíóúç", "aeiouc")).replace("ñ", "n~") if t else "zz"
    assert [fold(t) for t in order] == sorted(map(fold, order)) and order[-1] is None
    assert order.index("nino") < order.index("niño") < order.index("nube") < order.index("Ñame") < order.index("ñandú") < order.index("oro")
    assert [t for t in order[:3]] == ["area", "área", "ÁREA"]  # lower case before accents before capitals, as the rules have it
    assert [r["term"] for r in CO.in_order(rows, 2).collect()] == order[:2]
    found = lambda *a: {r["term"] for r in CO.search_glossary(rows, *a).collect()}
    assert found("NACION") == {"nación"} and found("area") == {"ÁREA", "area", "área"}
    assert found("ñ") == {"ñandú", "Ñame", "niño", "oro"} and found("niño") == {"niño", "oro"} and found("nino") == {"nino"}
    assert found("  ") == set(terms) and found("", "FISICO") == {t for i, t in enumerate(terms) if i % 2} and found("nothing") == set()


def test_drifting_json(spark):
    texts = ['{"k": 1}', '{"k": "2"}', '{"key": 3.0}', '{"d": {"k": 4}}', '{"k": null, "key": 5}', '{"k": "n/a", "key": "6"}', '{"k": [7]}', "[1, 2]", "not json", None, "{}", '{"k": 12345678901234567890}', '{"k": true}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    found = V.normalised(rows, "text", {"k": (["$.k", "$.key", "$.d.k"], "bigint"), "s": (["$.k"], "string")}).orderBy("i").collect()
    assert [r["k"] for r in found] == [1, 2, 3, 4, 5, 6, None, None, None, None, None, None, 1]
    assert [r["is_json"] for r in found] == [True] * 8 + [False, False] + [True] * 3
    assert found[1]["s"] == "2" and found[5]["s"] == "n/a"
    schema = V.schema_over(rows.where("i < 4 or i = 8"), "text").first()
    assert schema["schema"] == "OBJECT<d: OBJECT<k: BIGINT>, k: VARIANT, key: DECIMAL(1,0)>" and schema["not_json"] == 1
    kinds = {(r["name"], r["kind"]): r["n"] for r in V.paths(rows.where("i < 4"), "text").collect()}
    assert kinds == {("k", "BIGINT"): 1, ("k", "STRING"): 1, ("key", "DECIMAL(1,0)"): 1, ("d", "OBJECT<k: BIGINT>"): 1}


@pytest.mark.parametrize("question, ids", [
    ("anomalía del oeste en el Pacífico", ["u850"]), ("viento DEL ESTE", ["u850"]), ("TSM cuenca", ["nino34"]), ("tsm costa", ["nino12"]),
    ("¿y la niña?", ["icen", "nino34"]), ("la termoclina y el SOI", ["d20", "soi"]), ("nada", []),
])
def test_words_point_to_indicators(spark, question, ids):
    row = spark.createDataFrame([(question,)], "q string").select(R.detect_indicators(F.col("q")).alias("ids")).first()
    assert row["ids"] == ids
