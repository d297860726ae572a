"""Retrieval over questions and texts: keyword detection, evidence, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that point to an indicator.
KEYWORDS = {
    "nino12": ("niño 1+2", "nino 1+2", "1+2", "costero", "costa", "icen", "tsm costa", "tsm niño 1+2"),
    "icen": ("icen", "índice costero", "indice costero"),
    "nino34": ("niño 3.4", "nino 3.4", "3.4", "cuenca", "roni", "oni", "tsm cuenca", "tsm niño 3.4"),
    "roni": ("roni", "índice oceánico relativo", "indice oceanico relativo"),
    "soi": ("soi", "oscilación del sur", "oscilacion del sur", "tahiti", "darwin", "presión", "presion"),
    "u850": ("viento", "850", "zonal", "alisio", "alisios", "westerly", "easterly", "del oeste", "del este"),
    "d20": ("d20", "termoclina", "isoterma de 20", "isoterma 20", "subsuperficie", "subsuperficial"),
}
#: Words that imply the basin and the coastal index.
IMPLIED = ("el niño", "la niña", "compar", "diferencia", "versus", "vs")


def any_of(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def detect_indicators(question: Column, keywords: dict = KEYWORDS, implied: tuple = IMPLIED, both: tuple = ("nino34", "icen")) -> Column:
    """Sorted ids of the indicators that a question speaks of."""
    low = F.lower(question)
    compare = any_of(low, implied)
    hits = [F.when(any_of(low, words) | (compare if k in both else F.lit(False)), k) for k, words in keywords.items()]
    return F.sort_array(F.array_compact(F.array(*hits)))


def detect_month(question: Column) -> Column:
    found = F.regexp_extract(question, r"\b((?:19|20)\d{2}-(?:0[1-9]|1[0-2]))\b", 1)
    return F.when(found != "", found)


def value_at(points: DataFrame, month: str) -> DataFrame:
    return points.where(F.col("month") == month).select("indicator_id", "value")


def grounding(questions: DataFrame, points: DataFrame) -> DataFrame:
    """Evidence for questions (question_id, question): a row per indicator, with its statistics and the asked month."""
    asked = questions.select("question_id", F.explode(detect_indicators(F.col("question"))).alias("indicator_id"), detect_month(F.col("question")).alias("month"))
    stats = points.where("value is not null").groupBy("indicator_id").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    at = points.select("indicator_id", "month", "value")
    return asked.join(stats, "indicator_id").join(at, ["indicator_id", "month"], "left").select("question_id", "indicator_id", "month", "value", "mean", "least", "most")


#: Indicators for which evidence is shown when a question names none.
DEFAULTS = ("icen", "nino34")


def evidence_rows(questions: DataFrame, points: DataFrame, topics: DataFrame, status: DataFrame) -> DataFrame:
    """All evidence for questions (question_id, question), a row each: question_id, kind, id, month, value, text.

    kind: status, one row that each question gets; evidence, the last known value of each indicator the question speaks of,
    or of the default ones; calculation, the asked month's value and the statistics of each; snippet, the topics
    (topic_id, words, text) whose words it holds. status: one row with text and month.
    """
    from tidemark.operators.status import topics_for
    from tidemark.operators.windows import latest_known

    asked = questions.select("question_id", detect_indicators(F.col("question")).alias("ids"), detect_month(F.col("question")).alias("month"))
    none = F.lit(None).cast("string")
    row = lambda df, kind, *columns: df.select("question_id", F.lit(kind).alias("kind"), *columns)
    stated = row(asked.join(F.broadcast(status)), "status", F.lit("status").alias("id"), status["month"], F.lit(None).cast("double").alias("value"), "text")  # one row of status
    shown = asked.select("question_id", F.explode(F.when(F.size("ids") > 0, F.col("ids")).otherwise(F.array(*map(F.lit, DEFAULTS)))).alias("indicator_id"))
    last = row(shown.join(latest_known(points), "indicator_id"), "evidence", F.col("indicator_id").alias("id"), "month", "value", F.col("flag").alias("text"))
    named = asked.select("question_id", F.explode("ids").alias("indicator_id"), "month").where(F.col("month").isNotNull())
    at = row(named.join(points.select("indicator_id", "month", "value"), ["indicator_id", "month"], "left"), "calculation", F.col("indicator_id").alias("id"), "month", "value", F.when(F.col("value").isNull(), "Sin datos").alias("text"))
    stats = points.where("value is not null").groupBy("indicator_id").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    two = lambda c: F.format_string("%.2f", F.round(c, 2) + F.lit(0.0))
    spoken = asked.select("question_id", F.explode("ids").alias("indicator_id"))
    of = row(spoken.join(stats, "indicator_id"), "statistics", F.col("indicator_id").alias("id"), none.alias("month"), F.col("mean").alias("value"), F.concat(F.lit("media "), two("mean"), F.lit(" · mínimo "), two("least"), F.lit(" · máximo "), two("most")).alias("text"))
    found = topics_for(questions, topics).join(topics.select("topic_id", "text"), "topic_id")
    snippets = row(found, "snippet", F.col("topic_id").alias("id"), none.alias("month"), F.lit(None).cast("double").alias("value"), "text")
    return stated.unionByName(last).unionByName(at).unionByName(of).unionByName(snippets)


def answers(evidence: DataFrame) -> DataFrame:
    """One text per question, its lines in order of the indicators."""
    two = lambda c: F.format_string("%.2f", F.round(c, 2) + F.lit(0.0))
    line = F.concat_ws(" ", "indicator_id", F.coalesce(F.when(F.col("value").isNotNull(), F.concat(F.col("month"), F.lit(":"), two("value"))), F.lit("-")), two("mean"))
    rows = evidence.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("indicator_id", line.alias("line")))).alias("l"))
    return rows.select("question_id", F.array_join(F.transform("l", lambda x: x["line"]), "; ").alias("answer"))


def bm25(docs: DataFrame, query: str, k1: float = 1.5, b: float = 0.75, least: int = 3) -> DataFrame:
    """doc_id and score of the documents that hold a query word. Only query words are exploded.

    Words are runs of letters and digits of `least` or more characters, in lower case.
    """
    import re

    wanted = sorted({w for w in re.findall(r"\w+", query.lower()) if len(w) >= least})
    tokens = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) >= least)
    sized = docs.select("doc_id", tokens.alias("t"))
    totals = sized.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("t")).alias("mean_size"))
    hits = sized.select("doc_id", F.size("t").alias("size"), F.explode(F.filter("t", lambda w: w.isin(*wanted))).alias("w")).groupBy("doc_id", "size", "w").agg(F.count(F.lit(1)).alias("tf"))
    held = hits.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean_size")))
    return hits.join(F.broadcast(held), "w").join(F.broadcast(totals)).groupBy("doc_id").agg(F.sum(part).alias("score")).where("score > 0")


def overlap_score(words: Column, wanted: Column) -> Column:
    """Share of the wanted words among the words."""
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(words, wanted)) / F.size(wanted)).otherwise(0.0)


def top_k(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= k).drop("_r")
