"""JSON whose fields and types drift, by way of VARIANT columns.

A text is parsed once into a variant, which keeps what each row has. A field of the result names the places where it has
been, newest first, and its type; the first place that holds a value of that type, or one that can be cast to it, counts.
What the rows hold as a whole is inferred over all of them, so new fields and types show.

Defined cases: text that is no JSON is a null variant and counted as such; a value that can't be cast is passed over; a
missing field is null; of a field that is twice in one object parsing takes none, so the row counts as no JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(rows: DataFrame, text_col: str, out: str = "doc") -> DataFrame:
    return rows.withColumn(out, F.try_parse_json(text_col))


def field(doc: str, places: list[str], kind: str) -> Column:
    """The value of a field (paths such as $.a.b or $.list[0]) as a type."""
    return F.coalesce(*(F.try_variant_get(doc, at, kind) for at in places))


def normalised(rows: DataFrame, text_col: str, fields: dict[str, tuple[list[str], str]]) -> DataFrame:
    """rows with a column for each field, and is_json. The text is parsed once."""
    doc = "_doc"
    found = parsed(rows, text_col, doc)
    return found.select(*rows.columns, F.col(doc).isNotNull().alias("is_json"), *(field(doc, places, kind).alias(name) for name, (places, kind) in fields.items()))


def schema_over(rows: DataFrame, text_col: str) -> DataFrame:
    """One row: the schema that holds for all rows, and how many are no JSON."""
    return parsed(rows, text_col, "_doc").agg(F.schema_of_variant_agg("_doc").alias("schema"), F.count_if(F.col(text_col).isNotNull() & F.col("_doc").isNull()).alias("not_json"))


def paths(rows: DataFrame, text_col: str) -> DataFrame:
    """name, kind, n: the fields of the outermost objects, and the types that they have. New names and types show as rows."""
    docs = parsed(rows, text_col, "_doc").where(F.col("_doc").isNotNull()).select("_doc")
    each = docs.lateralJoin(docs.sparkSession.tvf.variant_explode_outer(F.col("_doc").outer()))
    return each.groupBy(F.col("key").alias("name"), F.schema_of_variant("value").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def grouped_history(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """By keys: the number of known scores, the least, the largest and their mean."""
    known = rows.where(F.col(score).isNotNull())
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(score).alias("least"), F.max(score).alias("most"), F.avg(score).alias("mean"))
