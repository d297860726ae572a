"""Threshold policies: ordered rules whose gaps stay unclassified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Label, colour, least, most, least included, most included.
POLICIES = {
    "coastal": [
        ("Normal", "green", -0.7, 0.5, True, True),
        ("Amarillo", "yellow", 1.3, 2.0, True, True),
        ("Rojo", "red", 2.1, None, True, False),
    ],
    "basin": [
        ("Normal", "green", -0.5, 0.5, True, True),
        ("Amarillo", "yellow", 1.0, 1.5, False, True),
        ("Rojo", "red", 1.5, None, False, False),
    ],
    "thermocline": [
        ("Normal", "green", -20.0, 20.0, True, True),
        ("Amarillo", "yellow", 30.0, 50.0, True, True),
        ("Rojo", "red", 50.0, None, False, False),
    ],
    "soi": [
        ("Normal", "green", -7.0, 7.0, True, True),
        ("Rojo", "red", None, -7.0, False, False),
    ],
    "icen_official": [
        ("Frío intenso", "blue", None, -1.3, False, False),
        ("Frío moderado", "lightblue", -1.3, -1.1, True, False),
        ("Frío débil", "lightcyan", -1.1, -0.7, True, False),
        ("Normal", "green", -0.7, 0.5, True, True),
        ("Cálido débil", "yellow", 0.5, 1.3, False, True),
        ("Cálido moderado", "orange", 1.3, 2.1, False, True),
        ("Cálido fuerte", "red", 2.1, 3.5, False, True),
        ("Cálido extraordinario", "darkred", 3.5, None, False, False),
    ],
}
UNCLASSIFIED, NO_DATA, NO_COLOUR = "Sin clasificar", "Sin datos", "gray"
#: Policies that are sent to all tasks at most.
BROADCAST_POLICIES = 10_000
#: Policies of each indicator.
BRIDGE = [("nino12", "coastal"), ("nino12", "icen_official"), ("nino34", "basin"), ("d20", "thermocline"), ("soi", "soi")]


def rule_table(spark: SparkSession) -> DataFrame:
    """All rules as rows, in order: at most some tens."""
    rows = [(p, i, *rule) for p, rules in POLICIES.items() for i, rule in enumerate(rules)]
    return spark.createDataFrame(rows, "policy string, ord int, label string, color string, least double, most double, least_in boolean, most_in boolean")


def inside(v: Column, least, most, least_in: bool, most_in: bool) -> Column:
    low = F.lit(True) if least is None else (v >= least if least_in else v > least)
    high = F.lit(True) if most is None else (v <= most if most_in else v < most)
    return low & high


def evaluate(v: Column, policy: str) -> Column:
    """label, color, unclassified of the first rule that holds; no rule and no data are never green."""
    found = F.struct(F.lit(UNCLASSIFIED).alias("label"), F.lit(NO_COLOUR).alias("color"), F.lit(True).alias("unclassified"))
    for label, color, *limits in reversed(POLICIES[policy]):
        found = F.when(inside(v, *limits), F.struct(F.lit(label).alias("label"), F.lit(color).alias("color"), F.lit(False).alias("unclassified"))).otherwise(found)
    none = F.struct(F.lit(NO_DATA).alias("label"), F.lit(NO_COLOUR).alias("color"), F.lit(True).alias("unclassified"))
    return F.when(v.isNull() | F.isnan(v), none).otherwise(found)


def classified(v: Column, bands: list[tuple[str, float, float]]) -> Column:
    """The label of the first band with least <= v < most; the edge of an open last band counts; null when none holds."""
    inf = float("inf")
    hits = [F.when((v >= least) & (v < most), label) for label, least, most in bands] + [F.when(v == inf, label) for label, _, most in bands if most == inf]
    return F.when(v.isNotNull() & ~F.isnan(v), F.coalesce(*hits, F.lit(None).cast("string")))


def classify_by_rules(values: DataFrame, rules: DataFrame, value_col: str = "value") -> DataFrame:
    """The first matching rule of each row. The rules of a policy are one array, joined by the policy: broadcast up to BROADCAST_POLICIES of them."""
    v = F.col(value_col)
    listed = rules.groupBy("policy").agg(F.sort_array(F.collect_list(F.struct("ord", "label", "color", "least", "most", "least_in", "most_in"))).alias("_rules"))

    def fits(r: Column) -> Column:
        low = r["least"].isNull() | F.when(r["least_in"], v >= r["least"]).otherwise(v > r["least"])
        return low & (r["most"].isNull() | F.when(r["most_in"], v <= r["most"]).otherwise(v < r["most"]))

    few = listed.limit(BROADCAST_POLICIES + 1).count() <= BROADCAST_POLICIES
    joined = values.join(F.broadcast(listed) if few else listed, "policy", "left").withColumn("_rule", F.get(F.filter("_rules", fits), 0))
    return joined.select(
        *values.columns,
        F.when(v.isNull(), NO_DATA).otherwise(F.coalesce("_rule.label", F.lit(UNCLASSIFIED))).alias("label"),
        F.coalesce("_rule.color", F.lit(NO_COLOUR)).alias("color"),
        F.col("_rule").isNull().alias("unclassified"),
    )
