import itertools
import random

from pyspark.sql import functions as F

from tidemark.operators import revisions as R

SCHEMA = "k string, valid_from int, valid_to int, v double, flag string, known_from int, withdrawn boolean"


def test_three_dates_three_answers(spark, tmp_path):
    table = R.table(spark, str(tmp_path / "r"), "t", ["k", "valid_from", "valid_to"], ["v", "flag"], 4)
    batch = lambda *rows: spark.createDataFrame([("a", 1, 2, *r) for r in rows], SCHEMA)
    table.merge(batch((1.0, "preliminary", 10, False)))
    table.merge(batch((3.0, "corrected", 30, False)))
    table.merge(batch((2.0, "final", 20, False)))  # arrives after the correction, and splits what was known
    answers = lambda: [[r["v"] for r in table.as_known(F.lit(at)).collect()] for at in (9, 10, 19, 20, 29, 30, 99)]
    assert answers() == [[], [1], [1], [2], [2], [3], [3]]
    assert [r["v"] for r in table.as_known(F.lit(25), F.lit(1)).collect()] == [2] and table.as_known(F.lit(25), F.lit(2)).count() == 0
    for _ in range(2):  # again, and a repeated statement: nothing new
        table.merge(batch((2.0, "final", 20, False), (2.0, "final", 22, None)))
    assert answers() == [[], [1], [1], [2], [2], [3], [3]] and R.joined(table.rows(), table.keys, table.values).count() == 3
    table.merge(batch((None, None, 40, True)))
    assert table.as_known(F.lit(50)).count() == 0 and [r["v"] for r in table.as_known(F.lit(39)).collect()] == [3]
    assert table.merge(batch().limit(0)) is None and table.rows(table.store.current() - 1).count() == 4
    assert R.revision_sizes(table.rows(), ["k"], "v").first()[1:] == (2, 1.0, 3.0, 2.0)


def test_order_of_batches_does_not_matter(spark):
    r = random.Random(6)
    rows = [(r.choice("ab"), r.choice([1, 2]), 9, r.choice([1.0, 2.0, None]), "f", r.randint(1, 6), r.random() < 0.2) for _ in range(40)]
    rows += [(None, 1, 9, 1.0, "f", 1, False), ("a", 1, 9, 1.0, "f", None, False)]
    keys, values = ["k", "valid_from"], ["v", "flag"]
    whole = sorted(map(repr, R.revised(spark.createDataFrame(rows, SCHEMA), keys, values).collect()))
    for cut in (10, 25):
        for parts in itertools.permutations([rows[:cut], rows[cut:]]):
            held = None
            for part in parts:
                said = spark.createDataFrame(part, SCHEMA).select("k", "valid_from", "v", "flag", "known_from", "withdrawn")
                held = R.revised(said if held is None else held.drop("known_to").unionByName(said), keys, values)
            assert sorted(map(repr, held.collect())) == whole
    again = R.joined(final := R.revised(spark.createDataFrame(rows, SCHEMA), keys, values), keys, values)
    assert 0 < again.count() < final.count()
    # At each time what holds is the last statement for it.
    for at in range(0, 8):
        got = {(x["k"], x["valid_from"]): x["v"] for x in R.as_known(final, F.lit(at)).collect()}
        assert got == {(x["k"], x["valid_from"]): x["v"] for x in R.as_known(again, F.lit(at)).collect()}
        want = {}
        for key in {(x[0], x[1]) for x in rows if x[0]}:
            known = [x for x in rows if (x[0], x[1]) == key and x[5] is not None and x[5] <= at]
            if known:
                last = max(known, key=lambda x: (x[5], not x[6], x[3] is not None, x[3] or 0))
                if not last[6]:
                    want[key] = last[3]
        assert got == want
