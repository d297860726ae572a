import random

import pytest

WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you".split()


@pytest.fixture(scope="session")
def corpus(spark):
    """A small table of documents with nulls, empty and long texts, copies, near copies, repeats and extra columns."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvz") for _ in range(r.randint(1, 9))) if r.random() < 0.6 else r.choice(WORDS)
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(30)
    rows = []
    for i in range(120):
        body = text(r.randint(3, 80))
        if i % 6 == 0:
            body += "\nCommon Line " + ("\t" if i % 12 else "") + "\n" + text(4)
        if i % 5 == 0:
            body = shared + "\n" + body
        rows.append((i, body, ["en", "de", None][i % 3], ["b", "a", None, "b", "b"][i % 5], 1.0, "x"))
    base = text(60).split()
    for i in range(120, 150):
        words = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 8])):
            words[r.randrange(60)] = word()
        rows.append((i, " ".join(words) + ("  " if i % 2 else ""), "en", "b", 2.0, "y"))
    rows += [(200, None, "en", "a", 0.0, None), (201, "", None, None, 0.0, None), (202, " \t\n ", "de", "c", 0.0, ""), (203, "one", "de", "c", 0.0, "")]
    rows += [(204, "One", "de", "c", 0.0, ""), (205, text(6000) + " 'tis don't 漢字かな交じり文 😀", "en", "b", 0.0, "long"), (3, rows[3][1], "en", "b", 1.0, "again")]
    rows += [(None, rows[4][1], "en", "b", 0.0, None)]
    schema = "doc_id long, text string, lang string, source string, score double, _salt string"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark, corpus):
    return spark.createDataFrame([], corpus.schema)
