import random

import numpy as np
from pyspark.sql import functions as F

from netweir.llm import ordinal as O
from tests.llm.conftest import awkward_rows, prose


def graded(n, seed):
    """Grades 0, 1, 2 by how many of two kinds of marker words a text has."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        grade = r.choice([0, 1, 2, 2])
        words = prose(seed * 10_000 + i, 60).split()
        for _ in range(4):
            words[r.randrange(60)] = {0: "vile", 1: "dull", 2: "fine"}[grade] + r.choice(["", ",", "."])
        rows.append((i, " ".join(words), grade))
    return rows


def test_held_out_rows(spark):
    train = spark.createDataFrame(graded(600, 1), "doc_id long, text string, grade int")
    test = spark.createDataFrame(graded(300, 2), "doc_id long, text string, grade int")
    model = O.fit(train, train.select("doc_id", "grade"))
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    rows = O.score(test, model, ["doc_id", "grade"]).collect()
    right = np.mean([(r.tail_probability >= 0.5) == (r.grade == 2) for r in rows])
    means = [np.mean([r.expected_grade for r in rows if r.grade == g]) for g in (0, 1, 2)]
    assert right > 0.93 and means[0] < means[1] < means[2]


def test_sample_bound(spark):
    train = spark.createDataFrame(graded(50, 3), "doc_id long, text string, grade int")
    assert O.sample(train, train.select("doc_id", "grade"), "doc_id", "text", "grade", 20, 5).count() == 20


def test_awkward_rows(awkward, nothing):
    labels = awkward.select("doc_id", (F.col("doc_id") % 2).alias("grade"))
    model = O.fit(awkward, labels)
    assert O.score(awkward, model, ["doc_id"]).count() == len(awkward_rows())
    none = O.fit(awkward, labels.limit(0))
    assert {r.expected_grade for r in O.score(awkward, none, ["doc_id"]).collect()} == {0.0}
    assert O.score(nothing, model, ["doc_id"]).count() == 0
