import itertools
import math
import random

import pytest

from vicinity.operators import tagger as T

NAMES = [("Anna Berson", ["PERSON", "PERSON"]), ("Estate Of Carl Derson", ["O", "O", "PERSON", "PERSON"]), ("Emil F Gerson", ["PERSON"] * 3),
         ("Ironia Works", ["ORGANIZATION"] * 2), ("Coppia Mill Works", ["ORGANIZATION"] * 3), ("The Tinnia Guild", ["O", "ORGANIZATION", "ORGANIZATION"]),
         ("Zincia Guild 7", ["ORGANIZATION", "ORGANIZATION", "O"]), ("left out", ["O"]), (None, ["O"])]


@pytest.fixture
def fitted(spark):
    return T.fit_tagger(spark.createDataFrame(NAMES, "name string, tags array<string>"), "name", "tags")


def test_path_is_the_best_of_all(spark, fitted):
    rng = random.Random(4)
    words = [w for n, _ in NAMES if n for w in n.split()] + ["Herson", "Leadia", "x9", "Q", "Unknown"]
    names = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(60)})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    odds = {r["name"]: r["odds"] for r in fitted.log_odds(df, "name").collect()}
    got = {r["name"]: r["tags"] for r in fitted.tag(df, "name").collect()}
    for n in names:
        def score(path):
            steps = ["^", *path, "$"]
            return sum(fitted.steps[a, b] for a, b in zip(steps, steps[1:])) + sum(o[fitted.tags.index(t)] for o, t in zip(odds[n], path))
        best = max(score(p) for p in itertools.product(fitted.tags, repeat=len(odds[n])))
        assert len(got[n]) == len(n.split()) and math.isclose(score(got[n]), best, rel_tol=1e-12)


def test_unmet_words_go_by_their_shape(spark, fitted):
    df = spark.createDataFrame([("Hanna Herson", 1), ("Nickelia Works", 2), ("", 3), (None, 4), ("Hanna Herson", 5), ("Anna", 6)], "name string, tags int")
    got = {r["tags"]: r["entity"] for r in fitted.entities(df, "name").collect()}
    assert got == {1: "PERSON", 2: "ORGANIZATION", 3: None, 4: None, 5: "PERSON", 6: None}


def test_no_examples(spark):
    with pytest.raises(ValueError):
        T.fit_tagger(spark.createDataFrame([], "name string, tags array<string>"), "name", "tags")
