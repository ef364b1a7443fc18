import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from torquelog.operators import learning

WORDS = {"door": "hinge latch gasket", "fan": "blade motor noise", "control": "display button menu"}


@pytest.fixture(scope="module")
def reports(spark):
    rng = random.Random(1)
    rows = []
    for i in range(150):
        system = rng.choice(list(WORDS))
        words = [rng.choice(WORDS[system].split()) for _ in range(4)] + [rng.choice(["unit", "part"])]
        rows.append((i, system, f"{system}-{words[0]}", " ".join(words)))
    return spark.createDataFrame(rows, "id int, system string, part string, note string").cache()


@pytest.mark.parametrize(
    ("kind", "weighted", "options"),
    [("forest", False, {"numTrees": 10, "maxDepth": 5}), ("logistic", True, {"maxIter": 20})],
)
def test_train_score_save(spark, reports, tmp_path, kind, weighted, options):
    model = learning.train(reports, "note", "system", kind, weighted, **options)
    assert learning.label_names(model) == ["control", "door", "fan"]
    path = str(tmp_path / "model")
    learning.save(model, path)
    again = learning.load_model(path)
    assert learning.predict_one(spark, again, "hinge and gasket", "note") == "door"
    extra = spark.createDataFrame([(900, "  "), (901, None), (902, "motor noise")], "id int, note string")
    got = {r["id"]: r for r in learning.score(extra, again, "note").collect()}
    assert set(got) == {900, 901, 902}
    assert got[900]["predicted"] is None and got[901]["top_predictions"] is None
    assert got[900]["note"] == "  " and got[901]["note"] is None
    top = got[902]["top_predictions"]
    assert top[0]["label"] == got[902]["predicted"] == "fan"
    assert len(top) == 3 and abs(sum(x["prob"] for x in top) - 1) < 1e-6


def test_two_stages(spark, reports):
    models = learning.train_two_stage(reports, "note", "system", "part", maxIter=10)
    got = learning.score_two_stage(reports.select("id", "note"), models, "note").collect()
    assert len(got) == 150
    assert all(r["part"].startswith(r["system"]) for r in got)


def test_features_follow_the_formula(spark):
    docs = ["oven door door", "oven fan the", "fan blade of", ""]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, note string")
    model = learning.fit_features(df, "note")
    names = model.stages[2].vocabulary
    assert sorted(names) == ["blade", "door", "fan", "oven"]  # no stop words
    weight = {"oven": 2, "fan": 2, "door": 1, "blade": 1}
    weight = {w: math.log(5 / (n + 1)) for w, n in weight.items()}
    for row in model.transform(df).collect():
        counts = Counter(w for w in docs[row["id"]].split() if w in weight)
        raw = {w: c * weight[w] for w, c in counts.items()}
        size = math.sqrt(sum(x * x for x in raw.values())) or 1
        got = dict(zip(names, row["features"].toArray()))
        assert got == pytest.approx({w: raw.get(w, 0) / size for w in names})


def test_weights_reach_the_classifier(spark, reports):
    few = reports.where("system <> 'fan' or id % 10 = 0")
    model = learning.train(few, "note", "system", "logistic", weighted=True, maxIter=20)
    assert model.stages[-2].getWeightCol() == "_weight"
    assert learning.predict_one(spark, model, "blade noise", "note") == "fan"


def test_unknown_classifier(spark, reports):
    with pytest.raises(ValueError):
        learning.train(reports, "note", "system", "network")


@pytest.mark.parametrize("kind", ["logistic", "forest"])
def test_the_fits_read_stored_counts(spark, kind):
    """The text is made twice, for the words and for their counts, however many passes the fits take."""
    seen = spark.sparkContext.accumulator(0)

    def read(value):
        seen.add(1)
        return value

    data = [(i, "ab"[i % 2], f"word{i % 2} thing{i % 7}") for i in range(40)]
    df = spark.createDataFrame(data, "id int, g string, t string")
    df = df.withColumn("t", F.udf(read, "string")("t"))
    options = {"numTrees": 3} if kind == "forest" else {"maxIter": 5}
    learning.train(df, "t", "g", kind, **options)
    assert seen.value <= 2 * len(data)
