"""The bounds of the fits hold for rows, also where many share one key."""

from pyspark.sql import functions as F

from framestory.llm import language, toxicity


def test_language_fit_takes_one_row_per_key(spark):
    rows = [(i, "the gate of the station", "en") for i in range(3)] + [(7, f"the hot key number {'x' * i}", "en") for i in range(40)] + [(7, "die Tür", "de")] * 40
    d = spark.createDataFrame(rows, "failure_id long, notes string, lang string")
    model = language.fit_language(d, max_rows=4)
    assert model.languages == ["de", "en"] and len(model.landmarks) == 4
    assert len(language.fit_language(d).landmarks) == 5


def test_toxicity_fit_takes_one_row_per_key(spark):
    rows = [(i, f"you idiot scum {i}" if i % 4 == 0 else f"a calm note {i}") for i in range(40)]
    hot = [(3, f"an idiot again {i % 50}") for i in range(200)] + [rows[3]] * 100
    d = spark.createDataFrame(rows + hot, "failure_id long, notes string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "failure_id long, toxic int")
    one = d.groupBy("failure_id").agg(F.min_by("notes", F.xxhash64("notes")).alias("notes"))
    assert toxicity.fit_chain(d, labels, ["toxic"]) == toxicity.fit_chain(one, labels, ["toxic"])
