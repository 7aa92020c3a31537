"""Annotation looks through all texts in one pass."""

from loomwright.operators import joins
from loomwright.plans import annotate


def test_labels_before_sleeve_and_texts_in_one_pass(spark, monkeypatch):
    calls, one = [], joins.phrase_matches
    monkeypatch.setattr(annotate, "phrase_matches", lambda *a: calls.append(1) or one(*a))
    labels = spark.createDataFrame([("Length", "long"), ("Sleeve", "long"), ("Sleeve", "long sleeve"), ("Length", "knee long")], "attr string, label string")
    df = spark.createDataFrame([(1, "long", "a LONG Sleeve"), (2, "knee long sleeve", None), (3, "sleeve long", "long")], "id int, h string, m string")
    got = {(r["id"], r["attr"]): r["labels"] for r in annotate.annotated(df, labels, "id", {"h": 0, "m": 1}, alike=2.0).collect()}
    assert len(calls) == 1
    assert got == {(1, "Sleeve"): "LONG,LONG,LONG SLEEVE", (2, "Length"): "KNEE LONG", (2, "Sleeve"): "LONG,LONG SLEEVE", (3, "Length"): "LONG,LONG", (3, "Sleeve"): "LONG,LONG"}
