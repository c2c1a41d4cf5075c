"""What op13's rounds send: anchors go to a shelf of parts once, in blocks, and nothing of it is broadcast."""

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import negatives


def test_anchors_go_to_a_shelf_once(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CELL_SIZE", 8)
    monkeypatch.setattr(negatives, "PART_BYTES", 16 * 80)
    monkeypatch.setattr(negatives, "SHELVES", 4)
    kept = {}
    put = negatives.written
    monkeypatch.setattr(negatives, "written", lambda df, name: kept.setdefault(name, []).append(put(df, name)) or kept[name][-1])
    v = np.random.default_rng(3).normal(size=(400, 16))
    rows = spark.createDataFrame([(i, i % 2, x.tolist()) for i, x in enumerate(v / np.linalg.norm(v, axis=1)[:, None])], "vec_id long, label int, embedding array<double>")
    made = negatives.hard_negatives(rows, every=5)
    assert made.count() > 0
    start = kept["negatives-anchors"][0]
    anchors, blocks = start.agg(F.sum(F.octet_length("rows") / 8)).first()[0], start.count()
    assert anchors == 80 and blocks <= 2 * 4 * 2  # two labels, four ranges of anchors, which labels may cross
    for asked in kept["negatives-asked"]:
        sent = asked.where("shelf >= 0")
        assert sent.count() == sent.select("block", "shelf").distinct().count()
        places = sent.select("block", "shelf", F.explode("places").alias("place"))
        assert places.count() == places.distinct().count()
    shelves = kept["negatives-parts"][0].select("shelf").distinct().count()
    largest = max(asked.where("shelf >= 0").agg(F.coalesce(F.sum(F.octet_length("anchors") / 8), F.lit(0))).first()[0] for asked in kept["negatives-asked"])
    assert largest <= anchors * shelves < anchors * kept["negatives-parts"][0].count()
    met = negatives.met(kept["negatives-asked"][0], kept["negatives-parts"][0])
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
