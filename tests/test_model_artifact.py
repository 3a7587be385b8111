"""A saved model gives the scores that it gave before."""

from __future__ import annotations

import numpy as np

from tidewell.operators import models


def test_a_loaded_model_scores_as_before(spark, tmp_path):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(a), float(b), int(a + b > 0)) for i, (a, b) in enumerate(r.normal(size=(200, 2)))], "i long, x double, y double, label int")
    for kind, pipeline in (("logistic", models.logistic(["x", "y"])), ("boosted", models.boosted(["x", "y"], rounds=2, depth=2))):
        model = pipeline.fit(df)
        models.save(model, str(tmp_path / kind), ["x", "y"], 0.35)
        again, features, tau = models.load(spark, str(tmp_path / kind))
        before, after = ({q.i: q.proba for q in models.predict(m, df).collect()} for m in (model, again))
        assert before == after and features == ["x", "y"] and tau == 0.35
