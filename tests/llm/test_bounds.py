"""Bounded tables stay within their bounds and keep the most frequent rows."""

import numpy as np
from pyspark.sql import functions as F

from terralith.llm import language
from terralith.llm.common import least_levels, level_of


def test_least_levels(spark):
    rows = [("a", n) for n in (1, 1, 1, 2, 2, 5, 9, 100)] + [("b", 3)] * 7
    df = spark.createDataFrame(rows, "k string, n long")
    for limit in (0, 1, 3, 5, 8, 100):
        least = least_levels(df, "n", limit, "k")
        for key in ("a", "b"):
            mine = sorted(n for k, n in rows if k == key)
            kept = sorted(r["n"] for r in df.filter((F.col("k") == key) & (level_of("n") >= least[key])).collect())
            assert kept == mine[len(mine) - len(kept) :] and len(kept) <= limit
            more = [n for n in mine if n == (mine[len(mine) - len(kept) - 1] if len(kept) < len(mine) else None)]
            assert not more or len(kept) + len(more) > limit
    assert least_levels(df.limit(0), "n", 5) == {}


def test_small_models_back_off(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_GRAMS", 40)
    rows = [("en", f"the of and to in that number {i}") for i in range(60)] + [("fr", f"le la les des et une numero {i}") for i in range(60)]
    model = language.train(spark.createDataFrame(rows, "lang string, text string"))
    assert all(len(m.levels[4][0]) <= 40 for m in model.models.values())
    assert [p[0] for p in model.predict(["that and the", "les et des", "zzzz"])][:2] == ["en", "fr"]
    assert np.isfinite(model.cross_entropies(["zzzz qqqq"])[0]).all()
