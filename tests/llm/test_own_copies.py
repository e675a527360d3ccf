"""Top-k: rows with a query's own id take no place of others."""

import numpy as np
from pyspark.sql import functions as F

from panelweave.llm import top_k


def test_own_copies_take_no_place(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(7, [float(v) for v in x[7]])] * 25
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = [(r["vec_id"], r["score"]) for r in top_k.top_k(table, F.col("vec_id") == 7).orderBy("rank").collect()]
    whole = np.floor(1024 * x)
    scores = whole @ whole[7]
    order = [i for i in np.lexsort((np.arange(300), -scores)) if i != 7][:10]
    assert got == [(int(i), int(scores[i])) for i in order]
