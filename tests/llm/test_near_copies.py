"""Nearest neighbours where vectors are nearly alike."""

import numpy as np
import pytest

from tests.llm.test_models import recall


@pytest.mark.parametrize("cosine", [0.999, 0.9999])
def test_recall_in_a_cluster_of_near_copies(spark, cosine):
    r = np.random.default_rng(5)
    c = r.standard_normal(64)
    x = c / np.linalg.norm(c) + r.standard_normal((1500, 64)) * np.sqrt((1 / cosine - 1) / 64)
    assert recall(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")) > 0.9
