"""The thresholds of the quality classifier rest on all held-out trusted documents."""

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tremorlake.llm import quality


def test_all_held_out_documents_set_the_thresholds(spark):
    n = 400
    docs = spark.createDataFrame([(i, "en", prose(i, 20, 20 + i)) for i in range(n)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(n)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels, sample=20, perplexity_q=0.8).withColumn("held", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)) == 1).toPandas()
    assert len(got) == n and got.held.sum() > 100
    assert (got.keep == (got.perplexity <= np.quantile(got.perplexity[got.held], 0.8) + 1e-9)).all()
