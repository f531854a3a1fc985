"""Principal components of a pipeline."""

from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array

from exprlake.operators import models as mo


def test_components_of_a_pipeline(spark):
    """Several folds at a time, a column that never changes; no step of the JVM's LAPACK."""
    x = np.random.default_rng(1).normal(size=(60, 6)) * [5, 3, 2, 1, 0.5, 0] + 4
    df = spark.createDataFrame(pd.DataFrame({"key": range(60), "v": x.tolist()})).withColumn("x", array_to_vector("v")).repartition(4)

    def fit(_):
        model = mo.PrincipalComponents(inputCol="x", outputCol="pc", k=3).fit(df)
        rows = model.transform(df).select("key", vector_to_array("pc").alias("pc")).orderBy("key").collect()
        return np.array([r["pc"] for r in rows])

    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    vt = vt[:3] * np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(1)])[:, None]
    with ThreadPool(4) as pool:
        for got in pool.map(inheritable_thread_target(spark)(fit), range(4)):
            assert np.allclose(got, x @ vt.T)
    names = [type(s).__name__ for s in mo.scaled_pca_logistic("x", "y").getStages()]
    assert "PCA" not in names and "PrincipalComponents" in names
