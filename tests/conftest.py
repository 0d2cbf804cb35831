import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tabloom.session import local_session

    s = local_session(cpus=8, memory="6g")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def skewed(spark):
    """600 rows, a third of them under one key, with ties in time and value and some NULL values."""
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(7)
    k = ["hot"] * 200 + [f"k{i}" for i in r.integers(0, 40, 400)]
    pdf = pd.DataFrame({"id": range(600), "k": k, "t": r.integers(0, 90, 600), "v": r.integers(-5, 6, 600).astype(float)})
    pdf.loc[r.random(600) < 0.1, "v"] = None
    df = spark.createDataFrame(pdf).selectExpr("id", "k", "t", "nullif(v, double('NaN')) as v")
    return df, pdf
