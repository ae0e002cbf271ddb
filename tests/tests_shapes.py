"""Fields that several tests cut."""

import numpy as np


def field(spark, f, n, step=1):
    g = np.indices((n, n, n)).reshape(3, -1).T
    values = f(*(g * step).T.astype(float))
    return spark.createDataFrame([(*map(int, p), float(v)) for p, v in zip(g, values)], "i long, j long, k long, value double")
