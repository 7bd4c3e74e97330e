"""Random Fourier features (Rahimi and Recht 2007): an explicit map for the Gaussian kernel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql.pandas.functions import pandas_udf


class RandomFourierFeatures(
    Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable
):
    """Maps a vector of ``dim`` features to ``size`` cosines with kernel width ``gamma``."""

    dim = Param(Params._dummy(), "dim", "input length", TypeConverters.toInt)
    size = Param(Params._dummy(), "size", "output length", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel coefficient", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, dim=None, size=256, gamma=None, seed=30):
        super().__init__()
        self._setDefault(size=256, seed=30)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        dim, size, gamma = (self.getOrDefault(p) for p in (self.dim, self.size, self.gamma))
        rng = np.random.default_rng(self.getSeed())
        weights = rng.normal(scale=np.sqrt(2 * gamma), size=(dim, size))
        offsets = rng.uniform(0, 2 * np.pi, size=size)

        @pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            mapped = np.sqrt(2 / size) * np.cos(np.array(x.tolist()) @ weights + offsets)
            return pd.Series(list(mapped))

        return dataset.withColumn(
            self.getOutputCol(), array_to_vector(project(vector_to_array(self.getInputCol())))
        )
