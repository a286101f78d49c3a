"""Feature maps: scaled principal components and k-means of vectors, TF-IDF clusters of texts (Spark ML)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import unwrap_udt

from ..session import Workspace


def pca_clusters(df: DataFrame, vector: str, k: int = 5, seed: int = 7) -> DataFrame:
    """``df`` with ``pc`` (two components of the scaled vectors) and ``cluster``; null or empty vectors are left out."""
    rows = df.where(F.size(vector) > 0).withColumn("_v", array_to_vector(F.col(vector)))
    steps = [StandardScaler(inputCol="_v", outputCol="_s", withMean=True), PCA(k=2, inputCol="_s", outputCol="_p"), KMeans(k=k, seed=seed, featuresCol="_s", predictionCol="cluster")]
    out = Pipeline(stages=steps).fit(rows).transform(rows)
    return out.withColumn("pc", vector_to_array("_p")).drop("_v", "_s", "_p")


#: Cells all words and pairs of words are hashed into.
WIDTH = 2**16


def term_counts(text: str, width: int = WIDTH) -> list:
    """Stages that count every word and pair of words of ``text`` in ``_c``, hashed into ``width`` cells: none is left out, and
    the model's size does not follow the corpus."""
    return [
        RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[^\p{L}\p{N}_]+"), NGram(n=2, inputCol="_w", outputCol="_b"),
        SQLTransformer(statement="SELECT *, concat(_w, _b) AS _t FROM __THIS__"), HashingTF(inputCol="_t", outputCol="_c", numFeatures=width),
    ]


def text_clusters(df: DataFrame, text: str, k: int = 5, seed: int = 7, width: int = WIDTH) -> DataFrame:
    """``df`` with ``cluster``: k-means of normalised TF-IDF over all words and pairs of words, and ``sv``: the two leading
    coordinates of a truncated singular value decomposition of the same matrix, fitted on all rows."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    rows = df.where(F.length(F.trim(text)) > 0)
    steps = [*term_counts(text, width), IDF(inputCol="_c", outputCol="_i"), Normalizer(inputCol="_i", outputCol="_n")]
    made = Workspace(df.sparkSession, "terms").save(Pipeline(stages=steps).fit(rows).transform(rows).drop("_w", "_b", "_t", "_c", "_i"), "weighted")
    out = KMeans(k=k, seed=seed, featuresCol="_n", predictionCol="cluster").fit(made).transform(made)
    v = RowMatrix(made.select("_n").rdd.map(lambda r: Vectors.fromML(r[0])), numCols=width).computeSVD(2, computeU=False).V.toArray()

    @F.pandas_udf("array<double>")
    def project(x: pd.DataFrame) -> pd.Series:
        at = lambda i, w: v if i is None else v[i]
        return pd.Series([(np.asarray(w) @ at(i, w)).tolist() for i, w in zip(x["indices"], x["values"])])

    return out.withColumn("sv", project(unwrap_udt(F.col("_n")))).drop("_n")


def composition(df: DataFrame, cluster: str, label: str) -> DataFrame:
    return df.groupBy(cluster, label).agg(F.count("*").alias("n"))


def average_hash(vector):
    """Bit string of a feature vector, a bit for each of its values: 1 where a value is above the vector's mean."""
    mean = F.aggregate(vector, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(vector)
    return F.array_join(F.transform(vector, lambda v: F.when(v.cast("double") > mean, "1").otherwise("0")), "")
