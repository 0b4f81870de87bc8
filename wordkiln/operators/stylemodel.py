"""A style classifier: TF-IDF of single words and pairs, logistic regression, as an ML pipeline that can be saved."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizerModel, IndexToString, Normalizer, SQLTransformer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import resources as R
from ..functions import text as X

FEATURES = 5000
NORMAL = "норм"


class StyleModel:
    """train, predict (style), probabilities (array of (style, p) to 3 places), save and load."""

    def __init__(self, model: PipelineModel | None = None):
        self.model = model

    @property
    def trained(self) -> bool:
        return self.model is not None

    @classmethod
    def train(cls, df: DataFrame, text: str = "text", label: str = "label", features: int = FEATURES, regularisation: float = 1e-3) -> StyleModel:
        """On all rows of df."""
        # tokens are a column of their own, so each pair is made of two of them and no text is split again
        words = "SELECT *, filter(split(lower(__t), '[^\\\\p{L}\\\\p{N}_]+'), w -> length(w) > 1) AS __w FROM __THIS__"
        pairs = "zip_with(slice(__w, 1, greatest(size(__w) - 1, 0)), slice(__w, 2, greatest(size(__w) - 1, 0)), (a, b) -> concat(a, ' ', b))"
        grams = f"SELECT *, concat(__w, {pairs}) AS __g FROM __THIS__"
        names = StringIndexer(inputCol=label, outputCol="__y", handleInvalid="skip").fit(df)
        split = Pipeline(stages=[SQLTransformer(statement=f"SELECT *, coalesce({text}, '') AS __t FROM __THIS__"), SQLTransformer(statement=words), SQLTransformer(statement=grams)]).fit(df)
        held = split.transform(df).persist()
        try:
            counted = Pipeline(stages=[cls._counter(held, features), IDF(inputCol="__c", outputCol="__i"), Normalizer(inputCol="__i", outputCol="__x")]).fit(held)
            ready = names.transform(counted.transform(held)).select("__x", "__y").persist()
            return cls(cls._fitted(split, counted, ready, names.labels, regularisation))
        finally:
            held.unpersist()

    @staticmethod
    def _counter(held: DataFrame, features: int) -> CountVectorizerModel:
        """What CountVectorizer would fit, equal counts by the term: its shuffle has as many tasks as the texts have, however
        many terms they hold, while a table's follows the session's settings."""
        counts = held.select(F.explode("__g").alias("g")).groupBy("g").agg(F.count("*").alias("n"))
        terms = [r["g"] for r in counts.orderBy(F.col("n").desc(), "g").limit(features).collect()]
        if not terms:
            raise ValueError("the style model needs a text with a word")
        return CountVectorizerModel.from_vocabulary(terms, "__g", "__c")

    @staticmethod
    def _fitted(split: PipelineModel, counted: PipelineModel, ready: DataFrame, labels: list[str], regularisation: float) -> PipelineModel:
        regression = LogisticRegression(featuresCol="__x", labelCol="__y", probabilityCol="__p", predictionCol="__k", rawPredictionCol="__r", family="multinomial", regParam=regularisation, maxIter=100).fit(ready)
        ready.unpersist()
        return PipelineModel([*split.stages, *counted.stages, regression, IndexToString(inputCol="__k", outputCol="style", labels=labels)])

    def _run(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise RuntimeError("the style model has to be trained or loaded first")
        return self.model.transform(df)

    def predict(self, df: DataFrame) -> DataFrame:
        return self._run(df).select(*df.columns, "style")

    def probabilities(self, df: DataFrame) -> DataFrame:
        labels = self.model.stages[-1].getLabels() if self.trained else []
        p = F.transform(vector_to_array("__p"), lambda x: F.round(x, 3))
        return self._run(df).select(*df.columns, F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), p).alias("probabilities"))

    def save(self, path: str) -> None:
        if self.model is None:
            raise RuntimeError("the style model has to be trained or loaded first")
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> StyleModel:
        return cls(PipelineModel.load(path))


def needs_normalizing(df: DataFrame, model: StyleModel | None = None, text: str = "text", resources: R.Resources = R.SEED, out: str = "needs") -> DataFrame:
    """df with out: whether the style isn't normal, or, without a model, whether normalising changes the text."""
    if model is None or not model.trained:
        return df.withColumn(out, X.normalized(F.col(text), resources)["changed"])
    return model.predict(df).withColumn(out, F.col("style") != NORMAL).drop("style")
