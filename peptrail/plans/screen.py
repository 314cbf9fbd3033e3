"""Screening: classify, keep positives, compare all pairs up to a cap, rank, regress the best."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import cleaned_vector, pair_features
from ..operators import features, pairs, ranking
from ..operators.curate import Watch, unwatched
from .models import predict


def screen(rows: DataFrame, classifier: PipelineModel, comparator: PipelineModel, regressor: PipelineModel, best: int = 1000, cap: int = pairs.CAP, prefer: str = "faithful", watch: Watch = unwatched) -> DataFrame:
    """seq, mic (predicted), log2_mic, score, rank of the best of rows (seq_id, seq, features), by predicted mic.

    watch sees rows, positives, pairs and ranked on their way."""
    clean = watch("rows", rows).withColumn("features", cleaned_vector(F.col("features")))
    chosen = features.positives(predict(classifier, clean).withColumn("prediction", F.col("prediction").cast("int")))
    chosen = watch("positives", chosen.select("i", "seq_id", "seq", "features")).persist()
    met = watch("pairs", pairs.paired(chosen.select("i", "features"), ["features"], cap))
    compared = predict(comparator, met.select("ordinal", "i", "j", pair_features(F.col("features_i"), F.col("features_j")).alias("features")))
    ranked = watch("ranked", ranking.top(pairs.scored(chosen, compared, prefer=prefer), best))
    # The regressor's target is log2 of the value; both are given.
    out = predict(regressor, ranked).withColumnRenamed("prediction", "log2_mic").withColumn("mic", F.pow(F.lit(2.0), F.col("log2_mic")))
    return ranking.ordered_by_value(out.select("i", "seq", "mic", "log2_mic", "score", "rank"))
