"""Batch scoring with a fitted pipeline."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgrove.functions.names import check_distinct, ml_name
from tabgrove.operators.lookup import BROADCAST_BYTES, dictionary_table, with_label


def pipeline_labels(model: PipelineModel) -> list[str]:
    """The label dictionary of a fitted pipeline, by index."""
    return next(s for s in model.stages if isinstance(s, StringIndexerModel)).labels


def pipeline_forest(model: PipelineModel) -> RandomForestClassificationModel:
    return next(s for s in model.stages if isinstance(s, RandomForestClassificationModel))


def score_batch(
    model: PipelineModel, df: DataFrame, predicted: str = "predicted", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """All input columns plus what the stages add and ``predicted``, the label's text.

    Vectors come out as arrays, so that the result can be written anywhere. Lazy; columns
    nobody selects are not computed. The label's text comes from a join with the model's
    dictionary, without a shuffle of the rows while that is at most ``broadcast_bytes``
    (see ``lookup``). A table without the
    label column can be scored too, it just gets no ``label``. Every row stays: where a
    model that skips invalid features meets one, what it would predict is NULL. An added
    column that is named like an input column, in any case, raises.
    """
    forest = pipeline_forest(model)
    vectors = (forest.getFeaturesCol(), forest.getRawPredictionCol(), forest.getProbabilityCol())
    stages, features, added = [], [], [*filter(None, vectors), forest.getPredictionCol(), predicted]
    for stage in model.stages:
        # A copy has no training summary. That of a forest of two labels holds the session,
        # which tasks cannot be sent once anything in it was observed.
        stage = stage.copy()
        if isinstance(stage, VectorAssembler):
            features = stage.getInputCols()
            if stage.getHandleInvalid() == "skip":
                stage.setHandleInvalid("keep")
        elif isinstance(stage, StringIndexerModel):
            if ml_name(stage.getInputCol()) in {ml_name(name) for name in df.columns}:
                added.append(stage.getOutputCol())
            if stage.getHandleInvalid() == "skip":
                stage.setHandleInvalid("keep")
        stages.append(stage)
    check_distinct(df.sparkSession, [*df.columns, *added])
    scored = PipelineModel(stages).transform(df)
    valid = F.lit(True)
    for name in features:
        valid &= F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double"))
    results = {name: vector_to_array(name) for name in vectors if name}
    results[forest.getPredictionCol()] = F.col(forest.getPredictionCol())
    features_col = forest.getFeaturesCol()
    scored = scored.withColumns(
        {name: c if name == features_col else F.when(valid, c) for name, c in results.items()}
    )
    labels = dictionary_table(df.sparkSession, pipeline_labels(model))
    return with_label(scored, forest.getPredictionCol(), labels, predicted, broadcast_bytes)
