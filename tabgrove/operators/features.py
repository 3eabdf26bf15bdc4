"""Choosing feature columns and assembling them into vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgrove.functions.names import ml_name, quoted


def select_features(
    df: DataFrame,
    label: str,
    features: Sequence[str] | None = None,
    allow_label_feature: bool = False,
) -> list[str]:
    """The checked feature list; by default every column but the label.

    A label among its own features hands the answer to the model, so it raises unless
    ``allow_label_feature`` is set.
    """
    chosen = [name for name in df.columns if name != label] if features is None else list(features)
    if not chosen:
        raise ValueError("no feature columns")
    missing = [name for name in chosen if name not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    if label in chosen and not allow_label_feature:
        raise ValueError(f"label {label!r} is among the features; set allow_label_feature to insist")
    return chosen


def build_assembler(
    features: Sequence[str], output: str = "features", handle_invalid: str = "error"
) -> VectorAssembler:
    """The assembly stage. By default a NULL or NaN feature raises when rows are assembled."""
    return VectorAssembler(
        inputCols=[ml_name(name) for name in features],
        outputCol=output,
        handleInvalid=handle_invalid,
    )


def assemble(
    df: DataFrame, features: Sequence[str], output: str = "features", handle_invalid: str = "error"
) -> DataFrame:
    return build_assembler(features, output, handle_invalid).transform(df)


def assemble_long(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], handle_invalid: str = "error"
) -> DataFrame:
    """Assembled features in long form: the keys, ``pos`` and ``value`` per vector element."""
    vectors = assemble(df, features, "features", handle_invalid)
    return vectors.select(
        *(F.col(quoted(key)) for key in keys),
        F.posexplode(vector_to_array("features")).alias("pos", "value"),
    )
