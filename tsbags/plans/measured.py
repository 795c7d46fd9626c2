"""Runs that measure themselves: accuracy, seconds of training, and seconds a series of scoring."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tsbags.operators import classify
from tsbags.plans.bopf import score
from tsbags.plans.common import Model
from tsbags.session import cut


def run(dataset: str, run_id: str, train: DataFrame, test: DataFrame, fit: Callable[[DataFrame], Model]) -> tuple[Model, DataFrame]:
    """The model, and (dataset, run_id, variant, accuracy, train_s, test_s_per_series): a row per variant.

    train_s is the time until every table of the model is written. Scoring writes its predictions; that job's own
    observed count of rows, a row per variant and series, says by how many series its time is divided.
    """
    begin = time.perf_counter()
    fitted = fit(train)
    model = Model(*[cut(getattr(fitted, name)) for name in Model.__dataclass_fields__])
    train_s = time.perf_counter() - begin
    variants = model.methods.select("variant").distinct().count()
    seen = Observation()
    begin = time.perf_counter()
    said = cut(score(model, test).observe(seen, F.count(F.lit(1)).alias("rows")))
    each = (time.perf_counter() - begin) / max(seen.get["rows"] // max(variants, 1), 1)
    rows = classify.accuracy(said, test.select("series_id", "label"), ("variant",))
    return model, rows.select(
        F.lit(dataset).alias("dataset"), F.lit(run_id).alias("run_id"), "variant", "accuracy", F.lit(train_s).alias("train_s"), F.lit(each).alias("test_s_per_series"),
    )
