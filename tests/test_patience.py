"""Boosting with patience: the round chosen, and the model of that round."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadstats.operators.models import patient_round, train_with_patience


def test_noisy_losses():
    assert patient_round([5, 4, 4.5, 4.2, 3.9, 4.1, 4.0, 4.0], 3) == (5, True)      # past two rounds without gain
    assert patient_round([5, 4, 4.5, 4.2, 4.4, 1.0], 3) == (2, True)                # a later gain comes too late
    assert patient_round([5, 4, 4.5, 4.2, 4.4, 1.0], 4) == (6, False)
    assert patient_round([3, 3, 3], 2) == (1, True)                                 # ties: the earliest
    assert patient_round([float("nan"), 2.0, float("nan")], 5) == (2, False)
    assert patient_round([], 5) == (1, False)


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(1)
    n = 900
    x = rng.standard_normal((n, 3))
    y = 2 * x[:, 0] + np.sin(3 * x[:, 1]) + rng.standard_normal(n) * 1.5
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "demand": y, "held": np.arange(n) % 3 == 0})
    return spark.createDataFrame(pdf).coalesce(2).checkpoint()


def test_model_is_that_of_the_best_round(spark, noisy):
    model, table = train_with_patience(noisy, ["a", "b", "c"], "held", patience=4, max_iter=64, max_depth=3, step=0.4)
    rounds = table.orderBy("round").collect()
    losses = [r["loss"] for r in rounds]
    best, ended = patient_round(losses, 4)
    assert ended and len(losses) > best + 3 and [r["round"] for r in rounds if r.is_chosen] == [best]
    assert model.stages[-1].getNumTrees == best
    # the shorter fit is the beginning of the longer: its loss is the one that the table tells
    err = model.transform(noisy.where("held")).agg(F.avg(F.pow(F.col("demand") - F.col("prediction"), 2))).first()[0]
    assert err == pytest.approx(losses[best - 1], rel=1e-9)


def test_round_limit_and_no_validation(spark, noisy):
    model, table = train_with_patience(noisy, ["a", "b"], "held", patience=50, max_iter=6, max_depth=2)
    assert table.count() == 6 and model.stages[-1].getNumTrees == table.where("is_chosen").first()["round"]
    with pytest.raises(ValueError):
        train_with_patience(noisy.where("NOT held"), ["a"], "held")
