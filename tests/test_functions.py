import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstack.functions import arrays, sequence


def _eval(spark, values, fn):
    df = spark.createDataFrame([(values,)], "v array<double>")
    return df.select(fn(F.col("v")).alias("out")).first()["out"]


def _steps(fn):
    return lambda v: fn(sequence.to_steps(v))


def test_argmax_takes_the_first_of_ties(spark):
    assert _eval(spark, [0.4, 0.4, 0.2], arrays.argmax) == 0


def test_zero_rows_and_normalise(spark):
    assert _eval(spark, [0.0, 0.0], arrays.is_zero_row) is True
    assert _eval(spark, [0.0, 0.0], arrays.normalise) is None
    assert _eval(spark, [1.0, 3.0], arrays.normalise) == [0.25, 0.75]


def test_softmax_survives_large_logits(spark):
    out = _eval(spark, [1000.0, 1000.0, -1000.0], arrays.softmax)
    assert out == pytest.approx([0.5, 0.5, 0.0])


def test_utc_stamp_ignores_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        text = spark.range(1).select(arrays.utc_stamp().alias("t")).first()["t"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}Z", text)
    stamped = dt.datetime.fromisoformat(text)
    assert abs((dt.datetime.now(dt.timezone.utc) - stamped).total_seconds()) < 120


@pytest.mark.parametrize("n, shape", [(8, (2, 4)), (5, (1, 5)), (4, (1, 4)), (0, (0,))])
def test_reshape(spark, n, shape):
    assert np.array(_eval(spark, [float(i) for i in range(n)], sequence.to_steps)).shape == shape


def test_single_step_skips_instance_norm(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0]
    assert _eval(spark, values, _steps(sequence.instance_norm)) == [values]


@pytest.mark.parametrize("steps", [2, 5, 9])
def test_sequence_transforms_equal_numpy(spark, steps):
    x = np.random.default_rng(steps).normal(size=(steps, 4))
    flat = x.ravel().tolist()

    normed = (x - x.mean(axis=0)) / np.sqrt(x.var(axis=0) + 1e-5)
    assert np.allclose(_eval(spark, flat, _steps(sequence.instance_norm)), normed)

    shifted = np.vstack([np.zeros((1, 4)), x[:-1]])
    assert np.allclose(_eval(spark, flat, _steps(sequence.shift_right)), shifted)

    m = np.array([0.1, 0.5, 0.9, 1.0])
    mixed = _eval(spark, flat, _steps(lambda s: sequence.time_mix(s, m.tolist())))
    assert np.allclose(mixed, x * m + shifted * (1 - m))

    def conv(weights):
        padded = np.vstack([np.zeros((len(weights) - 1, 4)), x])
        return sum(w * padded[len(weights) - 1 - j :][:steps] for j, w in enumerate(weights))

    uniform = np.hstack([conv([1 / k] * k) for k in (3, 5, 7)])
    assert np.allclose(_eval(spark, flat, _steps(sequence.causal_conv)), uniform)
    custom = _eval(spark, flat, _steps(lambda s: sequence.causal_conv(s, [[0.5, -1.0, 2.0]])))
    assert np.allclose(custom, conv([0.5, -1.0, 2.0]))

    pooled = _eval(spark, flat, _steps(sequence.pooled_conv))
    assert np.allclose(pooled, uniform.mean(axis=0))
    weights = [[0.5, -1.0, 2.0], 4]
    pooled = _eval(spark, flat, _steps(lambda s: sequence.pooled_conv(s, weights)))
    assert np.allclose(pooled, np.hstack([conv(weights[0]), conv([0.25] * 4)]).mean(axis=0))

    assert np.allclose(_eval(spark, flat, _steps(sequence.pool_last)), x[-1])
    assert np.allclose(_eval(spark, flat, _steps(sequence.pool_mean)), x.mean(axis=0))
    patches = [x[i : i + 3].mean(axis=0) for i in range(0, steps, 3)]
    assert np.allclose(_eval(spark, flat, _steps(lambda s: sequence.patch_means(s, 3))), patches)


def test_sequence_features_stay_in_the_row(spark):
    df = spark.createDataFrame([([1.0] * 8,)], "v array<double>")
    plan = df.select(sequence.causal_conv(sequence.instance_norm(sequence.to_steps(F.col("v")))))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text
