"""Plans of the pixel pipeline: one read of the source, and hardly a shuffle after it."""

import pytest

from surco.operators import curve as C
from surco.plans import curve_queries as Q


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name, most", [("windows", 1), ("medians", 1), ("names", 1), ("wide", 2)])
def test_pixel_plans_read_the_store(spark, sf_dir, monkeypatch, name, most):
    reads = []
    view = Q.view
    monkeypatch.setattr(Q, "view", lambda s, d, n: reads.append(n) or view(s, d, n))
    df = {"windows": lambda: Q.pixel_windows(spark, sf_dir, [s[0] for s in Q.STAGES["OI"]]), "medians": lambda: Q.relative(spark, sf_dir),
          "names": lambda: Q.all_features(spark, sf_dir), "wide": lambda: C.features_wide(Q.all_features(spark, sf_dir), ["S2_FEN_NDVImax"])}[name]()
    assert reads == ["obs_dn"]
    assert shuffles(df) <= most
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "observations_" in plan and "events" not in plan


def test_both_ways_to_the_variables_agree(spark, sf_dir):
    obs = Q.stored(spark, sf_dir, True)
    met = C.curve_metrics(obs, Q.STEP)
    stages = [s[0] for s in Q.STAGES["OI"]]
    apart = C.features_long(met, C.relative_medians(obs, met, Q.VARS, Q.WINDOWS, Q.LANDSAT_EXTRA), C.fixed_medians(obs, Q.VARS, stages), Q.VARS)
    once = C.features_of_pixels(C.pixel_windows(obs, met, Q.VARS, Q.WINDOWS, Q.LANDSAT_EXTRA, stages), Q.VARS)
    columns = ["sensor", "px_id", "window", "variable", "name", "value"]
    assert sorted(map(str, apart.select(columns).collect())) == sorted(map(str, once.select(columns).collect()))
