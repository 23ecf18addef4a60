"""Every core query against its SQL; those without SQL against what their rows must keep to."""

import pytest

from motespark.plans import registry

ROWS_ONLY = [n for n in registry.QUERIES if n not in registry.ORACLES]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(same_as_sql, name):
    same_as_sql(registry.QUERIES[name], registry.ORACLES[name])


def tracks_are_whole(rows, spark, data):
    """Every detection once, in a track that has no two in one frame."""
    every = spark.read.parquet(f"{data}/features.parquet").where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    assert rows.feature_id.is_unique and len(rows) == every.select("feature_id").distinct().count()
    assert rows.particle.notna().all() and 1 < rows.particle.nunique() < len(rows)
    if "frame" in rows:
        assert not rows.duplicated(["video_id", "particle", "frame"]).any()


def features_are_found(rows, spark, data):
    assert len(rows) and (rows.mass > 0).all()


def readings_are_scored(rows, spark, data):
    usable = spark.read.parquet(f"{data}/traj.parquet").where("particle is not null and x is not null and y is not null and not isnan(x) and not isnan(y)")
    assert len(rows) == usable.select("video_id", "particle", "frame").distinct().count()
    assert rows.score.between(0, 1, inclusive="neither").all() and (rows.score >= 0.7)[rows.spike | rows.stuck].all()
    assert (rows.score >= 0.7).mean() < 0.1  # a forest that proposes most readings would decide nothing


def flags_are_few(rows, spark, data):
    scored = registry.QUERIES["p6_scores"](spark, data).where("spike or stuck or outside").toPandas()
    assert 0 < len(rows) == len(scored) and not rows.duplicated().any()


CHECKS = {"link": tracks_are_whole, "locate_batch": features_are_found, "p6_scores": readings_are_scored, "p6_found": flags_are_few}


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_without_sql(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    CHECKS.get(name, CHECKS["link"])(df.toPandas(), spark, data)


def test_sql_has_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert registry.FLAGSHIP in registry.QUERIES
