"""Registered queries against their SQL statements on the smallest tables.

A cross-section by default; ``ETHOSPARK_ALL_QUERIES=1`` runs every query.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages labels".split()
SAMPLE = [
    "bouts_summary", "bouts_delete_touching", "window_statistics", "window_spectral_features",
    "labels_counts", "labels_class_shares", "annotations_in_range", "pose_hull", "features_angles",
    "features_closest_distances", "features_corner_walls", "features_lixit_choice",
    "features_shape_descriptors", "splits_binary", "scores_averaged", "project_feature_coverage",
    "search_predictions_range", "missing_keypoints_frames", "remap_best_identity", "metric_pose_ap",
    "source_eartag_poses", "source_clip_samples",
]
NAMES = sorted(entry.queries()) if os.environ.get("ETHOSPARK_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return sorted((tuple(clean(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
