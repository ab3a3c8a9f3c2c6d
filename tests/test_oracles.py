"""Registered queries against their SQL at the smallest scale, some of each plan."""

import duckdb
import pandas as pd
import pytest

from rasterjobs import plans

NAMES = [
    "class_map", "pixel_metrics", "object_metrics", "skip_report", "model_comparison", "components_4", "tight_crop",
    "component_properties", "merge_instances", "continuity", "resize_half_even", "percentiles", "z_score_roi",
    "probability_histogram", "dilate_cross", "close_disk", "gaussian_1", "patch_grid_clamped", "points_in_patches",
    "combine_weighted", "farthest_points", "store_level_preferred", "subject_catalogue",
    "evaluation_table", "centerline_dice", "skeleton", "evaluation_in_box", "instances", "open_disk", "instance_clean_up",
]


def plain(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object)
    clean = lambda v: None if pd.isna(v) else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) else v
    return sorted(str(tuple(clean(v) for v in row)) for row in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in ("part", "supplier"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, small, duck, name):
    got, want = plans.queries()[name](spark, small).toPandas(), duck.sql(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
