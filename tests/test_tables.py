import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mvtrack.operators import reconstruction, tables
from mvtrack.sources import runs

WATER, TANK = 0.75, {"diameter": 1.0, "height": 0.5, "water_z": 0.75, "resolution": 0.05}


@pytest.fixture
def cameras(spark, tmp_path):
    """A rig as a calibration file has it."""
    rig = {
        f"c{k}": {"K": [[1400 + k, 0, 800], [0, 1390, 600], [0, 0, 1]], "R": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "t": [-0.2 * (k % 2), -0.3 * (k // 2), 0], "width": 1600, "height": 1200}
        for k in range(4)
    }
    (tmp_path / "rig.json").write_text(json.dumps({"cameras": rig, "water_z": WATER}))
    return runs.read_calibration(spark, f"{tmp_path}/rig.json").withColumnsRenamed({"x": "px", "y": "py", "z": "pz"})


def test_grid_has_its_borders_and_no_more(spark, cameras):
    got = tables.voxel_grid(spark, cameras, **TANK).toPandas()
    assert abs(got.x.mean() - 0.1) < 1e-9 and abs(got.y.mean() - 0.15) < 1e-9
    assert got.ix.max() == 22 and got.iz.max() == 11 and abs(got.z.max() - (WATER + 0.55)) < 1e-9
    assert (np.hypot(got.x - 0.1, got.y - 0.15) <= 0.55 + 1e-6).all() and len(got[got.iz == 0]) == sum((i - 11) ** 2 + (j - 11) ** 2 <= 121 for i in range(23) for j in range(23))


def test_table_is_what_the_cameras_see(spark, cameras):
    grid = tables.voxel_grid(spark, cameras, **TANK).cache()
    table = tables.inverse_table(grid, cameras, WATER).cache()
    rig = {r.camera_id: np.array([r.fx, r.fy, r.cx, r.cy, r.px, r.py, r.pz]) for r in cameras.collect()}
    voxels = {(r.ix, r.iy, r.iz): (r.x, r.y, r.z) for r in grid.collect()}
    got = {(r.ix, r.iy, r.iz, r.camera_id): (r.u, r.v) for r in table.collect()}
    for c, camera in rig.items():
        keys = list(voxels)
        pixels = reconstruction.project(np.array([voxels[k] for k in keys]), camera, WATER)
        inside = (pixels >= 0).all(1) & (pixels < [1600, 1200]).all(1)
        assert {k for k, i in zip(keys, inside) if i} == {k[:3] for k in got if k[3] == c}
        assert all(np.abs(np.array(got[(*k, c)]) - p).max() < 1e-3 for k, p, i in zip(keys, pixels, inside) if i)
    errors = tables.inverse_errors(table, grid, cameras, WATER).collect()
    assert len(errors) == 4 and all(r.n == 50 and r.max_error < 1.0 for r in errors)
    with pytest.raises(Exception, match="off by pixels"):
        tables.inverse_errors(table.withColumn("u", F.col("u") + 2), grid, cameras, WATER).collect()


def test_lookup_leaves_the_table_where_it_is(spark, cameras, tmp_path):
    grid = tables.voxel_grid(spark, cameras, **TANK)
    name = f"inverse_{tmp_path.name.replace('-', '_')}"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables.save_inverse(tables.inverse_table(grid, cameras, WATER), name, buckets=4)
        points = spark.createDataFrame([(1, 0.1, 0.15, WATER + 0.5), (2, 0.124, 0.15, WATER + 0.52), (3, 9.0, 0.0, 1.0), (4, 0.1, 0.15, 0.2)], "k long, x double, y double, z double")
        found = tables.seen_at(points, spark.table(name), (0.1, 0.15), 1.0, WATER, 0.05)
        got = {(r.k, r.camera_id): (r.u, r.v) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    assert plan.count("Exchange hashpartitioning") == 1 * (2 if "== Initial Plan ==" in plan else 1)
    assert {k for k, _ in got} == {1, 2} and all(got[1, c] == got[2, c] for _, c in got)


def test_forward_tables_go_back(spark, cameras):
    """Rays of grid pixels, followed down, are seen at those pixels."""
    got = tables.forward_tables(cameras, 200, WATER).join(cameras, "camera_id").toPandas()
    assert len(got) == 4 * 9 * 7
    depth = 0.6
    points = np.column_stack([got.ox + got.dx / got.dz * depth, got.oy + got.dy / got.dz * depth, np.full(len(got), WATER + depth)])
    back = reconstruction.project(points, got[["fx", "fy", "cx", "cy", "px", "py", "pz"]].to_numpy(float), WATER)
    assert np.abs(back - got[["gx", "gy"]].to_numpy() * 200).max() < 1e-4


def test_too_many_cameras_are_an_error(cameras, monkeypatch, spark):
    monkeypatch.setattr(tables, "MOST_CAMERAS", 3)
    with pytest.raises(ValueError, match="4 cameras"):
        tables.inverse_table(tables.voxel_grid(spark, cameras, **TANK), cameras, WATER)
