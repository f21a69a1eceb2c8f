import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from mvtrack.plans import rebuild  # noqa: F401  it registers its queries
from mvtrack.plans import queries as Q


def test_points_just_under_water_equal_sql(spark, tmp_path):
    """All points lie within a millimetre of the surface, where the SQL takes them to be a millimetre deep."""
    for t in ("nation", "events", "lineitem"):
        os.symlink(f"/root/testdata/sf0.01/{t}.parquet", tmp_path / f"{t}.parquet")
    rng = np.random.default_rng(2)
    cells = np.zeros((4000, 6), np.float32)
    cells[:, :2], cells[:, 2] = rng.uniform(-0.5, 0.5, (4000, 2)), rng.uniform(0.0495, 0.0515, 4000)
    pq.write_table(pa.table({"vec_id": np.arange(4000), "embedding": pa.array(cells.tolist(), pa.list_(pa.float32())), "label": pa.array([0] * 4000, pa.int32())}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    for t in ("nation", "events", "lineitem", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path / t}.parquet'")
    want = con.sql(Q.ORACLE_SQL["j11_gap_reasons"])
    got = Q.QUERIES["j11_gap_reasons"](spark, str(tmp_path)).select(*want.columns)
    ours, theirs = sorted(map(tuple, got.collect())), sorted(want.fetchall())
    assert len(ours) == len(theirs) and not set(ours) ^ set(theirs)
