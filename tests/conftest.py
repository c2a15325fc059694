import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from moundlake.runtime import session

    s = session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def grid_frame(spark, arrays, res=1.0):
    """Cells and grids of small NumPy rasters; NaN becomes NULL. Survey ids count from 1."""
    import numpy as np

    rows, grids = [], []
    for sid, a in enumerate(arrays, 1):
        a = np.asarray(a, dtype=float)
        h, w = a.shape
        grids.append((sid, 1000.0, 2000.0 + h * res, res, w, h, "EPSG:32632"))
        rows += [(sid, r, c, None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(h) for c in range(w)]
    cells = spark.createDataFrame(rows, "survey_id long, r int, c int, v double")
    g = spark.createDataFrame(grids, "survey_id long, west double, north double, res double, width int, height int, crs string")
    return cells, g


def to_arrays(df, value, shapes, fill=float("nan")):
    import numpy as np

    out = [np.full(s, fill) for s in shapes]
    for row in df.collect():
        if row[value] is not None:
            out[row["survey_id"] - 1][row["r"], row["c"]] = row[value]
    return out
