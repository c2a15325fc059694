"""Chains of matches, nearest references, plateaus."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from moundlake.operators import neighbourhood as nb
from moundlake.operators.report import nearest_reference, replace_bases
from moundlake.plans.match import heap_chains, volume_timeline
from moundlake.sinks.versions import VersionedTables
from tests.conftest import grid_frame


def test_a_heap_lost_and_found_again_gives_two_chains(spark):
    pairs = spark.createDataFrame([(k, k, k + 1) for k in range(1, 4)], "pair_id long, survey_a long, survey_b long")
    heaps = spark.createDataFrame(
        [(s, 1, 10.0 + s) for s in (1, 2, 3, 4)] + [(s, 2, 5.0) for s in (1, 2, 4)] + [(3, 7, 1.0)], "survey_id long, heap_id long, volume_m3 double"
    )
    changes = spark.createDataFrame(
        [(1, 1, 1), (2, 1, 1), (3, 1, 1), (1, 2, 2), (2, 2, None), (3, None, 2), (2, None, 7), (3, 7, None)], "pair_id long, heap_a long, heap_b long"
    )
    got = {(r["survey_id"], r["heap_id"]): r for r in volume_timeline(changes, heaps, pairs).collect()}
    assert len(got) == 8 and all((got[s, 1]["chain_survey"], got[s, 1]["step"]) == (1, s - 1) for s in (1, 2, 3, 4))
    assert [got[s, 1]["since_first_m3"] for s in (1, 2, 3, 4)] == [0.0, 1.0, 2.0, 3.0] and got[1, 1]["delta_m3"] is None and got[3, 1]["delta_m3"] == 1.0
    assert (got[1, 2]["chain_survey"], got[2, 2]["chain_survey"], got[4, 2]["chain_survey"]) == (1, 1, 4)
    assert got[4, 2]["previous_m3"] is None and got[3, 7]["step"] == 0


def test_long_chains(spark):
    n = 100
    links = spark.createDataFrame([(s, 3, s + 1, 3) for s in range(n)] + [(s, 4, s + 1, 4) for s in range(0, n, 2)], "survey_a long, heap_a long, survey_b long, heap_b long")
    heaps = spark.createDataFrame([(s, h) for s in range(n + 1) for h in (3, 4)], "survey_id long, heap_id long")
    got = {(r["survey_id"], r["heap_id"]): (r["chain_survey"], r["step"]) for r in heap_chains(links, heaps).collect()}
    assert all(got[s, 3] == (0, s) for s in range(n + 1)) and all(got[s, 4] == (s - s % 2, s % 2) for s in range(n + 1))


@pytest.mark.parametrize("kind", ["even", "clustered", "one place"])
def test_nearest_reference_equals_brute_force(spark, kind):
    rng = np.random.default_rng(6)
    n = 600
    heaps = rng.uniform(0, 1000, (n, 2))
    refs = {"even": rng.uniform(0, 1000, (n, 2)), "clustered": np.vstack([rng.normal(50, 1, (n, 2)), [[5000.0, -300.0]]]), "one place": np.full((5, 2), 7.0)}[kind]
    h = [(s, i, float(x), float(y)) for s in (1, 2) for i, (x, y) in enumerate(heaps)] + [(3, 1, 0.0, 0.0)]
    r = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(refs)] + [(2, 9, 1e6, 1e6)]
    got = nearest_reference(
        spark.createDataFrame(h, "survey_id long, heap_id long, centroid_e double, centroid_n double"),
        spark.createDataFrame(r, "survey_id long, ref_id long, ref_e double, ref_n double"),
    ).collect()
    rows = {(g["survey_id"], g["heap_id"]): g for g in got}
    assert len(got) == len(rows) == 2 * n and all(rows[2, i]["ref_id"] == 9 for i in range(n))
    d = np.hypot(heaps[:, None, 0] - refs[None, :, 0], heaps[:, None, 1] - refs[None, :, 1])
    for i in range(n):
        assert rows[1, i]["distance_m"] == pytest.approx(d[i].min(), abs=1e-6) and d[i, rows[1, i]["ref_id"]] == pytest.approx(d[i].min())
        if kind == "one place":
            assert rows[1, i]["ref_id"] == 0


def test_many_references_of_one_survey(spark):
    """100,000 by 100,000 in one survey: 10^10 pairs by brute force."""
    place = lambda seed: [(F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(10**9)) / 1e6).alias(n) for k, n in enumerate("xy")]
    heaps = spark.range(100_000).select(F.lit(1).cast("long").alias("survey_id"), F.col("id").alias("heap_id"), *place(1)).withColumnsRenamed({"x": "centroid_e", "y": "centroid_n"})
    refs = spark.range(100_000).select(F.lit(1).cast("long").alias("survey_id"), F.col("id").alias("ref_id"), *place(7)).withColumnsRenamed({"x": "ref_e", "y": "ref_n"})
    got = nearest_reference(heaps, refs).agg(F.count(F.lit(1)), F.avg("distance_m"), F.max("distance_m")).first()
    # a tenth of a reference a square metre: half its root away on average
    assert got[0] == 100_000 and 1.5 < got[1] < 1.7 and got[2] < 10


def test_one_top_a_plateau(spark):
    a = np.zeros((20, 20))
    a[3:6, 3:9] = 2.0          # a block
    a[6, 9] = 2.0              # joined to it at a corner
    a[12, 4:8] = 1.0           # a bar
    a[12, 15] = 1.0            # a place of its own
    cells, _ = grid_frame(spark, [a, a])
    tops = nb.plateau_tops(nb.local_maxima(cells, "v", 1).where("is_peak").select("survey_id", "r", "c", "v"), "v").collect()
    assert sorted((t["survey_id"], t["r"], t["c"]) for t in tops) == [(s, *p) for s in (1, 2) for p in ((3, 3), (12, 4), (12, 15))]


def test_bases_and_volumes_change_in_one_commit(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path))
    heaps = spark.createDataFrame([(1, 0, 1, 10.0, 4.0), (1, 0, 2, 0.5, 4.0), (2, 0, 1, 3.0, 1.0)], "survey_id long, part int, heap_id long, volume_m3 double, planimetric_area_m2 double")
    tables.commit({"heaps": heaps, "surveys": heaps.select("survey_id", "part").distinct().withColumn("base", F.lit(100.0))})
    replace_bases(tables, spark.createDataFrame([(1, 100.5)], "survey_id long, base double"))
    got = sorted(tuple(r) for r in tables.read("heaps").select("survey_id", "heap_id", "volume_m3").collect())
    assert got == [(1, 1, 8.0), (1, 2, 0.0), (2, 1, 3.0)]
    assert sorted(tuple(r) for r in tables.read("surveys").select("survey_id", "base").collect()) == [(1, 100.5), (2, 100.0)]
