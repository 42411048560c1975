"""Readings that meet every profile; tied patterns of many equal shifts."""

import os
import time

import pytest

from robustspark.operators import sites, worlds
from robustspark.plans import registry
from robustspark.plans import worlds as plans

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_every_profile_occurs(spark):
    got = {r["profile"]: r["needed"] for r in registry.queries()["c9_lever_profiles"](spark, FOLDER).collect()}
    assert got == {"reduce_s": "S", "both": None, "raise_ca": "CA", "no_lever": None, "partial": None, "unknown": None}


def test_tied_patterns_of_many_units(spark):
    """A pattern's work grows with the cells, not with their square in each world."""
    cells = spark.createDataFrame([(u, f"d{d}", 1 + (u * 7 + d) % 4) for u in range(60) for d in range(4)], "unit_id long, dimension_id string, class_no int")
    worlds = spark.range(40_000).selectExpr("id as world_id", "filter(sequence(0L, 59L), u -> u % 5 = id % 5) as shifted")
    began = time.time()
    got = sites.tied_patterns(worlds, cells).groupBy("dimension_id").sum("n_worlds").collect()
    assert {r[1] for r in got} == {40_000} and len(got) == 4
    assert time.time() - began < 30


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_terms_in_tasks_equal_the_columns(spark):
    """Also where classes, shares and fits are unknown."""
    t = plans.Many(spark, FOLDER)
    rows = [(k, f"d{k % 3}" * (k % 4), None if k % 4 == 1 else k % 6, None if k % 3 else k / 7, None if k % 5 == 2 else k % 5, None if k % 2 else k % 4 == 0) for k in range(12)]
    catalogue = spark.createDataFrame(rows, "measure_no int, dimension_id string, class_no int, rec_share double, cob_class int, mismatch boolean")
    want = {r["world_id"]: (r["vuln"], r["flat"]) for r in worlds.world_terms(t.worlds, catalogue).collect()}
    frame, own = worlds.Terms(t.worlds, catalogue).split()
    part = frame.toArrow().combine_chunks().to_batches()[0]
    vuln, flat = own.arrays(part)
    assert {w: (v, f) for w, v, f in zip(part.column("world_id").to_pylist(), vuln.tolist(), flat.tolist(), strict=True)} == want
