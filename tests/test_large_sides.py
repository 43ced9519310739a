"""Sides of joins that are made from tables stay out of the driver, texts are read once, and groups don't meet all others."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import extract as X, macros as M, outlines as O
from factloom.plans import q_macros, registry

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


#: Queries, each with the broadcasts that it asks for: a list of fixed length.
BROADCASTS = {"flow_narrowing": 0, "chain_typing": 0, "hash_key_owners": 0, "type_at": 0, "type_definition": 0, "stamped_calls": 0, "binding_edges": 0, "check_source": 0, "symbol_defines_target": 0, "ref_matches_target": 0, "verb_manifest": 2, "return_expressions": 0, "selection_ranges": 0}


@pytest.mark.parametrize("name", sorted(BROADCASTS))
def test_no_side_goes_through_the_driver(spark, name):
    assert plan_of(registry.queries()[name](spark, SF)).count("BroadcastHashJoin") == BROADCASTS[name]


def test_programs_are_read_once(spark):
    assert "MapInArrow" not in plan_of(registry.queries()["hash_key_owners"](spark, SF))


def test_blocks_need_no_frame_for_each_file(spark):
    rows = X.statements(spark.createDataFrame([(1, "sub a {\n}\n")], "file_id long, text string"))
    assert "FlatMapGroupsInPandas" not in plan_of(O.blocks(rows))


def test_a_name_meets_the_headers_of_its_file_only(spark):
    texts = [(k, f"u{k}.c", '#include "h.h"\n#define OWN 1\nv = OWN + H;') for k in range(300)]
    files = spark.createDataFrame([*texts, (900, "h.h", "#define H 2\n")], "file_id long, path string, text string")
    made = M.applied(files, M.splices(files)).where("file_id < 900").select("text").distinct().collect()
    assert [r.text.rsplit("\n", 1)[-1] for r in made] == ["v = 1 + 2;"]


def test_units_are_spread_before_they_are_texts(spark):
    assert q_macros.units(spark, SF).where(F.col("file_id") >= 0).rdd.getNumPartitions() > 1
