"""Explanations are never broadcast, and repeated ones shrink before they meet their concepts."""

import re

from corpuskit.operators import archive


def test_aliases_of_many_explanations(spark):
    concepts = spark.createDataFrame([("old", "red", "kept"), ("old0", "red", "kept too")], "id string, normalized_name string, definition_en string")
    aliases = spark.createDataFrame([("x", "Reserved", "reserved")], "concept_id string, alias_display string, alias_normalized string")
    rows = [("R", "Red", ["Shared", "reserved"], "d", 7), ("B", "Blue", ["shared"], "d", 7), ("B", "Blue", ["late"], "d", 9)] + [("Hot", "Red", ["hot 2"], "d", 100 + i) for i in range(500)]
    explanations = spark.createDataFrame([(*r[:4], None, r[4]) for r in rows], "requested_term string, canonical_name string, aliases array<string>, definition_en string, difficulty string, pos int")
    _, stored = archive.ingest_explanations(concepts, aliases, explanations, ["pos"])
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[normalized_name", plan) and not re.search(r"BroadcastHashJoin \[normalized_name#\d+\], \[normalized_name#\d+\], Inner", plan)
    got = {r["alias_normalized"]: r["concept_id"] for r in stored.collect()}
    blue = archive.ingest_explanations(concepts, aliases, explanations, ["pos"])[0].where("normalized_name = 'blue'").first()["id"]
    assert got == {"reserved": "x", "r": "old", "b": blue, "hot": "old", "hot 2": "old", "late": blue, "shared": min("old", blue)}
