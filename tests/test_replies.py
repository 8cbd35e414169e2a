"""Stored replies, sources that fail, sketches."""

import json

import pytest

from ligandloom.operators import assemble, curation
from ligandloom.sources import replies as R


def ids(aid, cids):
    return json.dumps({"InformationList": {"Information": [{"AID": aid, "CID": cids}]}})


def test_ids_and_reasons(spark):
    rows = [
        (1, "active", ids(7, [1, 2, 2, None])), (2, "inactive", ids(7, [2, 3])), (3, "inactive", ids(8, [])),
        (4, "active", None), (5, "active", " "), (6, "active", '{"InformationList": {"Inform'), (7, "active", '{"Fault": {}}'),
        (8, "active", "[1, 2]"), (9, "unknown", ids(9, [5])), (10, "active", '{"InformationList": {"Information": [{"AID": 1}]}}'),
    ]
    df = spark.createDataFrame(rows, "request int, outcome string, body string")
    got = R.outcome_rows(df, "body")
    assert sorted(map(tuple, got.collect())) == [
        (7, 1, "active"), (7, 2, "active"), (7, 2, "inactive"), (7, 3, "inactive"), (9, 5, "unknown"),
    ]
    assert sorted(map(tuple, R.outcome_labels(got).collect())) == [(1, 1), (2, 1), (3, 0)]
    bad = {r.request: r.reason for r in R.rejected(df, "body", "ids").collect()}
    assert {k: bad[k] for k in (4, 5, 6, 7)} == {4: "empty", 5: "empty", 6: "broken", 7: "no answer"}
    assert set(bad) == {4, 5, 6, 7, 8}
    assert R.outcome_rows(df.limit(0), "body").count() == 0


def test_properties_under_several_names(spark):
    body = json.dumps({"PropertyTable": {"Properties": [
        {"CID": 1, "SMILES": "C", "CanonicalSMILES": "X", "MolecularWeight": "16.04", "XLogP": 1.1},
        {"CID": 2, "SMILES": " ", "ConnectivitySMILES": "CC", "MolecularWeight": 30},
        {"CID": 3, "IsomericSMILES": "O", "XLogP": "n/a", "InChI": "?"}, {"SMILES": "lost"},
    ]}})
    df = spark.createDataFrame([(body,), (None,), ("{",)], "body string")
    got = R.property_rows(df, "body", numbers=("MolecularWeight", "XLogP"))
    assert sorted(map(tuple, got.collect())) == [(1, "C", 16.04, 1.1), (2, "CC", 30.0, None), (3, "O", None, None)]
    assert [tuple(r) for r in R.unknown_names(df, "body").collect()] == [("InChI", 1)]
    assert R.rejected(df, "body", "properties").count() == 2


def test_sources_are_tried_in_order(spark):
    good = spark.createDataFrame([("a", 1), ("b", 0)], "key string, label int")

    def broken():
        raise OSError("gone")

    tables, report = assemble.load_available(spark, {"x": broken, "y": lambda: good, "z": lambda: good.drop("label")}, ["key", "label"])
    assert len(tables) == 1 and tables[0].count() == 2
    assert [tuple(r) for r in report.orderBy("place").collect()] == [
        (1, "x", False, None, "OSError"), (2, "y", True, 2, None), (3, "z", False, None, "ValueError"),
    ]
    with pytest.raises(ValueError, match=r"x \(OSError\)"):
        assemble.load_available(spark, {"x": broken}, ["key"])


def test_sketches_merge(spark):
    rows = spark.range(3000).selectExpr("cast(id % 1000 as string) AS key", "id % 3 AS part")
    sketches = curation.key_sketches(rows, "key", ["part"])
    assert curation.merged_key_counts(sketches).first()["n_rows"] == 3000
    assert abs(curation.merged_key_counts(sketches).first()["n_keys"] - 1000) < 30
