import pytest
from pyspark.sql import functions as F

from ligandloom.functions import fingerprints as FP
from ligandloom.functions import values as V


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


@pytest.mark.parametrize(
    "text, want",
    [
        (">10000", (">", 10000.0)), ("  <= 0.5 nM", ("<=", 0.5)), ("100", ("=", 100.0)), (None, ("", None)),
        ("n.d.", ("", None)), ("1.2.3", ("=", None)), ("10-20", ("=", None)), ("1e", ("=", None)),
        ("~5e2", ("~", 500.0)), ("1e400", ("=", float("inf"))), ("", ("", None)), ("> ", ("", None)),
    ],
)
def test_parse_qualified(spark, text, want):
    relation, number = V.parse_qualified(F.col("t"))
    assert one(spark, [(text,)], "t string", relation, number) == [want]


@pytest.mark.parametrize(
    "text, want",
    [("1d", None), ("1f", None), (" 2 ", 2.0), ("-1.5e3", -1500.0), (".5", 0.5), ("5.", 5.0), ("abc", None),
     (None, None), ("inf", float("inf")), ("NaN", None), ("0x10", None)],
)
def test_to_number(spark, text, want):
    assert one(spark, [(text,)], "t string", V.to_number(F.col("t"))) == [(want,)]


def test_units(spark):
    rows = [(2.0, "nM"), (2.0, "uM"), (2.0, " M "), (2.0, "um"), (2.0, None)]
    got = one(spark, rows, "v double, u string", V.to_nanomolar(F.col("v"), F.col("u")))
    assert got == [(2.0,), (2000.0,), (2e9,), (None,), (None,)]


@pytest.mark.parametrize(
    "v, rel, label, cls",
    [
        (10000.0, "=", 1, "active"), (10000.1, "=", 0, "gray"), (20000.0, "=", 0, "inactive"), (5.0, ">", 0, "amb"),
        (15000.0, ">=", 0, "gray"), (20000.0, ">", 0, "inactive"), (10000.0, "<", 1, "active"),
        (15000.0, "<=", 0, "gray"), (5.0, None, 1, "active"), (5.0, " > ", 0, "amb"), (5.0, "~", 1, "active"),
    ],
)
def test_labels(spark, v, rel, label, cls):
    cols = V.label_binary(F.col("v"), F.col("r")), V.activity_class(F.col("v"), F.col("r"))
    assert one(spark, [(v, rel)], "v double, r string", *cols) == [(label, cls)]


def test_missing_value_has_no_label(spark):
    assert one(spark, [(None, "=")], "v double, r string", V.label_binary(F.col("v"), F.col("r"))) == [(None,)]


def test_zero_is_not_potent(spark):
    got = one(spark, [(0.0,), (1000.0,)], "v double", V.pic50(F.col("v")), V.pic50_floored(F.col("v")))
    assert got[0] == (None, 15.0)
    assert got[1][0] == pytest.approx(6.0) and got[1][1] == pytest.approx(6.0)


def test_half_even(spark):
    assert one(spark, [(0.125,), (2.5e-3,), (0.375,)], "v double", V.half_even(F.col("v"), 2)) == [(0.12,), (0.0,), (0.38,)]


def test_finite(spark):
    rows = [(float("inf"),), (float("nan"),), (-float("inf"),), (1.0,), (None,)]
    assert one(spark, rows, "v double", V.finite(F.col("v"))) == [(None,), (None,), (None,), (1.0,), (None,)]


def test_keys(spark):
    rows = [("  C C \n O ",), ("   ",), (None,)]
    assert one(spark, rows, "t string", V.canonical_key(F.col("t"))) == [("C C O",), (None,), (None,)]
    assert one(spark, [("CCO.[Na]",), ("AB.CD",), ("x",)], "t string", V.largest_fragment(F.col("t"))) == [
        ("[Na]",), ("AB",), ("x",)
    ]


def test_heavy_atoms(spark):
    rows = [("CCO",), ("[H][H]",), ("[nH]1cccc1",), ("ClC(Br)[13CH3]",), ("[2H]OC",)]
    assert one(spark, rows, "t string", V.heavy_atoms(F.col("t"))) == [(3,), (0,), (5,), (4,), (2,)]


def brute_bits(grams, n):
    import hashlib

    return sorted({int(hashlib.md5(g.encode()).hexdigest()[:7], 16) % n for g in grams})


def test_fingerprints_against_python(spark):
    text = "CC(=O)Oc1ccccc1C(=O)[O-]"
    import re

    t = re.findall(FP.SMILES_TOKEN, text)
    n = len(t)
    circular = [f"{r}|" + " ".join(t[max(i - r, 0) : i + r + 1]) for r in range(3) for i in range(n)]
    path = ["p|" + " ".join(t[i : i + k]) for k in range(1, 8) for i in range(n - k + 1)]
    pair = [f"a|{t[i]}|{t[i + d]}|{d}" for d in range(1, 31) for i in range(n - d)]
    df = spark.createDataFrame([(text,), ("",)], "t string").withColumn("k", FP.tokens(F.col("t")))
    for kind, grams in (("circular", circular), ("path", path), ("pair", pair)):
        rows = df.select(FP.fingerprint(F.col("t"), F.col("k"), kind)).collect()
        assert list(rows[0][0]) == brute_bits(grams, FP.N_BITS), kind
        assert list(rows[1][0]) == []
    keys = df.select(FP.fingerprint(F.col("t"), F.col("k"), "keys")).first()[0]
    assert keys == [i for i, p in enumerate(FP.KEY_PATTERNS) if re.search(p, text)]


def test_vector_stage_keeps_bits(spark):
    df = spark.createDataFrame([([1, 5, 7],), ([],)], "b array<int>")
    stage = FP.vector_stage(spark, 8, "n", "v")
    rows = stage.transform(df.withColumn("n", FP.bit_names(F.col("b")))).collect()
    assert list(rows[0]["v"].toArray()) == [0, 1, 0, 0, 0, 1, 0, 1]
    assert rows[1]["v"].numNonzeros() == 0


def test_unknown_kind(spark):
    with pytest.raises(ValueError, match="unknown fingerprint"):
        FP.fingerprint(F.col("a"), F.col("b"), "other")
