import os

import pytest
from pyspark.sql import functions as F

from ligandloom.sources import readers, writers
from ligandloom.sources.targets import targets


def put(folder, name, text):
    path = os.path.join(str(folder), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_read_delimited_edges(spark, tmp_path):
    path = put(
        tmp_path, "a.csv",
        'id,name,v\n1,"say ""hi"", you",x\n2,NA,y\n3,short\n4,a,b,c\n5,a,b,\n6,"a,b",\n7,,nan\n8,"#N/A",z\n',
    )
    got = rows(readers.read_delimited(spark, path, ","))
    assert got == [
        ("1", 'say "hi", you', "x"), ("2", None, "y"), ("3", "short", None), ("6", "a,b", None), ("7", None, None),
        ("8", None, "z"),
    ]
    assert rows(readers.read_delimited(spark, path, ",", ["v", "id"]))[2] == (None, "3")
    with pytest.raises(ValueError, match="not in header"):
        readers.read_delimited(spark, path, ",", ["other"])


def test_column_with_dots_and_blanks(spark, tmp_path):
    path = put(tmp_path, "b.tsv", "Ligand SMILES\tIC50 (nM)\tp.x\nCC\t>5\t1\n")
    assert rows(readers.read_delimited(spark, path, "\t", ["IC50 (nM)", "p.x"])) == [(">5", "1")]


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_sniff(spark, tmp_path, sep):
    path = put(tmp_path, "s.txt", sep.join("abc") + "\n" + sep.join("123") + "\n" + sep.join(["x y", "z", ""]) + "\n")
    assert readers.sniff_delimiter(spark, path) == sep


def test_detect_columns():
    assert readers.detect_columns(["CID", "Name", "SMILES"]) == ("SMILES", "Name")
    assert readers.detect_columns(["x", "my_smiles_col"]) == ("my_smiles_col", "x")
    assert readers.detect_columns(["structure", "smiles", "np_id"]) == ("smiles", "np_id")
    assert readers.detect_columns(["smiles"]) == ("smiles", "smiles")
    with pytest.raises(ValueError, match="no structure column"):
        readers.detect_columns(["a", "b"])
    assert readers.find_column(["A pChEMBL Value", "Standard Value"], "standard value") == "Standard Value"
    assert readers.find_column(["A"], "b", "a") == "A"
    assert readers.find_column(["A"], "b") is None


def test_library_last_name_wins_across_blocks(spark, tmp_path):
    """Row order holds although tasks take the blocks of the file in any order."""
    lines = "".join(f"n{i % 50},S{i}\n" for i in range(20000))
    path = put(tmp_path, "lib.csv", "name,smiles\n" + lines + "gone,\n,S\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {r["name"]: r["smiles"] for r in readers.load_library(spark, path, "T").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {f"T:n{i}": f"S{19950 + i}" for i in range(50)}


def test_build_library_without_files(spark, tmp_path):
    paths = {"A": str(tmp_path / "none.csv"), "B": None}
    with pytest.raises(FileNotFoundError, match="none.csv"):
        readers.build_library(spark, paths)
    own = spark.createDataFrame([("n", "C", "own")], "name string, smiles string, source string")
    assert readers.build_library(spark, paths, own).collect() == own.collect()


def test_files_with_other_headers_are_refused(spark, tmp_path):
    put(tmp_path, "d/a.csv", "x,y\n1,2\n")
    put(tmp_path, "d/b.csv", "x;y\n1;2\n")
    with pytest.raises(ValueError, match="separator"):
        readers.sniff_delimiter(spark, str(tmp_path / "d"))


def test_token_files(spark, tmp_path):
    put(tmp_path, "d/x/one.picked", "ligand q1\nCC\tid\n\n  CO 5\nSMILES\n")
    put(tmp_path, "d/two.picked", "ligand q2\nCN\n")
    got = sorted(r["token"] for r in readers.read_token_files(spark, str(tmp_path / "d")).collect())
    assert got == ["CC", "CN", "CO"]


ATOMS = [
    "ATOM      1  N   MET A   1      11.104   6.134  -6.504  1.00  0.00           N  ",
    "HETATM    2  C1  NAD A 301      11.104   6.134  -6.504  1.00  0.00           C  ",
    "HETATM    3  O   HOH A 401      11.104   6.134  -6.504  1.00  0.00           O  ",
    "HETATM    4  H1  YXW A 501      11.104   6.134  -6.504  1.00  0.00           H  ",
    "HETATM    5  C1  YXW A 501      11.104   6.134  -6.504  1.00  0.00           C  ",
    "HETATM    6  SE  MSE B  12      11.104   6.134  -6.504  1.00  0.00          SE  ",
    "HETATM    7 HO",
    "REMARK nothing",
]


def test_fixed_width(spark, tmp_path):
    path = put(tmp_path, "p.pdb", "\n".join(ATOMS) + "\n")
    df = readers.read_fixed_width(spark, path)
    got = [(r["residue"], r["chain"], r["number"], r["class"]) for r in df.orderBy("line_no").collect()]
    assert got[:6] == [
        ("MET", "A", "1", "protein"), ("NAD", "A", "301", "cofactor"), ("HOH", "A", "401", "drop"),
        ("YXW", "A", "501", "other"), ("YXW", "A", "501", "other"), ("MSE", "B", "12", "protein"),
    ]
    heavy = {r["residue"]: r["n_heavy"] for r in readers.heavy_lines(df, "residue").collect()}
    assert heavy["YXW"] == 1 and heavy["MSE"] == 1


def test_write_batches_one_file_each(spark, tmp_path):
    out = str(tmp_path / "b")
    writers.write_batches(spark.range(100).select(F.col("id").cast("string").alias("k")), "k", out, rows=45)
    sizes = []
    for d in sorted(x for x in os.listdir(out) if x.startswith("batch=")):
        files = [f for f in os.listdir(f"{out}/{d}") if f.startswith("part-")]
        assert len(files) == 1
        with open(f"{out}/{d}/{files[0]}") as f:
            lines = f.read().splitlines()
        sizes.append(len(lines))
        n = d.removeprefix("batch=")
        assert [x.split()[1] for x in lines] == [f"b{int(n):02d}_act_{i + 1:02d}" for i in range(len(lines))]
    assert sorted(sizes) == [10, 45, 45]


def test_materialize_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "m")
    for _ in range(2):
        assert writers.materialize_once(spark, path, build).count() == 3
    assert calls == [1]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"q'), ("x\ty", "z")], "a string, b string")
    path = str(tmp_path / "c.csv")
    writers.write_csv(df, path)
    assert sorted(rows(readers.read_delimited(spark, path, ","))) == sorted(rows(df))


def test_targets(spark):
    t = targets(spark)
    assert t.count() == 8 and t.where("target = 'HSD17B13'").first()["gene_id"] == 345275
