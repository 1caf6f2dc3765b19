import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomspan.sources import formats, parquet_blocks as B, texts


def small_files(folder, n=12):
    os.makedirs(folder, exist_ok=True)
    tables = []
    for k in range(n):
        t = pa.table({"a": pa.array(range(k * 50, k * 50 + 50)), "s": [None if i % 7 == 0 else f"x{i % 5}" for i in range(50)], "l": [[i, i + 1] for i in range(50)], "d": np.random.default_rng(k).random(50)})
        pq.write_table(t, f"{folder}/f{k:03d}.parquet", row_group_size=20, compression=["snappy", "zstd", "none"][k % 3], write_page_index=k % 2 == 0, use_dictionary=k % 4 != 0)
        tables.append(t)
    return tables


def test_row_groups_are_copied(tmp_path):
    tables = small_files(tmp_path / "in")
    paths = sorted(str(p) for p in (tmp_path / "in").iterdir())
    got = B.merge_files(paths, str(tmp_path / "out.parquet"))
    assert got["n_files"] == 12 and got["n_blocks"] == 36 and got["n_rows"] == 600
    assert pq.read_table(tmp_path / "out.parquet").equals(pa.concat_tables(tables))


def test_footers_survive_a_round_trip(tmp_path):
    small_files(tmp_path / "in", 1)
    f = B.read_footer(str(tmp_path / "in/f000.parquet"))
    w = B.Writer()
    w.struct(f)
    assert B.Reader(bytes(w.raw)).struct() == f


def test_other_schemas_and_broken_files(tmp_path):
    small_files(tmp_path / "in", 2)
    pq.write_table(pa.table({"a": ["x"]}), tmp_path / "in/other.parquet")
    with pytest.raises(ValueError, match="different schemas"):
        B.merge_files([str(tmp_path / "in/f000.parquet"), str(tmp_path / "in/other.parquet")], str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    (tmp_path / "bad.parquet").write_bytes(b"no parquet file at all")
    with pytest.raises(ValueError):
        B.read_footer(str(tmp_path / "bad.parquet"))


def test_compaction(spark, tmp_path):
    tables = small_files(tmp_path / "in/x")
    pq.write_table(pa.table({"z": [1.5]}), tmp_path / "in/other.parquet")
    pq.write_table(tables[0].slice(0, 0), tmp_path / "in/empty.parquet")
    (tmp_path / "in/bad.parquet").write_bytes(b"PAR1 is only half of it")
    rows = B.compact(spark, str(tmp_path / "in"), str(tmp_path / "out"), 8_000).collect()
    good = [r for r in rows if r.error is None]
    assert len([r for r in rows if r.error]) == 1 and 2 <= len(good) < 13
    assert sum(r.n_rows for r in good) == 601
    back = pa.concat_tables([pq.read_table(r.path) for r in good if "a" in pq.read_schema(r.path).names]).sort_by("a")
    assert back.equals(pa.concat_tables(tables).combine_chunks().sort_by("a")) or back.to_pylist() == pa.concat_tables(tables).to_pylist()


def nifti(path, data, affine=None):
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, data.ndim, *data.shape, *[1] * (7 - data.ndim))
    struct.pack_into("<hh", head, 70, 4, 16)
    struct.pack_into("<8f", head, 76, 1, 2, 2, 2, 1, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    if affine is not None:
        struct.pack_into("<h", head, 254, 1)
        struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    head[344:348] = b"n+1\0"
    path.write_bytes(bytes(head) + data.astype("<i2").tobytes(order="F"))


def test_nifti(spark, tmp_path):
    data = np.zeros((4, 3, 2), int)
    data[1, 2, 0], data[3, 0, 1] = 5, -7
    affine = np.array([[2.0, 0, 0, -9], [0, 2, 0, -12], [0, 0, 2, -7], [0, 0, 0, 1]])
    nifti(tmp_path / "a.nii", data, affine)
    got, at = formats.read_nifti(str(tmp_path / "a.nii"))
    assert (got == data).all() and np.allclose(at, affine)
    formats.register(spark)
    every = spark.read.format("nifti").load(str(tmp_path / "*.nii")).collect()
    assert len(every) == 24 and all(r.v == data[r.i, r.j, r.k] and r.t == 0 for r in every)
    rows = {(r.i, r.j, r.k, r.v) for r in spark.read.format("nifti").option("nonzero", "true").load(str(tmp_path / "*.nii")).collect()}
    assert rows == {(1, 2, 0, 5.0), (3, 0, 1, -7.0)}
    with pytest.raises(ValueError):
        (tmp_path / "b.nii").write_bytes(b"x" * 400)
        formats.read_nifti(str(tmp_path / "b.nii"))


def element(kind, raw):
    return struct.pack("<II", kind, len(raw)) + raw + b"\0" * (-len(raw) % 8)


def mat_matrix(name, a):
    return element(14, element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<2i", *a.shape)) + element(1, name.encode()) + element(9, a.astype("<f8").tobytes(order="F")))


def mat_text(name, s):
    return element(14, element(6, struct.pack("<II", 4, 0)) + element(5, struct.pack("<2i", 1, len(s))) + element(1, name.encode()) + element(4, np.array([ord(c) for c in s], "<u2").tobytes()))


def test_matlab(spark, tmp_path):
    a = np.arange(6.0).reshape(2, 3)
    cell = element(14, element(6, struct.pack("<II", 1, 0)) + element(5, struct.pack("<2i", 1, 2)) + element(1, b"names") + mat_text("", "left") + mat_matrix("", a.T))
    packed = zlib.compress(mat_matrix("b", a * 2))
    (tmp_path / "m.mat").write_bytes(b"MATLAB 5.0".ljust(124, b" ") + b"\x00\x01IM" + mat_matrix("a", a) + struct.pack("<II", 15, len(packed)) + packed + mat_text("t", "word") + cell)
    got = formats.read_mat(str(tmp_path / "m.mat"))
    assert (got["a"] == a).all() and (got["b"] == 2 * a).all() and got["t"] == "word" and got["names"][0] == "left" and (got["names"][1] == a.T).all()
    formats.register(spark)
    rows = spark.read.format("matv5").load(str(tmp_path / "m.mat"))
    assert {(r.i, r.j, r.v) for r in rows.where("name = 'a'").collect()} == {(i, j, a[i, j]) for i in range(2) for j in range(3)}
    assert [r.text for r in rows.where("name = 't'").collect()] == ["word"]


def test_npy(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.eye(3))
    np.savez(tmp_path / "y.npz", one=np.ones((2, 2)), two=np.arange(3))
    formats.register(spark)
    assert spark.read.format("npy").load(str(tmp_path / "x.npy")).where("v = 1").count() == 3
    assert {r.name for r in spark.read.format("npy").load(str(tmp_path / "y.npz")).collect()} == {"one", "two"}


def test_participants(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("participant_id\tgroup\tage\n01\tA\t3\nsub-02\tn/a\t4\n sub-03\tB\t\n")
    got = {r.participant_id: (r.group, r.age) for r in texts.read_participants(spark, str(tmp_path / "p.tsv")).collect()}
    assert got == {"sub-01": ("A", "3"), "sub-03": ("B", None)}
    (tmp_path / "q.csv").write_text("id,dx\n1,A\nsub-1,B\n")
    with pytest.raises(Exception, match="duplicate"):
        texts.read_participants(spark, str(tmp_path / "q.csv")).collect()


@pytest.mark.parametrize("text, want", [
    ("index\tname\themisphere\n3\tA_LH\t\n7\tB\tR\n", {3: ("A_LH", "L"), 7: ("B", "R")}),
    ("# colours\n1 LH_Vis 1 2 3 0\n2 RH_Vis 1 2 3 0\n", {1: ("LH_Vis", "L"), 2: ("RH_Vis", "R")}),
    ("Left-A\n4 10 20 30 255\nRight-A\n9 1 2 3 255\n", {4: ("Left-A", "L"), 9: ("Right-A", "R")}),
    ("alpha\n\nbeta L\n", {1: ("alpha", ""), 2: ("beta L", "L")}),
])
def test_label_tables(spark, tmp_path, text, want):
    (tmp_path / "l.txt").write_text(text)
    assert {r.label_id: (r.name, r.hemisphere) for r in texts.read_label_table(spark, str(tmp_path / "l.txt")).collect()} == want


def test_matrices_in_and_out(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("a\tb\tc\n1\t2\t3\n4\t5e-1\t-6\n")
    got = {(r.i, r.j): r.v for r in texts.read_matrix(spark, str(tmp_path / "m.tsv")).collect()}
    assert got == {(0, 0): 1, (0, 1): 2, (0, 2): 3, (1, 0): 4, (1, 1): 0.5, (1, 2): -6}
    flipped = {(r.i, r.j): r.v for r in texts.read_matrix(spark, str(tmp_path / "m.tsv"), 2).collect()}
    assert flipped == {(j, i): v for (i, j), v in got.items()}
    df = spark.createDataFrame([("x", i, j, 0.1 * (i + 1) if j else None) for i in range(3) for j in range(2)], "matrix_id string, i int, j int, v double")
    texts.write_matrices(df, str(tmp_path / "out"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines == ["n/a\t0.1", "n/a\t0.2", "n/a\t0.3"]
    assert texts.json_text({"a": float("nan"), "b": np.float64(1.5), "c": np.arange(2)}).replace("\n", "").replace(" ", "") == '{"a":null,"b":1.5,"c":[0,1]}'


def test_parcel_map(spark, tmp_path):
    parcels = spark.createDataFrame([(0, 5, "a"), (1, 7, "b"), (2, 9, "c")], "pos int, label_id int, name string")
    (tmp_path / "i.tsv").write_text("index\tmyelin\n9\t1.5\n5\tn/a\n")
    assert {r.pos: r.value for r in texts.read_parcel_map(spark, str(tmp_path / "i.tsv"), parcels).collect()} == {0: None, 1: None, 2: 1.5}
    (tmp_path / "n.tsv").write_text("name\tvalue\nb\t2\n")
    assert {r.pos: r.value for r in texts.read_parcel_map(spark, str(tmp_path / "n.tsv"), parcels).collect()} == {0: None, 1: 2.0, 2: None}
