import json

import numpy as np
import pytest

from loomspan.sources import discover, sinks
from tests.test_sources import element, mat_matrix, nifti


def touch(path, text="x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture
def tree(tmp_path):
    f = tmp_path / "derivatives/fmriprep/sub-01/func"
    stem = "sub-01_task-rest_run-1"
    for sp in ("space-MNI152NLin2009cAsym_res-2", "space-MNI152NLin2009cAsym_res-1", "space-T1w"):
        touch(f / f"{stem}_{sp}_desc-preproc_bold.nii.gz")
    touch(f / f"{stem}_space-MNI152NLin2009cAsym_res-2_desc-brain_mask.nii.gz")
    touch(f / f"{stem}_desc-confounds_regressors.tsv")
    touch(f / f"{stem}_desc-confounds_timeseries.tsv")
    touch(f / f"{stem}_desc-confounds_timeseries.json", "{}")
    touch(f / f"{stem}_space-T1w_desc-preproc_bold.json", json.dumps({"TR": 1.5}))
    touch(f.parent.parent / "task-rest_bold.json", json.dumps({"RepetitionTime": 2.5}))
    touch(tmp_path / "derivatives/halfpipe/sub-01/func/sub-01_task-rest_feature-fc_atlas-A_timeseries.tsv", "1\t2\n")
    touch(tmp_path / "derivatives/halfpipe/sub-02/func/sub-02_task-nback_feature-fc_atlas-A_timeseries.tsv", "1\t2\n")
    return tmp_path


def test_runs_and_companions(spark, tree):
    rows = discover.bold_runs(spark, str(tree / "derivatives/fmriprep"), space="mni152nlin2009casym").collect()
    assert len(rows) == 1 and rows[0].res == "2" and rows[0].mask.endswith("res-2_desc-brain_mask.nii.gz")
    assert rows[0].confounds.endswith("_timeseries.tsv") and rows[0].confounds_json.endswith("_timeseries.json")
    assert discover.bold_runs(spark, str(tree / "derivatives/fmriprep"), task="nback").count() == 0
    every = discover.bold_runs(spark, str(tree / "derivatives/fmriprep"), space=None, res=None)
    tr = {r.path.split("run-1_")[1].split("_desc")[0]: r.tr for r in discover.repetition_times(spark, every, str(tree / "derivatives/fmriprep")).collect()}
    assert tr == {"space-T1w": 1.5, "space-MNI152NLin2009cAsym_res-2": 2.5, "space-MNI152NLin2009cAsym_res-1": 2.5}


def test_series_and_roots(spark, tree):
    assert [r["sub"] for r in discover.feature_series(spark, str(tree / "derivatives/halfpipe"), task="rest").collect()] == ["01"]
    for entry in (tree, tree / "derivatives", tree / "derivatives/halfpipe"):
        assert discover.derivative_roots(str(entry))["halfpipe"] == str(tree / "derivatives/halfpipe")
        assert discover.derivative_roots(str(entry))["fmriprep"] == str(tree / "derivatives/fmriprep")
    assert {r.participant_id: r.group for r in discover.subjects_as_participants(spark, str(tree / "derivatives/halfpipe")).collect()} == {"sub-01": "all", "sub-02": "all"}
    assert discover.templates(None) == {}


def test_connectivity_keys():
    keys = ["a_region_labels", "x_sift_invlength_connectivity", "x_radius2_count_connectivity", "x_sift_radius2_count_connectivity", "x_mean_length_connectivity"]
    assert discover.select_key(keys) == "x_sift_radius2_count_connectivity" and discover.select_key(keys, "mean_length") == "x_mean_length_connectivity"
    assert discover.select_key(["A_count", "B_count"], atlas="b") == "B_count"
    with pytest.raises(KeyError):
        discover.select_key(["region_labels"])


def mat(path, *parts):
    path.write_bytes(b"MATLAB 5.0".ljust(124, b" ") + b"\x00\x01IM" + b"".join(parts))


def test_matlab_matrices_and_fibers(spark, tmp_path):
    import struct

    m = np.arange(9.0).reshape(3, 3)
    mat(tmp_path / "c.mat", mat_matrix("z_count_connectivity", m), mat_matrix("z_length_connectivity", m * 2))
    assert {(r.i, r.j): r.v for r in discover.mat_matrix(spark, str(tmp_path / "c.mat")).collect()} == {(i, j): m[i, j] for i in range(3) for j in range(3)}
    a, b = np.arange(12.0).reshape(4, 3), np.arange(15.0).reshape(3, 5)
    cell = element(14, element(6, struct.pack("<II", 1, 0)) + element(5, struct.pack("<2i", 1, 2)) + element(1, b"fibers") + mat_matrix("", a) + mat_matrix("", b))
    mat(tmp_path / "f.mat", cell)
    got = {(r.sid, r.p): (r.x, r.y, r.z) for r in discover.mat_fibers(spark, str(tmp_path / "f.mat")).collect()}
    assert got == {(0, p): tuple(a[p]) for p in range(4)} | {(1, p): tuple(b[:, p]) for p in range(5)}
    mat(tmp_path / "r.mat", mat_matrix("count", np.ones((2, 3))))
    with pytest.raises(ValueError, match="square"):
        discover.mat_matrix(spark, str(tmp_path / "r.mat"))


def test_atlas(spark, tmp_path):
    data = np.zeros((5, 4, 3), int)
    data[0], data[1], data[3, 1] = 7, 2, 40
    nifti(tmp_path / "a.nii", data)
    labels = spark.createDataFrame([(7, "LH_Vis", "", "Vis"), (2, "x", "R", "")], "label_id int, name string, hemisphere string, network string")
    got = [(r.pos, r.label_id, r.name, r.hemisphere) for r in discover.atlas_parcels(spark, str(tmp_path / "a.nii"), labels).orderBy("pos").collect()]
    assert got == [(0, 2, "x", "R"), (1, 7, "LH_Vis", "L"), (2, 40, "roi_40", "")]
    assert discover.atlas_parcels(spark, str(tmp_path / "a.nii")).count() == 3


def test_sinks(spark, tmp_path):
    fit = spark.createDataFrame([(1, 0, "gec", 0, 1, 0.5, None), (1, 0, "gec", 0, 0, 0.0, None), (2, 0, "gec", None, None, None, "bad")], "participant int, run long, method string, i int, j int, ec double, error string")
    sinks.write_fit(fit, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "fits")).count() == 3 and [r.value for r in spark.read.text(str(tmp_path / "matrices")).collect()] == ["0\t0.5"]
    s = spark.createDataFrame([(0, 1, 3, 0.1, 0.2, 0.3)], "i int, j int, count long, volcorr double, lencorr double, combined double")
    sinks.write_structure(s, str(tmp_path / "sc"))
    assert {(r.weight, r.v) for r in spark.read.parquet(str(tmp_path / "sc")).collect()} == {("count", 3.0), ("volcorr", 0.1), ("lencorr", 0.2), ("combined", 0.3)}
    p = sinks.write_description(str(tmp_path / "d"))
    assert json.load(open(p))["DatasetType"] == "derivative" and sinks.write_description(str(tmp_path / "d")) == p
    sinks.write_summary(str(tmp_path / "s/x.json"), {"a": float("nan")})
    assert json.load(open(tmp_path / "s/x.json")) == {"a": None}
