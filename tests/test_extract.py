import json
import struct

import numpy as np
import pandas as pd
import pytest

from loomspan import cli
from loomspan.kernels import filters
from loomspan.plans import extract as X
from tests.test_discover import mat
from tests.test_sources import element, mat_matrix, nifti

AFFINE = np.diag([2.0, 2.0, 2.0, 1.0])


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """Two runs of 60 volumes (one with a broken confound table) and an atlas of two parcels on another grid."""
    root = tmp_path_factory.mktemp("tree")
    rng = np.random.default_rng(0)
    data = rng.integers(1, 900, (6, 6, 6, 60))
    data[0, 0, 0] = 0  # zeros count
    conf = pd.DataFrame(rng.standard_normal((60, 6)), columns=X.MOTION)
    conf["non_steady_state_outlier00"] = [1, 1] + [0] * 58
    conf["framewise_displacement"] = ["n/a"] + [0.1] * 58 + [2.0]
    for sub in ("1", "2"):
        d = root / f"sub-{sub}" / "func"
        d.mkdir(parents=True)
        stem = f"sub-{sub}_task-rest"
        nifti(d / f"{stem}_space-MNI152NLin2009cAsym_res-2_desc-preproc_bold.nii", data, AFFINE)
        (d / f"{stem}_space-MNI152NLin2009cAsym_res-2_desc-preproc_bold.nii").rename(d / "x")
        import gzip

        (d / f"{stem}_space-MNI152NLin2009cAsym_res-2_desc-preproc_bold.nii.gz").write_bytes(gzip.compress((d / "x").read_bytes(), 1))
        (d / "x").unlink()
        (d / f"{stem}_space-MNI152NLin2009cAsym_res-2_desc-preproc_bold.json").write_text(json.dumps({"RepetitionTime": 2.0}))
        conf[: 60 if sub == "1" else 50].to_csv(d / f"{stem}_desc-confounds_timeseries.tsv", sep="\t", index=False)
    atlas = np.zeros((3, 6, 6), int)
    atlas[0], atlas[1] = 4, 9
    nifti(root / "atlas.nii", atlas, np.diag([4.0, 2.0, 2.0, 1.0]))
    return root, data, conf


def test_series_from_images(spark, tree):
    root, data, conf = tree
    c = X.Cleaning("motion", scrub_fd=0.5, min_volumes=20)
    out = X.project_series(spark, str(root), str(root / "atlas.nii"), c=c).collect()
    bad = [r for r in out if r.error]
    assert len(bad) == 1 and "sub-2" in bad[0].path and "50 rows" in bad[0].error
    got = np.array([r.x for r in sorted((r for r in out if not r.error), key=lambda r: r.t)])
    # nearest voxel of a grid twice as wide, halves to the even one: x = 0, 1 -> 0, x = 2 -> 1, x = 3 -> 2 (no label)
    first = data[:2].reshape(-1, 60).mean(0)
    second = data[2].reshape(-1, 60).mean(0)
    spikes = np.zeros((58, 1))
    spikes[57, 0] = 1
    want = filters.clean(np.column_stack([first, second])[2:], conf[list(X.MOTION)].to_numpy()[2:], spikes, 2.0, c.band, c.standardize)
    assert np.allclose(got, want) and min(r.t for r in out if not r.error) == 2


def test_confound_choice():
    names = [*X.MOTION, "trans_x_derivative1", "trans_x_power2", "a_comp_cor_00", "a_comp_cor_01", "a_comp_cor_02", "cosine00", "global_signal", "edge"]
    t = pd.DataFrame(np.zeros((3, len(names))), columns=names)
    notes = {"a_comp_cor_00": {"Mask": "WM", "VarianceExplained": 0.9}, "a_comp_cor_01": {"Mask": "combined", "VarianceExplained": 0.2}, "a_comp_cor_02": {"Mask": "combined", "VarianceExplained": 0.3}}
    assert X.chosen_confounds(t, notes, X.Cleaning(n_components=1))[0] == [*X.MOTION, "trans_x_derivative1", "a_comp_cor_02", "cosine00"]
    assert X.chosen_confounds(t, {}, X.Cleaning("none", cosine=False, global_signal=True, columns=("ed.e",)))[0] == ["global_signal", "edge"]


def test_parcel_means():
    image = np.array([0.0, 2.0, np.nan, 7.0]).reshape(4, 1, 1, 1)
    labels = np.array([1, 1, 1, 3]).reshape(4, 1, 1)
    got = X.parcel_means(image, labels, np.array([1, 2, 3]), np.array([True, True, True, False]).reshape(4, 1, 1))
    assert got[0, 0] == 1.0 and np.isnan(got[0, 1:]).all()


def fibres(tmp_path):
    a = np.array([[1, 1, 1], [2, 1, 1], [3, 1, 1], [4, 1, 1]], float)
    b = np.array([[1, 2, 1], [1, 3, 1], [4, 3, 1]], float)
    cell = element(14, element(6, struct.pack("<II", 1, 0)) + element(5, struct.pack("<2i", 1, 2)) + element(1, b"fibers") + mat_matrix("", a) + mat_matrix("", b))
    mat(tmp_path / "f.mat", cell)
    atlas = np.zeros((4, 3, 1), int)
    atlas[0], atlas[3] = 1, 2
    nifti(tmp_path / "atlas.nii", atlas, AFFINE)


def test_connectivity_from_fibres(spark, tmp_path):
    fibres(tmp_path)
    got = {(r.i, r.j): r for r in X.fibre_connectivity(spark, str(tmp_path / "f.mat"), str(tmp_path / "atlas.nii")).collect()}
    assert set(got) == {(1, 2), (2, 1)} and got[1, 2]["count"] == 2
    assert np.isclose(got[1, 2].lencorr, 1 / 6 + 1 / 8) and np.isclose(got[1, 2].volcorr, 2 / 3)


def test_commands_on_files(spark, tree, tmp_path):
    root, _, _ = tree
    out = str(tmp_path / "out")
    assert cli.main(["--output-dir", out, "--set", "postprocess.confounds=motion", "--set", "postprocess.min_volumes=20", "timeseries", "--images", str(root), "--atlas", str(root / "atlas.nii")]) == 0
    assert spark.read.parquet(out + "/errors").count() == 1 and len(spark.read.text(out + "/timeseries").collect()) == 58
    fibres(tmp_path)
    assert cli.main(["--output-dir", out, "sc", "normative", "--fibres", str(tmp_path / "f.mat"), "--atlas", str(tmp_path / "atlas.nii")]) == 0
    assert {r.weight for r in spark.read.parquet(out + "/normative").collect()} == {"count", "volcorr", "lencorr", "combined"}
