import os
from datetime import datetime

import pandas as pd
import pytest

from loomspan import cli, commands, config
from loomspan.functions import names as N
from loomspan.streaming import live


def test_configuration(tmp_path, monkeypatch):
    monkeypatch.setenv("SITE", "here")
    (tmp_path / "c.yaml").write_text("paths: {root: ., bids_dir: '${SITE}/bids', fs_license: '${NONE:-lic}', work_dir: '${UNSET}/w'}\nmodel: {search: {G: [1, 2]}}\n")
    c = config.load(str(tmp_path / "c.yaml"), ["model.a=-0.1", "nodes.exclude=[x, y]", "new.key=1"])
    assert c["paths"]["bids_dir"] == str(tmp_path / "here/bids") and c["paths"]["participants_tsv"].endswith("here/bids/participants.tsv")
    assert c["paths"]["fs_license"].endswith("lic") and "${UNSET}" in c["paths"]["work_dir"]
    assert c["model"]["search"]["G"] == [1, 2] and c["model"]["search"]["metric"] == "fit_rmse" and c["model"]["a"] == -0.1 and c["nodes"]["exclude"] == ["x", "y"]
    assert config.get(c, "new.key") == 1 and config.get(c, "no.such", 5) == 5 and config.DEFAULTS["model"]["a"] == -0.02
    (tmp_path / "d/fmriprep").mkdir(parents=True)
    assert config.load(None, [f"paths.derivatives_dir={tmp_path}/d"])["paths"]["fmriprep_dir"] == f"{tmp_path}/d/fmriprep"


def test_grids():
    assert config.grid({"start": 0, "stop": 0.3, "step": 0.1}) == pytest.approx([0, 0.1, 0.2, 0.3]) and config.grid({"start": 0, "stop": 1, "num": 3}) == [0, 0.5, 1]
    assert config.grid(2) == [2.0] and config.grid([1, 2]) == [1, 2] and config.grid(None) == [] and config.grid({"values": [3]}) == [3.0]
    assert config.as_list(None) == [] and config.as_list("a") == ["a"] and config.as_list((1, 2)) == [1, 2]


def test_command_lines():
    native = commands.preprocessing("/b", "/o", ["sub-01"], {"runtime": "native"}, "/w", "/lic")
    assert native[:3] == ["fmriprep", "/b", "/o"] and native[-2:] == ["--fs-license-file", "/lic"] and "--participant-label" in native and "01" in native
    docker = commands.preprocessing("/b", "/o", [], {"runtime": "docker", "templateflow_home": "/t"}, "/w")
    assert "/b:/data:ro" in docker and "TEMPLATEFLOW_HOME=/home/fmriprep/.cache/templateflow" in docker and "--participant-label" not in docker
    with pytest.raises(ValueError):
        commands.preprocessing("/b", "/o", [], {"runtime": "apptainer"}, "/w")
    with pytest.raises(RuntimeError):
        commands.runtime(which=lambda x: None)
    assert commands.runtime(which=lambda x: x == "docker") == "docker" and commands.runtime("auto", "x.sif", lambda x: x in ("docker", "apptainer")) == "apptainer"


def test_scripts(tmp_path):
    s = commands.tracking_script("d.nii.gz", "/out dir", "atlas.nii", {"n_streamlines": 1000, "step_size": 0.5}, "v", "b", t1w="t1.nii", preprocessed=False)
    assert "dwidenoise" in s and "-select 1000" in s and "-step 0.5" in s and "-act 5tt.mif" in s and s.count("tck2connectome") == 4 and "'/out dir'" in s
    assert "tcksift2" not in commands.tracking_script("d", "o", None, {"sift2": False}, grad="g") and "-grad g" in commands.tracking_script("d", "o", None, {}, grad="g")
    assert "antsRegistration" in commands.warp_script("a", "t", "s", "o") and "antsRegistration" not in commands.warp_script("a", "t", "s", "o", transform="x.h5")
    p = commands.write_script(s, str(tmp_path / "x/run.sh"))
    assert os.access(p, os.X_OK)


def test_command_line_interface(tmp_path, capsys):
    assert cli.main(["init-config", str(tmp_path / "c.yaml")]) == 0 and cli.main(["init-config", str(tmp_path / "c.yaml")]) == 1
    assert cli.main(["-c", str(tmp_path / "c.yaml"), "fmriprep", "--runtime", "native", "--participant-label", "sub-1"]) == 0
    assert "fmriprep" in capsys.readouterr().out
    assert cli.main(["fit"]) == 2
    assert cli.main(["--data", "x", "run", "--stages", "nonsense"]) == 2


def test_stages_write_tables(spark, tiny, tmp_path):
    cli.run_queries(["src_participants", "ag_sc_summary"], tiny, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "ag_sc_summary")).count() == 1


@pytest.mark.parametrize("path, stem, ext", [("a/b.nii.gz", "b", ".nii.gz"), ("x.tsv", "x", ".tsv"), ("y", "y", ""), ("a.b.c", "a.b", ".c"), ("", "", "")])
def test_endings(spark, path, stem, ext):
    df = spark.createDataFrame([(path,)], "p string")
    assert tuple(df.select(N.strip_ext(df.p), N.extension(df.p)).first()) == (stem, ext)


def test_entities(spark):
    df = spark.createDataFrame([("/x/sub-01_ses-a_task-r-b_odd_task-z_x1-2_bold.nii.gz",), ("sub-1_run-2.tsv",), (None,)], "p string")
    a, b, c = [r[0] for r in df.select(N.entities(df.p)).collect()]
    assert a == {"sub": "01", "ses": "a", "task": "z", "suffix": "bold", "_extra": "odd_x1-2", "extension": ".nii.gz"}
    assert b == {"sub": "1", "run": "2", "extension": ".tsv"} and c is None


def test_names(spark):
    df = spark.createDataFrame([(" 7",), ("sub-9",), ("Participant_012",), ("x y",), (None,)], "s string")
    assert [r[0] for r in df.select(N.norm_subject(df.s, 2)).collect()] == ["sub-07", "sub-09", "sub-012", "sub-xy", None]
    df = spark.createDataFrame([("7Networks_LH_Vis_1",), ("HIP-rh",), ("Left Thalamus",), ("LHx",), ("A_L_B_R",)], "n string")
    assert [r[0] for r in df.select(N.hemisphere(df.n)).collect()] == ["L", "R", "L", "", "L"]
    assert [r[0] for r in df.select(N.homotopic_key(df.n)).collect()] == ["7Networks_*_Vis_1", "HIP-*", "* Thalamus", "LHx", "A_*_B_*"]


def test_streamed_pairs_add_up(spark, tmp_path):
    rows = [(s, p, (s * 3 + p) % 4, 2.0 + s) for s in range(9) for p in range(3)]
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[0] % 3 == k], live.POINT).write.mode("append").parquet(str(tmp_path / "in"))
        live.accumulate_pairs(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination()
    from loomspan.operators.paths import touched_pairs

    df = spark.createDataFrame(rows, live.POINT)
    whole = touched_pairs(df, df.select("sid", "length").distinct())
    as_set = lambda x: {(r.i, r.j, r["count"], round(r.lenw, 9)) for r in x.collect()}
    assert as_set(live.pair_counts(spark, str(tmp_path / "state"))) == as_set(whole)


def test_forward_filter_keeps_its_state(spark, tmp_path):
    import numpy as np

    from loomspan.kernels import filters

    x = np.random.default_rng(0).standard_normal(60)
    for part in (x[:25], x[25:]):
        t0 = 0 if len(part) == 25 else 25
        spark.createDataFrame(pd.DataFrame({"series": "a", "t": np.arange(t0, t0 + len(part), dtype=np.int32), "x": part}), "series string, t int, x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("series string, t int, x double").parquet(str(tmp_path / "in"))
        q = live.forward_filter(stream, 2.0, (0.02, 0.2)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = [r.y for r in spark.read.parquet(str(tmp_path / "out")).orderBy("t").collect()]
    want = filters.recursive(*filters.butterworth(2.0, (0.02, 0.2)), x[:, None])[:, 0]
    assert np.allclose(got, want)


def test_windowed_means(spark, tmp_path):
    ev = spark.createDataFrame([(datetime(2024, 1, 1, 1), 1, 2.0), (datetime(2024, 1, 1, 5), 1, 4.0), (datetime(2024, 1, 3), 1, 0.0)], "ts timestamp, user_id long, value double")
    ev.write.parquet(str(tmp_path / "in"))
    q = live.windowed_means(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("means").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["mean"], r.n) for r in spark.sql("select * from means").collect()) == [(0.0, 1), (3.0, 2)]
