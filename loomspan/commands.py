"""Command lines and scripts of external programs; nothing is run here."""

from __future__ import annotations

import os
import shlex
import shutil
import stat


def runtime(preferred: str = "auto", image_file: str | None = None, which=shutil.which) -> str:
    """How to run the preprocessing: as asked, else the first there is."""
    if preferred != "auto":
        return preferred
    order = [("fmriprep", "native"), ("fmriprep-docker", "fmriprep-docker")] + ([(x, x) for x in ("apptainer", "singularity")] if image_file else []) + [(x, x) for x in ("docker", "apptainer", "singularity")]
    found = next((name for program, name in order if which(program)), None)
    if found is None:
        raise RuntimeError("no runtime for the preprocessing found")
    return found


def preprocessing(bids: str, out: str, participants: list[str], cfg: dict, work: str, license_file: str | None = None, how: str | None = None) -> list[str]:
    """Arguments of one participant-level run, natively or in a container."""
    how = runtime(how or cfg.get("runtime", "auto"), cfg.get("sif"))
    n = int(cfg.get("nprocs", 8))
    app = ["participant", "--output-spaces", *(cfg.get("output_spaces") or ["MNI152NLin2009cAsym:res-2"]), "--nprocs", str(n), "--omp-nthreads", str(cfg.get("omp_nthreads", min(4, n))), "--mem-mb", str(cfg.get("mem_mb", 16000)), "--notrack"]
    if participants:
        app += ["--participant-label", *[p.removeprefix("sub-") for p in participants]]
    app += [flag for key, flag, default in (("skip_bids_validation", "--skip-bids-validation", True), ("fs_no_reconall", "--fs-no-reconall", False)) if cfg.get(key, default)]
    app += [str(x) for x in cfg.get("extra_args") or []]
    if how in ("native", "fmriprep-docker"):
        return ["fmriprep" if how == "native" else how, bids, out, *app, "-w", work, *(["--fs-license-file", license_file] if license_file else [])]
    inside_license = "/opt/freesurfer/license.txt"
    mounts = [f"{bids}:/data:ro", f"{out}:/out", f"{work}:/work"] + ([f"{license_file}:{inside_license}:ro"] if license_file else [])
    cache = cfg.get("templateflow_home")
    tail = ["/data", "/out", *app, "-w", "/work", *(["--fs-license-file", inside_license] if license_file else [])]
    if how == "docker":
        flag, home, env = "-v", "/home/fmriprep/.cache/templateflow", "-e"
        head, image = ["docker", "run", "--rm", "-u", f"{os.getuid()}:{os.getgid()}"], cfg.get("image", "nipreps/fmriprep:24.1.1")
    elif how in ("apptainer", "singularity"):
        flag, home, env = "-B", "/templateflow", "--env"
        head, image = [how, "run", "--cleanenv"], cfg.get("sif")
        if not image:
            raise ValueError("a container file is needed (fmriprep.sif)")
    else:
        raise ValueError(f"unknown runtime {how!r}")
    if cache:
        mounts.append(f"{cache}:{home}")
    return head + [x for m in mounts for x in (flag, m)] + ([env, f"TEMPLATEFLOW_HOME={home}"] if cache else []) + [str(image), *tail]


def tracking_script(dwi: str, out: str, atlas: str | None, cfg: dict, bvec: str | None = None, bval: str | None = None, grad: str | None = None, mask: str | None = None, t1w: str | None = None, preprocessed: bool = True, pe_dir: str | None = None, threads: int = 4) -> str:
    """Shell script of fibre tracking for one subject: preparation, orientation distributions, tracking, connectomes."""
    q = lambda x: shlex.quote(str(x))
    act = t1w is not None and cfg.get("act", "auto") in (True, "auto")
    steps = [f"mrconvert {q(dwi)} dwi.mif " + (f"-grad {q(grad)}" if grad else f"-fslgrad {q(bvec)} {q(bval)}")]
    if preprocessed:
        steps.append("cp dwi.mif clean.mif")
    else:
        steps += ["dwidenoise dwi.mif denoised.mif", "mrdegibbs denoised.mif unringed.mif", f"dwifslpreproc unringed.mif corrected.mif -rpe_none -pe_dir {pe_dir or 'AP'} -eddy_options ' --slm=linear'", "dwibiascorrect ants corrected.mif clean.mif"]
    steps.append(f"mrconvert {q(mask)} mask.mif" if mask else "dwi2mask clean.mif mask.mif")
    steps += ["dwi2response dhollander clean.mif wm.txt gm.txt csf.txt -mask mask.mif", "dwi2fod msmt_csd clean.mif wm.txt fod.mif gm.txt gm.mif csf.txt csf.mif -mask mask.mif", "mtnormalise fod.mif fod_norm.mif gm.mif gm_norm.mif csf.mif csf_norm.mif -mask mask.mif"]
    seed, extra = "-seed_dynamic fod_norm.mif", ""
    if act:
        steps += [f"5ttgen fsl {q(t1w)} 5tt.mif", "5tt2gmwmi 5tt.mif border.mif"]
        seed, extra = "-seed_gmwmi border.mif", " -act 5tt.mif -backtrack -crop_at_gmwmi"
    step = f" -step {cfg['step_size']}" if cfg.get("step_size") else ""
    steps.append(f"tckgen fod_norm.mif tracks.tck -algorithm iFOD2 -select {int(cfg.get('n_streamlines', 10_000_000))} -cutoff {cfg.get('fod_cutoff', 0.06)} -minlength {cfg.get('min_length', 10.0)} -maxlength {cfg.get('max_length', 250.0)} -angle {cfg.get('max_angle', 45.0)}{step} {seed}{extra}")
    weights = ""
    if cfg.get("sift2", True):
        steps.append("tcksift2 tracks.tck fod_norm.mif weights.txt" + (" -act 5tt.mif" if act else ""))
        weights = " -tck_weights_in weights.txt"
    if atlas:
        assign = "-assignment_radial_search 2" if cfg.get("endpoints_only", True) else "-assignment_all_voxels"
        for name, scale in (("count", ""), ("meanlength", " -scale_length -stat_edge mean"), ("invnodevol", " -scale_invnodevol"), ("invlength", " -scale_invlength")):
            steps.append(f"tck2connectome tracks.tck {q(atlas)} sc_{name}.csv{weights} {assign} -symmetric -zero_diagonal{scale}")
    head = ["#!/usr/bin/env bash", "set -euo pipefail", f"export MRTRIX_NTHREADS={threads}", f"mkdir -p {q(out)} && cd {q(out)}"]
    return "\n".join(head + [s + (" -force" if not s.startswith("cp ") else "") for s in steps]) + "\n"


def warp_script(atlas: str, template: str, subject: str, out: str, reference: str | None = None, transform: str | None = None) -> str:
    """Shell script that brings an atlas from template to subject space, with a transform at hand or a registration."""
    q = lambda x: shlex.quote(str(x))
    apply = f"antsApplyTransforms -d 3 -i {q(atlas)} -r {q(reference or subject)} -o atlas_in_dwi.nii.gz -n GenericLabel"
    steps = [f"{apply} -t {q(transform)}"] if transform else [f"antsRegistrationSyNQuick.sh -d 3 -f {q(subject)} -m {q(template)} -o to_subject_ -n 4", f"{apply} -t to_subject_1Warp.nii.gz -t to_subject_0GenericAffine.mat"]
    return "\n".join([f"cd {q(out)}", *steps]) + "\n"


def write_script(text: str, path: str) -> str:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    os.chmod(path, os.stat(path).st_mode | stat.S_IXUSR)
    return path
