"""Configuration: YAML over defaults, ``${VAR}`` and ``${VAR:-default}``, paths relative to the root, dotted keys."""

from __future__ import annotations

import copy
import os
import re
from typing import Any

import yaml

#: Defaults (fixed values).
DEFAULTS = yaml.safe_load("""
paths: {root: null, bids_dir: null, derivatives_dir: null, fmriprep_dir: null, halfpipe_dir: null, qsiprep_dir: null, qsirecon_dir: null, atlas_dir: null,
        participants_tsv: null, output_dir: derivatives/loomspan, work_dir: work, normative_connectome: null, template_dir: null, fs_license: "${FS_LICENSE:-}"}
participants: {id_column: null, group_column: null, include: null, exclude: null}
input: {source: auto, task: rest, session: null, run: null, space: MNI152NLin2009cAsym, res: "2", tr: null, timeseries_glob: null, prefiltered_band: auto}
atlas: {name: null, file: null, labels: null, allow_space_mismatch: false}
fmriprep: {runtime: auto, image: "nipreps/fmriprep:24.1.1", sif: null, output_spaces: ["MNI152NLin2009cAsym:res-2"], nprocs: 8, omp_nthreads: 4, mem_mb: 16000,
           fs_no_reconall: false, skip_bids_validation: true, extra_args: [], templateflow_home: "${TEMPLATEFLOW_HOME:-}"}
postprocess: {confounds: acompcor, custom_regex: [], n_acompcor: 5, acompcor_mask: combined, include_cosine: true, global_signal: false, motion_outliers: false,
              scrub_fd: null, band: [0.008, 0.08], detrend: true, standardize: zscore_sample, dummy_scans: auto, min_volumes: 100}
sc: {source: auto, weight: combined, normalize: max, sc_max: 0.2, symmetrize: true, log_transform: false, threshold: 0.0,
     tractography: {n_streamlines: 10000000, step_size: 0.5, max_angle: 30.0, min_length: 10.0, max_length: 250.0, fod_cutoff: 0.06, sift2: true, act: auto, endpoints_only: true}}
model:
  filter_band: [0.008, 0.08]
  tau_tr: 1
  a: -0.02
  beta: 0.02
  dt: 0.1
  G: null
  transient_s: 100.0
  min_volumes: 50
  search: {enabled: true, G: {start: 0.0, stop: 3.0, step: 0.1}, a: null, metric: fit_rmse, border_action: extend, extend_factor: 0.5, max_extensions: 2, G_min: 0.0, G_max: 10.0,
           a_min: -1.0, a_max: 0.5, allow_zero_G: false, refine: true, refine_points: 7, interpolate: true, continuous: false, continuous_max_fev: 60}
  gec: {eps_fc: 0.001, eps_tau: 0.001, max_iter: 2000, min_iter: 20, patience: 50, mask: sc_plus_homotopic, init: sc}
  linear: {method: gradient, require_subcritical: true, fit_omega: true, fit_a: none, lambda_group: auto, lambda_grid: [0.0, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0], w_fc: 1.0, w_tau: 1.0, max_iter: 500}
  nonlinear: {method: surrogate, step_frac: 0.05, n_noise_seeds: 3, n_sim: 4, max_iter: 300, patience: 20, seed: 0}
  fcd: {window_tr: 30, step_tr: 3}
  ndte: {max_lag: 10, n_surrogates: 100, seed: 0, fdr_q: 0.05, p_source: kde}
  heterogeneity: {enabled: false, map: null, a0: null, beta: {start: -0.05, stop: 0.05, num: 11}, clip: [-0.9, 0.9], zscore: true}
group: {pooled: true, min_subjects: 2, compare: true, fdr_q: 0.05, n_perm: 0, hierarchical: true, cross_validate: true, cv_max_extensions: 2}
nodes: {auto: true, exclude: [], min_coverage: 1.0}
stages: [timeseries, sc, fit]
""")

VARIABLE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


def expand(value: Any) -> Any:
    """Variables in all strings; one that is not set and has no default stays as it is."""
    if isinstance(value, str):
        return VARIABLE.sub(lambda m: os.environ.get(m[1], m[2] if m[2] is not None else m[0]), value)
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    return [expand(v) for v in value] if isinstance(value, list) else value


def merge(base: dict, over: dict | None) -> dict:
    """Dicts are merged key by key, everything else is replaced."""
    out = copy.deepcopy(base)
    for k, v in (over or {}).items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def get(cfg: dict, key: str, default: Any = None) -> Any:
    for part in key.split("."):
        if not isinstance(cfg, dict) or part not in cfg:
            return default
        cfg = cfg[part]
    return default if cfg is None else cfg


def put(cfg: dict, key: str, value: Any) -> None:
    *path, last = key.split(".")
    for part in path:
        cfg = cfg.setdefault(part, {})
    cfg[last] = value


def resolved(cfg: dict, base: str) -> dict:
    """Paths absolute against the root (itself against ``base``); derivative folders found beside each other."""
    paths = cfg["paths"]
    absolute = lambda p, at: os.path.normpath(os.path.join(at, os.path.expanduser(p)))
    root = absolute(paths["root"] or ".", base)
    out = {k: absolute(v, root) if v and k != "root" else v for k, v in paths.items()} | {"root": root}
    if out.get("derivatives_dir"):
        for name in ("fmriprep", "halfpipe", "qsiprep", "qsirecon"):
            there = os.path.join(out["derivatives_dir"], name)
            if not out.get(f"{name}_dir") and os.path.isdir(there):
                out[f"{name}_dir"] = there
    if out.get("bids_dir") and not out.get("participants_tsv"):
        out["participants_tsv"] = os.path.join(out["bids_dir"], "participants.tsv")
    return cfg | {"paths": out}


def load(path: str | None = None, overrides: list[str] = ()) -> dict:
    """Configuration of a file, with ``key.sub=value`` overrides (values are YAML)."""
    given = {}
    if path:
        with open(path) as f:
            given = yaml.safe_load(f) or {}
    cfg = merge(DEFAULTS, given)
    for o in overrides:
        key, _, value = o.partition("=")
        put(cfg, key.strip(), yaml.safe_load(value))
    return resolved(expand(cfg), os.path.dirname(os.path.abspath(path)) if path else os.getcwd())


def grid(spec: Any) -> list[float]:
    """Values of a grid: list, scalar, {values}, {start, stop, num} or {start, stop, step} with the stop included."""
    if spec is None:
        return []
    if isinstance(spec, dict):
        if "values" in spec:
            return [float(v) for v in spec["values"]]
        a, b = float(spec["start"]), float(spec["stop"])
        if "num" in spec:
            n = int(spec["num"])
            return [a + (b - a) * k / max(n - 1, 1) for k in range(n)]
        step = float(spec.get("step", 0.1))
        return [a + step * k for k in range(int((b - a) / step + 1e-9) + 1)]
    return [float(v) for v in spec] if isinstance(spec, (list, tuple)) else [float(spec)]


def as_list(x: Any) -> list:
    return [] if x is None else list(x) if isinstance(x, (list, tuple)) else [x]
