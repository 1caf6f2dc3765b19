"""From files to data: series of parcels from images, and connectivity from fibre files.

An image is a task. Its voxels never become rows: each worker sums the parcels of a volume in place, so what is shuffled
or returned is volumes x parcels. Zero voxels inside a parcel and the mask count in its mean.

Defined results: a parcel without a voxel in the mask is null in every volume; a run that cannot be read, fits no atlas,
or has too few volumes is one row with its error.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.kernels import filters
from loomspan.operators import paths
from loomspan.sources import discover, formats, texts

SERIES = "path string, t int, x array<double>, error string"
MOTION = tuple(f"{kind}_{axis}" for kind in ("trans", "rot") for axis in "xyz")


@dataclass(frozen=True)
class Cleaning:
    """What is taken from a confound table, and how the series are filtered."""

    strategy: str = "acompcor"  # motion and components; or motion, or none
    n_components: int = 5
    mask: str = "combined"
    cosine: bool = True
    global_signal: bool = False
    scrub_fd: float | None = None
    columns: tuple[str, ...] = ()  # more, as regular expressions
    band: tuple[float, float] | None = (0.008, 0.08)
    standardize: str = "zscore_sample"
    dummy: int | None = None  # first volumes left out; None: as many as the table marks
    min_volumes: int = 100


def label_grid(atlas: str, shape: tuple[int, ...], affine: np.ndarray) -> np.ndarray:
    """Labels of the atlas on an image's grid: as they stand on the same grid, else each voxel's nearest."""
    labels, at = formats.read_nifti(atlas)
    labels = np.rint(labels).astype(np.int64)
    labels = labels.reshape(labels.shape[:3])
    if labels.shape == tuple(shape) and np.allclose(at, affine, atol=1e-3):
        return labels
    index = np.indices(shape).reshape(3, -1)
    to = np.rint(np.linalg.solve(at, affine) @ np.vstack([index, np.ones(index.shape[1])]))[:3].astype(np.int64)
    inside = ((to >= 0) & (to < np.array(labels.shape)[:, None])).all(0)
    out = np.zeros(index.shape[1], np.int64)
    out[inside] = labels[tuple(to[:, inside])]
    return out.reshape(shape)


def parcel_means(image: np.ndarray, labels: np.ndarray, ids: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Volumes x parcels: mean of the finite voxels of each parcel (NaN without one)."""
    image = image.reshape(*image.shape[:3], -1)
    use = np.isin(labels, ids) if mask is None else np.isin(labels, ids) & mask
    group = np.searchsorted(ids, labels[use])
    out = np.full((image.shape[3], len(ids)), np.nan)
    for t in range(image.shape[3]):
        v = np.asarray(image[..., t][use], float)
        ok = np.isfinite(v)
        n = np.bincount(group[ok], minlength=len(ids))
        out[t, n > 0] = np.bincount(group[ok], v[ok], len(ids))[n > 0] / n[n > 0]
    return out


def chosen_confounds(table: pd.DataFrame, attributes: dict, c: Cleaning) -> tuple[list[str], np.ndarray]:
    """Columns to regress out, and the volumes to mark by a column each."""
    names = list(table.columns)
    picked = [] if c.strategy == "none" else [n for n in names if re.fullmatch(rf"({'|'.join(MOTION)})(_derivative1)?", n)]
    if c.strategy == "acompcor":
        known = sorted(((a.get("Mask") or "combined", -float(a.get("VarianceExplained") or 0), n) for n, a in attributes.items() if n.startswith("a_comp_cor") and n in names and a.get("Retained", True)), key=lambda x: x[1:])
        best = [n for mask, _, n in known if mask == c.mask] or ([n for _, _, n in known] if known else sorted(n for n in names if n.startswith("a_comp_cor")))
        picked += best[: c.n_components]
    picked += [n for n in names if c.cosine and re.fullmatch(r"cosine\d*", n)] + (["global_signal"] if c.global_signal and "global_signal" in names else [])
    picked += [n for n in names if any(re.fullmatch(p, n) for p in c.columns)]
    fd = pd.to_numeric(table["framewise_displacement"], errors="coerce").fillna(0).to_numpy() if c.scrub_fd is not None and "framewise_displacement" in names else np.zeros(len(table))
    return list(dict.fromkeys(picked)), np.flatnonzero(fd > (c.scrub_fd if c.scrub_fd is not None else np.inf))


def cleaned_run(path: str, mask: str | None, confounds: str | None, attributes: str | None, tr: float, atlas: str, ids: np.ndarray, c: Cleaning) -> tuple[int, np.ndarray]:
    """(volumes left out, volumes x parcels) of one run."""
    image, affine = formats.read_nifti(path)
    if image.ndim != 4:
        raise ValueError(f"{image.ndim} dimensions, a run has 4")
    inside = None
    if mask:
        m, _ = formats.read_nifti(mask)
        if m.reshape(m.shape[:3]).shape != image.shape[:3]:
            raise ValueError("mask and run differ in their grids")
        inside = m.reshape(m.shape[:3]) > 0
    x = parcel_means(image, label_grid(atlas, image.shape[:3], affine), ids, inside)
    columns, spikes, first = None, None, c.dummy or 0
    if confounds:
        table = pd.read_csv(confounds, sep="\t", na_values=["n/a"])
        if len(table) != len(x):
            raise ValueError(f"{len(table)} rows of confounds for {len(x)} volumes")
        steady = [n for n in table.columns if n.startswith("non_steady_state_outlier")]
        if c.dummy is None and steady:
            marked = np.flatnonzero(table[steady].fillna(0).to_numpy().any(1))
            first = int(marked.max()) + 1 if len(marked) else 0
        notes = json.load(open(attributes)) if attributes else {}
        names, hot = chosen_confounds(table, notes, c)
        columns = table[names].apply(pd.to_numeric, errors="coerce").bfill().fillna(0.0).to_numpy(float)[first:] if names else None
        hot = hot[hot >= first] - first
        spikes = np.zeros((len(x) - first, len(hot)))
        spikes[hot, np.arange(len(hot))] = 1.0
    x = x[first:]
    if len(x) < c.min_volumes:
        raise ValueError(f"{len(x)} volumes are too few")
    seen = np.isfinite(x).all(0)
    if not seen.any():
        raise ValueError("no parcel of the atlas has a voxel in the run")
    x[:, seen] = filters.clean(x[:, seen], columns, spikes, tr, c.band, c.standardize)
    return first, x


def run_series(runs: DataFrame, atlas: str, parcels: DataFrame, c: Cleaning = Cleaning()) -> DataFrame:
    """path, mask, confounds, confounds_json, tr -> path, t, x (an array over the parcels by position), error."""
    ids = np.array(sorted(r["label_id"] for r in parcels.select("label_id").collect()), np.int64)  # a row per parcel

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.astype(object).where(b.notna(), None).itertuples(index=False):
                try:
                    if r.tr is None:
                        raise ValueError("no repetition time")
                    first, x = cleaned_run(r.path, r.mask, r.confounds, r.confounds_json, float(r.tr), atlas, ids, c)
                    yield pd.DataFrame({"path": r.path, "t": np.arange(first, first + len(x)), "x": [[None if np.isnan(v) else v for v in row] for row in x.tolist()], "error": None})
                except (ValueError, OSError, KeyError, EOFError) as e:
                    yield pd.DataFrame({"path": [r.path], "t": [None], "x": [None], "error": [str(e)]})

    few = 4 * runs.sparkSession.sparkContext.defaultParallelism  # images are long work and their rows few
    return runs.select("path", "mask", "confounds", "confounds_json", "tr").repartition(few, "path").mapInPandas(work, SERIES)


def project_series(spark: SparkSession, root: str, atlas: str, labels: str | None = None, c: Cleaning = Cleaning(), tr: float | None = None, **which) -> DataFrame:
    """Series of all preprocessed runs below a folder: discovery, repetition times, atlas, extraction and cleaning."""
    found = discover.bold_runs(spark, root, **which)
    times = found.withColumn("tr", F.lit(tr)) if tr else found.join(discover.repetition_times(spark, found, root), "path", "left")
    parcels = discover.atlas_parcels(spark, atlas, texts.read_label_table(spark, labels) if labels else None)
    return run_series(times, atlas, parcels, c)


def write_project_series(series: DataFrame, target: str) -> None:
    """A TSV of volumes for each run (named as its image), and the errors as ``errors``."""
    name = F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"(_desc-preproc)?_bold\.nii(\.gz)?$", "")
    rows = series.where("error IS NULL").select(name.alias("matrix_id"), F.col("t").alias("i"), F.posexplode_outer("x").alias("j", "v"))
    texts.write_matrices(rows, os.path.join(target, "timeseries"), 6)
    series.where("error IS NOT NULL").select("path", "error").write.mode("overwrite").parquet(os.path.join(target, "errors"))


def fibre_connectivity(spark: SparkSession, fibres: str, atlas: str, fibre_affine: np.ndarray | None = None, name: str = "fibers", endpoints: bool = False) -> DataFrame:
    """i, j (parcel labels), count, volcorr, lencorr, combined from streamlines of 1-based voxels.

    Each point goes to its atlas voxel by the two affine maps (half-even rounding); a path's length is the sum of its
    steps in millimetres, 2 at least; volumes are the atlas' voxels."""
    formats.register(spark)
    _, at = formats.read_nifti(atlas)
    own = np.asarray(fibre_affine if fibre_affine is not None else at, float)
    to = np.linalg.solve(at, own)
    points = discover.mat_fibers(spark, fibres, name).select("sid", "p", *[(F.col(c) - 1).alias(c) for c in "xyz"])
    voxel = [F.rint(sum((float(to[k, m]) * F.col(c) for m, c in enumerate("xyz")), F.lit(float(to[k, 3])))).cast("int").alias(n) for k, n in enumerate("ijk")]
    labels = spark.read.format("nifti").load(atlas).where("t = 0").select("i", "j", "k", F.rint("v").cast("int").alias("roi")).where("roi > 0")
    hits = points.select("sid", "p", *voxel).join(labels, ["i", "j", "k"]).select("sid", "p", "roi")
    w = Window.partitionBy("sid").orderBy("p")  # the points of one streamline
    mm = [sum((float(own[k, m]) * F.col(c) for m, c in enumerate("xyz")), F.lit(0.0)) for k in range(3)]
    steps = points.select("sid", F.sqrt(sum((F.pow(F.lead(x).over(w) - x, F.lit(2.0)) for x in mm), F.lit(0.0))).alias("d"))
    lengths = steps.groupBy("sid").agg(F.greatest(F.coalesce(F.sum("d"), F.lit(0.0)), F.lit(2.0)).alias("length"))
    pairs = paths.endpoint_pairs(hits, lengths) if endpoints else paths.touched_pairs(hits, lengths)
    return paths.normalised(pairs, labels.groupBy("roi").agg(F.count("*").alias("n")))
