"""Results as folders: matrices of a fit, weights of a structure, summaries and the data set's description."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.sources.texts import json_text, write_matrices

WEIGHTS = ("count", "volcorr", "lencorr", "combined")


def write_fit(fit: DataFrame, target: str) -> None:
    """participant, run, method, i, j, ec and metrics -> Parquet by method, and a TSV for each matrix."""
    fit.write.mode("overwrite").partitionBy("method").parquet(os.path.join(target, "fits"))
    done = fit.where("error IS NULL")
    write_matrices(done.select(F.concat_ws("_", "method", F.col("participant").cast("string"), F.col("run").cast("string")).alias("matrix_id"), "i", "j", F.col("ec").alias("v")), os.path.join(target, "matrices"))


def by_weight(structure: DataFrame) -> DataFrame:
    """i, j and the four weights -> weight, i, j, v."""
    return structure.unpivot(["i", "j"], [F.col(w).cast("double").alias(w) for w in WEIGHTS], "weight", "v").select("weight", "i", "j", "v")


def write_structure(structure: DataFrame, target: str) -> None:
    by_weight(structure).write.mode("overwrite").partitionBy("weight").parquet(target)


def write_description(folder: str, name: str = "loomspan") -> str:
    """``dataset_description.json``, unless there is one."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "dataset_description.json")
    if not os.path.exists(path):
        with open(path, "w") as f:
            json.dump({"Name": f"{name} derivatives", "BIDSVersion": "1.9.0", "DatasetType": "derivative", "GeneratedBy": [{"Name": name}]}, f, indent=2)
    return path


def write_summary(path: str, summary: dict) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        f.write(json_text(summary))
