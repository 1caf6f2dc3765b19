"""Implausible spikes in measurements (problem 2).

The readings of a source are packed into arrays (a pre-aggregated shuffle by source), and a batch of sources at a time is
scored by isolation forests, one grown for each source and field on its own readings: level, difference, seasonal and
run-length features. A spike is a reading that the forest isolates sooner than the source's probe, a made-up reading
PROBE scatters off that falls through the same trees, so the threshold is learned from each source. An exact check
follows: a spike stands in a stretch of at most LONGEST readings on one side, each MEMBER scatters from the level, and
the stretch is flagged as a whole. Stuck values come from the run-length feature, readings beyond physical limits from
explicit rules.

A source is cut into blocks of BLOCK volumes with a rim of RIM volumes on either side, so that one source, however long,
is no single task; a block has its own forest.

Defined results: nulls and NaN are no readings and end a run; infinite readings are impossible; repeated rows count once;
of different values delivered for one volume the least is taken into the forest, while the limits are held against each;
an impossible reading scores 1 and stays out of the forest; a source of one reading scores 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.kernels import isolation as K
from loomspan.session import table

BLOCK, RIM = 512, 32
STUCK = 6  # volumes that keep a value
LONGEST = 3  # volumes of an excursion
MEMBER = 6.0  # scatters of each reading of an excursion
PROBE = (7.7, 7.0, 6.0)  # level, difference and seasonal residual of the probe, in scatters
AT_END = 0.6  # what a deviation counts at an end of the source, where the level cannot be seen to return
TREES = 64
SOURCES_AT_ONCE = 1024


@dataclass(frozen=True)
class Field:
    """A measured field: its name in the result, one unit of its last digit, its physical limits (exclusive below)."""

    name: str
    unit: float
    above: float | None = None
    within: float | None = None

    def impossible(self, x: np.ndarray) -> np.ndarray:
        bad = ~np.isfinite(x)
        if self.above is not None:
            bad |= x <= self.above
        return bad | (np.abs(x) > self.within) if self.within is not None else bad

    def rule(self, c: Column) -> Column:
        bad = c.isin(float("inf"), float("-inf"))
        if self.above is not None:
            bad = bad | (c <= self.above)
        if self.within is not None:
            bad = bad | (F.abs(c) > self.within)
        return c.isNotNull() & ~F.isnan(c) & bad


CONFOUNDS = (Field("trans_x", 1e-5, within=50.0), Field("global_signal", 1e-3, above=0.0))
PANEL = tuple(Field(f"x[{k}]", 1e-2, above=0.0) for k in range(4))


def features(z: np.ndarray, usable: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Level, difference, seasonal and run-length features; the readings of short stretches far from the level, and those
    stretches (row, first, end in the usable readings)."""
    packed, m = K.pack_left(z, usable)
    found = K.stretches(packed, MEMBER, LONGEST)
    gap = np.where(np.arange(1, z.shape[1])[None, :] < m[:, None], np.abs(np.diff(packed, axis=1)), 0.0)
    step = np.maximum(np.pad(gap, ((0, 0), (1, 0))), np.pad(gap, ((0, 0), (0, 1))))
    at_end = (found[1] == 0) | (found[2] == m[found[0]])
    less = np.where(K.within(z.shape, *(c[at_end] for c in found)), AT_END, 1.0)
    three = [K.unpack(less * f, usable) for f in (np.abs(packed), step, K.seasonal_residual(packed, m))]
    return np.stack([np.where(usable, three[0], np.abs(z)), three[1], three[2], np.log(run)]), K.unpack(K.within(z.shape, *found), usable), found


def judge(x: np.ndarray, t: np.ndarray, n: np.ndarray, field: Field, everything: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, excursions and stuck readings of padded sources. Unless ``everything`` is asked for, nodes without a reading
    of a short stretch or the probe are not grown on, as their readings cannot be spikes."""
    valid = np.arange(x.shape[1])[None, :] < n[:, None]
    run = K.run_lengths(x, t, n, field.unit)
    stuck = valid & (run >= STUCK)
    bad = valid & field.impossible(x)
    usable = valid & ~bad & ~stuck
    z = K.deviations(np.where(np.isfinite(x), x, 0.0), n, usable, field.unit)
    f, candidate, (row, start, end) = features(z, usable, run)
    probe = np.repeat(np.array([*PROBE, 0.0])[:, None], len(n), axis=1)
    path, threshold, expected = K.isolation_paths(f, valid & ~bad, probe, None if everything else candidate, TREES)
    sooner, _ = K.pack_left(path < threshold[:, None], usable)
    before = np.pad(np.cumsum(sooner, axis=1), ((0, 0), (1, 0)))
    spike = before[row, end] > before[row, start]
    spikes = K.unpack(K.within(z.shape, row[spike], start[spike], end[spike]), usable)
    return np.where(bad, 1.0, K.isolation_score(path, expected[:, None])), spikes, stuck


def _padded(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, volumes and numbers of readings of one field, missing readings left out, one row per source."""
    ts, vs = batch.column("t"), batch.column(name)
    size = np.diff(np.asarray(ts.offsets))
    row = np.repeat(np.arange(len(size)), size)
    t = np.asarray(ts.flatten())
    v = vs.flatten().to_numpy(zero_copy_only=False).astype(float)
    keep = ~np.isnan(v)
    keep[1:] &= ~((row[1:] == row[:-1]) & (t[1:] == t[:-1]) & keep[:-1])  # sorted: of several values the least stays
    row, t, v = row[keep], t[keep], v[keep]
    n = np.bincount(row, minlength=len(size))
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    x = np.zeros((len(size), max(1, n.max(initial=0))))
    tt = np.zeros(x.shape, np.int64)
    x[row, at], tt[row, at] = v, t
    return x, tt, n


def scored(packed: DataFrame, fields: tuple[Field, ...], everything: bool) -> DataFrame:
    """src, t, field, score, spike, stuck of every reading (or only of those flagged)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            order = np.argsort(np.diff(np.asarray(whole.column("t").offsets)), kind="stable")  # sources of like length together: little padding
            for start in range(0, len(order), SOURCES_AT_ONCE):
                batch = whole.take(pa.array(order[start : start + SOURCES_AT_ONCE]))
                block = np.asarray(batch.column("block"))
                for k, f in enumerate(fields):
                    x, t, n = _padded(batch, f"v{k}")
                    score, spike, stuck = judge(x, t, n, f, everything)
                    own = (np.arange(x.shape[1])[None, :] < n[:, None]) & (np.floor_divide(t, BLOCK) == block[:, None])
                    i, j = np.nonzero(own if everything else own & (spike | stuck))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("src").take(pa.array(i)), pa.array(t[i, j].astype(np.int32)), pa.array([f.name] * len(i), pa.string()), pa.array(score[i, j]), pa.array(spike[i, j]), pa.array(stuck[i, j])],
                        names=["src", "t", "field", "score", "spike", "stuck"],
                    )

    return packed.mapInArrow(work, "src string, t int, field string, score double, spike boolean, stuck boolean")


def packed_sources(readings: DataFrame, k: int) -> DataFrame:
    """src, t, v0..vk-1 -> a row per source and block of volumes with sorted arrays. Equal rows fold into one already on
    the map side."""
    t = F.col("t")
    before = F.when((t >= 0) & (t < RIM), F.lit(0)).otherwise(F.floor((t - RIM) / BLOCK))  # nothing stands before volume 0
    blocks = F.array_distinct(F.array(before, F.floor(t / BLOCK), F.floor((t + RIM) / BLOCK)))
    vs = [f"v{i}" for i in range(k)]
    rows = readings.where(F.col("src").isNotNull() & t.isNotNull()).select("src", F.explode(blocks.cast("array<int>")).alias("block"), "t", *vs)
    g = rows.groupBy("src", "block").agg(F.array_sort(F.collect_set(F.struct("t", *vs))).alias("r"))
    return g.select("src", "block", *[F.col(f"r.{c}").alias(c) for c in ("t", *vs)])


def _confounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    steady = F.coalesce(F.col("non_steady_state_outlier"), F.lit(0)) != 1
    return table(spark, sf_dir, "confound_volumes").select(F.col("tag").alias("src"), "t", F.col("trans_x").alias("v0"), F.when(steady, F.col("global_signal")).alias("v1"))


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ts_panel").select(F.col("path").alias("src"), "t", *[F.get("x", F.lit(k)).alias(f"v{k}") for k in range(4)])


def beyond_limits(readings: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    bad = F.array_compact(F.array(*[F.when(f.rule(F.col(f"v{k}")), F.lit(f.name)) for k, f in enumerate(fields)]))
    return readings.where(F.col("src").isNotNull() & F.col("t").isNotNull()).select("src", "t", F.explode(bad).alias("field")).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for readings, fields in ((_confounds(spark, sf_dir), CONFOUNDS), (_panel(spark, sf_dir), PANEL)):
        parts += [scored(packed_sources(readings, len(fields)), fields, False).select("src", "t", "field"), beyond_limits(readings, fields).select("src", F.col("t").cast("int"), "field")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).distinct()


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest's score of every reading."""
    a = scored(packed_sources(_confounds(spark, sf_dir), 2), CONFOUNDS, True)
    return a.union(scored(packed_sources(_panel(spark, sf_dir), 4), PANEL, True))


QUERIES = {"p2_found": p2_found, "p2_scores": p2_scores}
SQL: dict[str, str] = {}
