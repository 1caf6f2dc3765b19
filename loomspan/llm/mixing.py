"""Mixing sources to target weights (problem 7).

Every listed source shall give its weight of the total size in tokens, no document being used more than max_repeats
times. Entropy balancing: of all document rates within 0 and max_repeats, the ones nearest to the base rate 1 in the
token-weighted Kullback-Leibler sense, sum tok_i (r_i ln r_i - r_i + 1), under two constraints for each source:

* tokens: sum tok_i r_i = total * share (hard);
* length: the source's tokens stand in documents as long as those of all listed sources, in the mean of u, the
  standardised logarithm of a document's tokens (soft, with the ridge RIDGE, as a source may have no such documents).

The dual is convex with two multipliers for each source and gives exponentially tilted rates, cut off at the repeats:
r_i = min(max_repeats, exp(lambda_s + mu_s u_i)). It has no closed form. Newton steps run over the distributed table of
sizes (source, tokens of a document -> documents), one aggregation a step for all sources and several step lengths. The
rates are then rounded to copies by systematic sampling along the sizes of each source, so the rounded total stays within
about one document of the target and no order is left to chance.

Total size: named by the caller, else the largest at which every source meets its weight within its repeats. Of a named
total a source gives what its repeats allow; the report shows the gap. Sources without tokens cannot give their weight;
the weights of the others are scaled up to 1 (column target), and the report shows 0 for them.

Defined results: documents of a source that is null or not listed, and documents without tokens, get 0 copies; rows with
the same doc_id count once; weights of 0 give 0 copies; without any usable source all copies are 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.tokens import encode
from loomspan.session import cut, table

GROUP = 4096  # documents of equal size ordered in one task
TOLERANCE = 1e-9  # of a source's token constraint, relative
RIDGE = 1.0
STEPS = 60
LENGTHS = (1.0, 0.5, 0.2, 0.05, 0.0)  # of a Newton step, the best of which is taken


def sizes(documents: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens. Texts are read once and never shuffled but to spread a small file; of rows with the same
    doc_id the one with the fewest tokens counts (ties: the first source)."""
    counted = encode(documents, counts_only=True, carry=("source",))
    one = counted.groupBy("doc_id").agg(F.min(F.struct("n_tokens", "source")).alias("x"))
    return one.select("doc_id", "x.source", "x.n_tokens")


@dataclass
class Source:
    """A listed source that has tokens: what it shall give, and the multipliers found."""

    goal: float  # tokens
    most: float  # repeats
    tokens: float
    lam: float = 0.0
    mu: float = 0.0
    full: bool = False  # every document at its most repeats
    steps: int = 0


def sources_of(histogram: DataFrame, targets: DataFrame, total: float | None = None) -> tuple[dict[str, Source], float]:
    """The usable sources with their goals, and the total size; a row per listed source comes to the driver."""
    per = histogram.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("tokens"))
    rows = targets.join(per, "source").where("weight > 0 AND tokens > 0 AND max_repeats > 0").select("source", "weight", "max_repeats", "tokens").collect()
    whole = sum(r["weight"] for r in rows)
    if total is None:
        total = min((r["max_repeats"] * r["tokens"] * whole / r["weight"] for r in rows), default=0.0)
    out = {}
    for r in rows:
        goal, most = total * r["weight"] / whole, float(r["max_repeats"])
        full = goal >= most * r["tokens"] * (1 - 1e-12)
        out[r["source"]] = Source(goal, most, float(r["tokens"]), math.log(most if full else goal / r["tokens"]) if goal > 0 else -math.inf, full=full)
    return out, total


def lengths_of(histogram: DataFrame) -> tuple[float, float]:
    """Mean and deviation of ln(tokens) over the tokens of all listed sources; their u has mean 0."""
    w, x = F.col("n") * F.col("n_tokens"), F.log("n_tokens")
    r = histogram.agg(F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * x * x).alias("xx")).first()
    mean = r["x"] / r["w"]
    return mean, max(math.sqrt(max(r["xx"] / r["w"] - mean**2, 0.0)), 1e-6)


def _u(length: tuple[float, float]) -> Column:
    return (F.log("n_tokens") - length[0]) / length[1]


def balance(histogram: DataFrame, sources: dict[str, Source], length: tuple[float, float]) -> None:
    """Newton's method on each source's dual, sum tok psi(eta) - goal lam + RIDGE / 2 goal mu^2 with eta = lam + mu u and psi
    the primitive of min(most, exp): one distributed aggregation a step. Sets the multipliers."""
    spark = histogram.sparkSession
    open_ = {k: (s.lam, s.mu, 0.0, 0.0) for k, s in sources.items() if not s.full and s.goal > 0}  # with the step to take
    eta, w = F.col("lam") + F.col("mu") * _u(length), F.col("n") * F.col("n_tokens")
    for _ in range(STEPS):
        if not open_:
            return
        tried = [(k, lam + t * dl, mu + t * dm, math.log(sources[k].most)) for k, (lam, mu, dl, dm) in open_.items() for t in (LENGTHS if dl or dm else (0.0,))]
        now = F.broadcast(spark.createDataFrame(tried, "source string, lam double, mu double, top double"))  # a few rows per listed source
        r = F.exp(F.least(eta, F.col("top")))
        inner = F.when(eta < F.col("top"), w * r).otherwise(0.0)
        psi = F.when(eta < F.col("top"), r).otherwise(r * (1 + eta - F.col("top")))
        sums = histogram.join(now, "source").groupBy("source", "lam", "mu").agg(
            F.sum(w * psi).alias("psi"), F.sum(w * r).alias("m0"), F.sum(w * r * _u(length)).alias("m1"), F.sum(inner).alias("h00"), F.sum(inner * _u(length)).alias("h01"), F.sum(inner * _u(length) ** 2).alias("h11")
        ).collect()
        best: dict[str, tuple] = {}
        for x in sums:
            s = sources[x["source"]]
            value = (x["psi"] - s.goal * x["lam"] + 0.5 * RIDGE * s.goal * x["mu"] ** 2) / s.goal
            gap = abs(x["m0"] / s.goal - 1)
            key = (round(value, 13), gap)
            if x["source"] not in best or key < best[x["source"]][0]:
                best[x["source"]] = (key, x)
        for k, (_, x) in best.items():
            s = sources[k]
            s.lam, s.mu, s.steps = x["lam"], x["mu"], s.steps + 1
            g0, g1 = x["m0"] / s.goal - 1, x["m1"] / s.goal + RIDGE * s.mu
            h00, h01, h11 = x["h00"] / s.goal + 1e-12, x["h01"] / s.goal, x["h11"] / s.goal + RIDGE
            if abs(g0) <= TOLERANCE and abs(g1) <= 1e-7:
                del open_[k]
                continue
            det = h00 * h11 - h01**2
            dl, dm = (-(h11 * g0 - h01 * g1) / det, -(h00 * g1 - h01 * g0) / det) if det > 0 else (-g0, -g1 / h11)
            most = max(abs(dl), abs(dm), 3.0)
            open_[k] = (s.lam, s.mu, 3.0 * dl / most, 3.0 * dm / most)


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """doc_id, source, n_tokens, rate, copies of every document."""
    spark = documents.sparkSession
    sized = cut(sizes(documents))
    histogram = cut(sized.where("source IS NOT NULL AND n_tokens > 0").join(targets.select("source"), "source", "left_semi").groupBy("source", "n_tokens").agg(F.count("*").alias("n")))
    sources, _ = sources_of(histogram, targets, total)
    none = F.lit(0.0).alias("rate"), F.lit(0).cast("long").alias("copies")
    if not sources:
        return sized.select("doc_id", "source", "n_tokens", *none)
    length = lengths_of(histogram)
    balance(histogram, sources, length)
    found = F.broadcast(spark.createDataFrame([(k, s.lam, s.mu, s.most, s.full) for k, s in sources.items()], "source string, lam double, mu double, most double, full boolean"))  # a row per listed source
    rated = histogram.join(found, "source").select("source", "n_tokens", "n", F.when(F.col("full"), F.col("most")).otherwise(F.least(F.col("most"), F.exp(F.col("lam") + F.col("mu") * _u(length)))).alias("rate"))
    # the part of a document's rate beyond whole copies is rounded along the sizes of its source: what the sizes before its
    # own add up to, then the groups of its size before its own, then its rank in the group
    part = F.col("rate") - F.floor("rate")
    earlier = Window.partitionBy("source").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)  # a row for each size of a document
    rated = rated.withColumn("part", part).withColumn("base", F.coalesce(F.sum(F.col("n") * part).over(earlier), F.lit(0.0))).withColumn("groups", F.ceil(F.col("n") / GROUP).cast("int"))
    listed = sized.join(rated.drop("n"), ["source", "n_tokens"]).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), "groups"))
    counts = listed.groupBy("source", "n_tokens", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each GROUP documents
    ranked = listed.withColumn("rank", F.row_number().over(Window.partitionBy("source", "n_tokens", "bucket").orderBy("doc_id")) - 1)
    placed = ranked.join(counts.withColumn("before", before).drop("n"), ["source", "n_tokens", "bucket"]).withColumn("k", F.col("before") + F.col("rank"))
    extra = F.floor(F.col("base") + (F.col("k") + 1) * F.col("part") + 0.5) - F.floor(F.col("base") + F.col("k") * F.col("part") + 0.5)
    copies = placed.select("doc_id", "rate", (F.floor("rate") + extra).cast("long").alias("copies"))
    return sized.join(copies, "doc_id", "left").select("doc_id", "source", "n_tokens", F.coalesce("rate", F.lit(0.0)).alias("rate"), F.coalesce("copies", F.lit(0)).alias("copies"))


def shares(mixed: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """What each listed source was to give and gives; ``gap``: tokens short of its target share of the total named (of the
    total reached, if none is)."""
    per = mixed.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.sum(F.col("rate") * F.col("n_tokens")).alias("rated_tokens"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    r = targets.select("source", "weight", "max_repeats").join(per, "source", "left").select("source", "weight", "max_repeats", *[zero(c) for c in ("n_docs", "n_tokens", "n_copies", "most_copies", "mixed_tokens", "rated_tokens")])
    everything = Window.partitionBy(F.lit(1))  # the few listed sources
    target = F.try_divide(F.when(F.col("n_tokens") > 0, F.col("weight")), F.sum(F.when(F.col("n_tokens") > 0, F.col("weight"))).over(everything))
    r = r.withColumn("target", F.coalesce(target, F.lit(0.0))).withColumn("share", F.coalesce(F.try_divide("mixed_tokens", F.sum("mixed_tokens").over(everything)), F.lit(0.0)))
    of = F.sum("rated_tokens").over(everything) if total is None else F.lit(float(total))
    return r.withColumn("gap", F.col("target") * of - F.col("mixed_tokens"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the largest mix that meets all weights."""
    return shares(p7_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_shares_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a mix of as many tokens as the listed sources have: sources that are too small show their gap."""
    d, t = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    total = sizes(d).join(t.select("source"), "source", "left_semi").agg(F.sum("n_tokens")).first()[0] or 0
    return shares(mix(d, t, float(total)), t, float(total))


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares, "p7_shares_named": p7_shares_named}
SQL: dict[str, str] = {}
