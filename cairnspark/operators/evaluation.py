"""Labels and metrics of commit rankings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.operators import ranking
from cairnspark.staging import staged

# The line by which a commit says what it reverts, and the generator of the random baseline: the factor and
# the summand that a seed starts from, those of a step, and the low bits that a score leaves out.
REVERTS = r"(?m)This reverts commit ([0-9a-f]{7,40})"
SEED_FACTOR, SEED_SUMMAND = 2862933555777941757, 3037000493
STEP_FACTOR, STEP_SUMMAND = 6364136223846793005, 1442695040888963407
LOW_BITS = 11


def hot_fixed(commits: DataFrame, window_us: int) -> DataFrame:
    """commits: sha, t, file, fix. Shas of which a later fix within the window touches a file.

    A file's commits are cut into stretches of the window's length, so a hot file is many groups. The next
    fix of a commit is the nearest later one of its stretch, else the first of the next stretch; one running
    minimum and one equi-join."""
    cut = commits.select("sha", "t", "file", "fix", F.floor(F.col("t") / F.lit(window_us)).alias("stretch"))
    later = Window.partitionBy("file", "stretch").orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, -1)
    near = cut.withColumn("next", F.min(F.when(F.col("fix"), F.col("t"))).over(later))
    first = cut.filter("fix").groupBy("file", (F.col("stretch") - 1).alias("stretch")).agg(F.min("t").alias("after"))
    both = near.join(first, ["file", "stretch"], "left")
    return both.filter(F.coalesce("next", "after") - F.col("t") <= window_us).select("sha").distinct()


def auc(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """scored: score, label (0/1). Mann-Whitney with half a point for ties; 0.5 where a class is empty.

    Aggregated per distinct score first; the negatives below each are a running sum over ranges of the order."""
    per = scored.groupBy(*by, "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    won = ranking.running(per, [F.col("score")], {"below": F.col("n")}, by).withColumn("u", F.col("p") * (F.col("below") - F.col("n") / 2))
    total = won.groupBy(*by).agg(F.sum("u").alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.select(*by, F.when((F.col("p") == 0) | (F.col("n") == 0), 0.5).otherwise(F.round(F.col("u") / F.col("p") / F.col("n"), 6)).alias("auc"))


def precision_at(scored: DataFrame, ks: list[int], tie: str, by: list[str] = ()) -> DataFrame:
    """Share of positives among the k best (of all, where there are fewer); 0 for none. Ties go by the column tie.

    Each group keeps its largest k rows by a bounded rank, which Spark applies before the shuffle too."""
    best = Window.partitionBy(*by).orderBy(F.desc("score"), tie)
    top = scored.orderBy(F.desc("score"), tie).limit(max(ks)) if not by else scored
    held = top.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= max(ks))
    return held.groupBy(*by).agg(*(F.coalesce(F.round(F.avg(F.when(F.col("r") <= k, F.col("label"))), 6), F.lit(0.0)).alias(f"p_at_{k}") for k in ks))


def first_alarm(scored: DataFrame, tie: str, by: list[str] = ()) -> DataFrame:
    """1-based rank of the best positive, n + 1 if there is none: two aggregations, no global order."""
    key = F.struct(F.col("score"), (-F.col(tie)).alias("k"))
    best = scored.groupBy(*by).agg(F.max(F.when(F.col("label") == 1, key)).alias("b"))
    joined = scored.join(F.broadcast(best)) if not by else scored.join(best, list(by))  # without groups, best is one row
    return joined.groupBy(*by).agg(F.when(F.max("b.score").isNull(), F.count(F.lit(1)) + 1).otherwise(F.count_if(key > F.col("b")) + 1).alias("ifa"))


def reverted(commits: DataFrame, bodies: DataFrame) -> DataFrame:
    """commits: sha (hex); bodies: body. Shas that a body says it reverts, in full or by a prefix of 7 or more:
    an equi-join on the first seven digits, the prefix test as its residue."""
    named = bodies.select(F.explode(F.regexp_extract_all("body", F.lit(REVERTS), F.lit(1))).alias("r")).distinct()
    keyed = named.withColumn("k", F.substring("r", 1, 7))
    mine = commits.withColumn("k", F.substring("sha", 1, 7))
    same = F.col("sha").startswith(F.col("r")) | F.col("r").startswith(F.col("sha"))
    return mine.join(keyed, (mine["k"] == keyed["k"]) & same, "left_semi").select("sha").distinct()


def unpivoted(commits: DataFrame, rankers: dict[str, Column], keep: list[str]) -> DataFrame:
    """A row for each ranker: ranker, score and the columns to keep."""
    each = F.array(*(F.struct(F.lit(n).alias("ranker"), c.cast("double").alias("score")) for n, c in rankers.items()))
    return commits.select(*keep, F.explode(each).alias("x")).select(*keep, "x.ranker", "x.score")


def ranker_matrix(commits: DataFrame, rankers: list[str]) -> DataFrame:
    """AUC of each score column of commits (label 0/1): unpivoted, then one pass for all."""
    return auc(unpivoted(commits, {n: F.col(n) for n in rankers}, ["label"]), by=["ranker"])


def metrics(scored: DataFrame, ks: list[int], tie: str, by: list[str]) -> DataFrame:
    """AUC, precision at each k and IFA of each group. tie numbers the rows: equal scores keep its order."""
    out = auc(scored, by)
    for more in (precision_at(scored, ks, tie, by), first_alarm(scored, tie, by)):
        out = out.join(more, by)
    return out


def step_scores(place: np.ndarray, seed: int) -> np.ndarray:
    """The generator's score after place + 1 steps from the seed, for all places at once: x -> a x + c, place + 1 times, by squaring
    (64-bit arithmetic that wraps)."""
    start = (seed * SEED_FACTOR + SEED_SUMMAND) % (1 << 64)
    left = place.astype(np.uint64) + np.uint64(1)
    factor, summand = np.ones(len(place), np.uint64), np.zeros(len(place), np.uint64)
    a, c = STEP_FACTOR, STEP_SUMMAND
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        factor = np.where(odd, factor * np.uint64(a), factor)
        summand = np.where(odd, summand * np.uint64(a) + np.uint64(c), summand)
        a, c = a * a % (1 << 64), (a * c + c) % (1 << 64)
        left >>= np.uint64(1)
    return ((factor * np.uint64(start) + summand) >> np.uint64(LOW_BITS)).astype(np.int64)


def random_orders(commits: DataFrame, seeds: int) -> DataFrame:
    """commits: place (from 0 on), label. A row for each seed: seed, score, place, label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for seed in range(seeds):
                yield pd.DataFrame({"seed": seed, "score": step_scores(b["place"].to_numpy(), seed), "place": b["place"], "label": b["label"]})

    return commits.select("place", "label").mapInPandas(run, "seed int, score long, place long, label int")


def random_baseline(commits: DataFrame, seeds: int, ks: list[int] = (5, 10)) -> DataFrame:
    """commits: place (from 0 on), label. Metrics of seeded random orders, averaged: auc, p_at_k, ifa, orders."""
    scored = staged(random_orders(commits, seeds), "orders")  # read by each of the metrics
    each = metrics(scored, list(ks), "place", ["seed"])
    return each.agg(*(F.round(F.avg(c), 6).alias(c) for c in ("auc", *(f"p_at_{k}" for k in ks), "ifa")), F.count(F.lit(1)).alias("orders"))


def report_counts(commits: DataFrame) -> DataFrame:
    """commits: reverted, hot_fixed (boolean). How many there are, positive, reverted and hot-fixed."""
    positive = F.col("reverted") | F.col("hot_fixed")
    return commits.agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("positives"), F.count_if("reverted").alias("reverted"), F.count_if("hot_fixed").alias("hot_fixed"))


def commit_features(affected: DataFrame, commits: DataFrame) -> DataFrame:
    """affected: sha, score, callers; commits: sha. Highest score, sum, highest fan-in and count; zeros for a commit that affects nothing."""
    per = affected.groupBy("sha").agg(F.max("score").alias("ladder"), F.sum("score").alias("ladder_sum"), F.max("callers").alias("max_fan_in"), F.count(F.lit(1)).alias("affected"))
    return commits.select("sha").join(per, "sha", "left").na.fill(0, ["ladder", "ladder_sum", "max_fan_in", "affected"])
