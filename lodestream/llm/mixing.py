"""Mixing sources to target shares of all tokens.

The size of the mix is the largest at which every source that has documents reaches its share (shares of
sources without any are spread over the others in proportion), unless a size is given; with a larger one,
sources that run short are taken whole at their cap and the rest is shared out among the others.

A source that needs r times its tokens gives every document floor(r) certain copies; the rest is an
unequal-probability sample by Pareto order sampling. A document's inclusion probability is proportional to its
weight (by default its tokens), the factor being such that the expected tokens are those still missing; where
that exceeds 1 the document is taken for certain. The others rank by their random odds divided by their
inclusion odds and are taken in that order until the sample has its size. The size is fixed in tokens, as shares are:
a fixed number of documents would leave every share to chance. The random number of a document is a hash of
its id, so a retried task draws the same.

Neither the factor nor the cut needs a source sorted in one task: weights are summed in a fixed number of bins for
each power of two, and ranks fall into a fixed number of bins, whose token sums locate the one where the size is
reached; only that bin's documents are put in order.

Defined results: documents without source, with a null, empty or blank text stay out, as do sources that
aren't targets; a target without documents is reported with a share of zero; repeated rows are documents of
their own; ties in rank go by id; no documents give an empty mix; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.tokenize import count_tokens
from lodestream.session import materialize

BINS = 1 << 16
PER_OCTAVE = 16
#: Targets are a small table by definition; more than this is refused rather than collected.
MOST_TARGETS = 10_000


def sized(df: DataFrame, row_id: str, source: str, text: str, path: str | None = None) -> DataFrame:
    """(row_id, source, n_tokens) of the documents that may stand in a mix; encoded once, then kept."""
    eligible = df.where(F.col(source).isNotNull() & F.col(text).rlike(r"[^\s\p{Z}\x{85}\x{200B}\x{FEFF}]"))
    return materialize(count_tokens(eligible, [F.col(row_id).alias("row_id"), F.col(source).alias("source")], F.col(text), path), "sized")


def allocate(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, float]:
    """How many times each source's tokens stand in the mix, at most its cap."""
    have = {s: n for s, n in tokens.items() if n > 0 and s in targets and targets[s][0] > 0 and targets[s][1] > 0}
    weight = sum(targets[s][0] for s in have)
    if not have:
        return {}
    share = {s: targets[s][0] / weight for s in have}
    cap = {s: n * targets[s][1] for s, n in have.items()}
    size = min(cap[s] / share[s] for s in have)
    if total is None or total <= size:
        return {s: min(total or size, size) * share[s] / have[s] for s in have}
    given, left, open_ = {}, float(total), set(have)
    while open_:
        of = sum(share[s] for s in open_)
        short = {s for s in open_ if cap[s] <= left * share[s] / of}
        if not short:
            given |= {s: left * share[s] / of for s in open_}
            break
        given |= {s: float(cap[s]) for s in short}
        left -= sum(cap[s] for s in short)
        open_ -= short
    return {s: given[s] / have[s] for s in have}


def factor(bins: list[tuple[float, float, float]], missing: float) -> float:
    """The c with sum(min(1, c * weight) * tokens) = missing, from (largest weight, tokens, weight * tokens) of bins of similar weights."""
    left, sure = sum(wx for _, _, wx in bins), 0.0
    bins = sorted(bins, reverse=True)
    for w, x, wx in bins:
        c = (missing - sure) / left if left > 0 else 0.0
        if c * w <= 1:
            return c
        sure, left = sure + x, left - wx
    return float("inf")


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42, weight: Column | None = None, bins: int = BINS) -> DataFrame:
    """(row_id, source, n_tokens, copies) of the documents of the mix, from ``sized`` documents.

    Inclusion probabilities within a source are proportional to ``weight``, a positive number; ``n_tokens`` by default.
    """
    spark = documents.sparkSession
    wanted = targets.select("source", "target_share", "max_repeats").limit(MOST_TARGETS + 1).collect()
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    goal = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in wanted if r.source is not None}
    listed = F.broadcast(spark.createDataFrame([(s,) for s in goal], "source string"))
    documents = documents.join(listed, "source", "left_semi").where("n_tokens > 0").withColumn("weight", (F.col("n_tokens") if weight is None else weight).cast("double"))
    # At most PER_OCTAVE rows for each target and power of two of the weight.
    octave = F.floor(F.log2("weight") * PER_OCTAVE)
    weights = documents.groupBy("source", octave.alias("octave")).agg(F.max("weight").alias("w"), F.sum("n_tokens").alias("x"), F.sum(F.col("weight") * F.col("n_tokens")).alias("wx")).collect()
    held: dict[str, int] = {}
    for r in weights:
        held[r.source] = held.get(r.source, 0) + r.x
    plan = []
    for s, r in allocate(held, goal, total).items():
        whole = math.floor(r + 1e-12)
        missing = max(0.0, min(r - whole, 1.0)) * held[s]
        plan.append((s, whole, missing, factor([(w.w, w.x, w.wx) for w in weights if w.source == s], missing)))
    plan_df = F.broadcast(spark.createDataFrame(plan, "source string, whole int, missing double, factor double"))

    u = (F.xxhash64(F.lit(seed), "row_id").bitwiseAND(F.lit(2**52 - 1)) + F.lit(0.5)) / F.lit(float(2**52))
    odds = F.greatest(F.col("p"), F.lit(1e-300)) / (1 - F.col("p"))
    # Documents taken for certain stand in a bin of their own, before all others.
    bin_of = F.when(F.col("p") >= 1, -1).otherwise(F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * bins), F.lit(bins - 1))).cast("int")
    ranked = documents.join(plan_df, "source").withColumn("p", F.least(F.col("weight") * F.col("factor"), F.lit(1.0)))
    ranked = ranked.withColumn("rank", F.when(F.col("p") < 1, u / (1 - u) / odds).otherwise(0.0)).withColumn("bin", bin_of)
    # At most bins rows for each target: small enough for one sorted window each.
    upto = Window.partitionBy("source").orderBy("bin")
    sums = ranked.where("missing > 0").groupBy("source", "bin", "missing").agg(F.sum("n_tokens").alias("n"))
    cut = sums.withColumn("before", F.sum("n").over(upto) - F.col("n")).where("before < missing and before + n >= missing")
    cut = materialize(cut.select("source", F.col("bin").alias("cut_bin"), "before"), "cuts")  # one row for each target
    at = ranked.join(F.broadcast(cut), "source", "left")
    inside = at.where("bin = cut_bin").withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source").orderBy("rank", "row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # The document that crosses the sum is taken if that comes nearer to it.
    nearer = F.col("upto") - F.col("n_tokens") / 2 <= F.col("missing")
    taken = inside.select("row_id", "source", "n_tokens", (F.col("whole") + nearer.cast("int")).alias("copies"))
    sure = at.where("cut_bin is null or bin <> cut_bin").select("row_id", "source", "n_tokens", (F.col("whole") + F.when(F.col("bin") < F.col("cut_bin"), 1).otherwise(0)).alias("copies"))
    return sure.unionByName(taken).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target its documents, copies and tokens in the mix, and its actual share of all tokens."""
    of = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most_copies"))
    all_ = F.sum("tokens").over(Window.partitionBy())  # one row for each target
    full = targets.join(of, "source", "left").na.fill(0, ["documents", "copies", "tokens", "most_copies"])
    return full.select("source", "target_share", "max_repeats", "documents", "copies", "tokens", "most_copies", F.coalesce(F.try_divide("tokens", all_), F.lit(0.0)).alias("actual_share"))
