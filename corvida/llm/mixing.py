"""Mixing sources to target weights (problem 8).

Efraimidis-Spirakis sampling without replacement: each document draws an exponential key whose rate is its
quality weight; sorted by key, the documents of a source come in the order of a weighted draw. A source's token
budget is met by complete epochs over all its documents first and then by the prefix of that order which fits.

The prefix sum is distributed: keys fall into ``BUCKETS`` ordered buckets per (mix, source) whose borders are quantiles
of that pair's own keys, bucket totals are summed first, and only the one bucket in which the budget runs out, a
small share of the source however the weights lie, is sorted row by row.

Quality is fitted to the corpus without labels: a document is worth the more the less its characters a token, its share
of letters and its share of different lines lie from what is usual in its source, so code, tables and lists count as
good where they are usual, and garbled or repetitive text counts little anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def letter_share(text: Column) -> Column:
    """Share of letters among the characters of a text."""
    return F.char_length(F.regexp_replace(text, r"[^\p{L}\p{M}]", "")) / F.greatest(F.char_length(text), F.lit(1))


def line_share(text: Column) -> Column:
    """Share of different lines among the printed lines of a text."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda s: s != "")
    return F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))


FEATURES = ["density", "letters", "lines"]


def with_quality(sizes: DataFrame) -> DataFrame:
    """Adds weight in (0, 1] to sizes (doc_id, source, n_tokens, chars, letters, lines): exp of minus half the mean distance
    of the features from their source's median, in its interquartile ranges, each 4 at most.

    Medians and ranges are sketches over all documents of a source, one row a source.
    """
    x = sizes.withColumn("density", F.col("chars") / F.greatest("n_tokens", F.lit(1)))
    usual = x.groupBy("source").agg(*[F.percentile_approx(f, [0.25, 0.5, 0.75], 2000).alias(f"q_{f}") for f in FEATURES])
    z = [F.least(F.lit(4.0), F.abs(F.col(f) - F.col(f"q_{f}")[1]) / F.greatest(F.col(f"q_{f}")[2] - F.col(f"q_{f}")[0], F.abs(F.col(f"q_{f}")[1]) * 0.05 + 1e-6)) for f in FEATURES]
    return x.join(F.broadcast(usual), "source").withColumn("weight", F.exp(-0.5 * sum(z, F.lit(0.0)) / len(z))).drop("density", *[f"q_{f}" for f in FEATURES])  # usual: one row a source


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per (mix, source) target with the source's size, the token budget, whole epochs and the rest.

    Without ``total_tokens`` a mix is as large as its targets allow: the largest total at which every source
    that has documents reaches its share within its repeats. With it, a source out of reach is used to its cap, its
    target stays unreached, and nothing else shrinks for it.
    """
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    wanted = targets.where("mix_name is not null and source is not null and target_share > 0").groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
    t = wanted.join(have, "source", "left").fillna(0, ["tokens", "docs"]).withColumn("cap", F.col("tokens") * F.col("max_repeats"))
    if total_tokens is None:
        t = t.withColumn("mix_tokens", F.min(F.when(F.col("cap") > 0, F.col("cap") / F.col("target_share"))).over(Window.partitionBy("mix_name")))
    else:
        t = t.withColumn("mix_tokens", F.lit(float(total_tokens)))
    t = t.withColumn("budget", F.least(F.col("cap"), F.floor(F.coalesce("mix_tokens", F.lit(0.0)) * F.col("target_share") + 1e-6)))
    return t.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))


def draw(sizes: DataFrame, plan: DataFrame, seed: int = 20240607) -> DataFrame:
    """mix_name, source, doc_id, uses, n_tokens of the documents in each mix.

    sizes: doc_id, source, n_tokens, weight; a doc_id counts once. Defined cases: documents without tokens or
    source are never used; a weight that is null or not positive counts as the smallest weight; equal keys go
    by doc_id; the document that crosses the budget is taken if that brings the source nearer to it.
    """
    p = plan.select("mix_name", "source", "epochs", "rest", "max_repeats")
    u = (F.xxhash64("mix_name", "doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
    group = ["mix_name", "source"]
    drawn = sizes.join(F.broadcast(p), "source").withColumn("key", -F.log(u) / F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(1e-6)))  # p: one row a target
    borders = drawn.where("rest > 0").groupBy(*group).agg(F.percentile_approx("key", [i / BUCKETS for i in range(1, BUCKETS)], 10 * BUCKETS).alias("borders"))
    bucket = F.coalesce(F.aggregate("borders", F.lit(0), lambda n, b: n + (b < F.col("key")).cast("int")), F.lit(0))
    keyed = drawn.join(F.broadcast(borders), group, "left").withColumn("bucket", bucket).drop("borders")  # borders: one row a target
    w = Window.partitionBy(*group).orderBy("bucket")
    filled = (
        keyed.where("rest > 0")
        .groupBy(*group, "bucket")
        .agg(F.sum("n_tokens").alias("in_bucket"), F.first("rest").alias("rest"))
        .withColumn("upto", F.sum("in_bucket").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("left", F.col("rest") - (F.col("upto") - F.col("in_bucket")))
        .where("left > 0")
        .select(*group, "bucket", "left", (F.col("upto") <= F.col("rest")).alias("whole"))
    )
    j = keyed.join(filled, [*group, "bucket"], "left")
    sure = j.where("whole or whole is null").withColumn("extra", F.coalesce("whole", F.lit(False)).cast("int"))
    order = Window.partitionBy(*group, "bucket").orderBy("key", "doc_id")
    upto = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = (
        j.where("not whole")
        .withColumn("upto", upto)
        .withColumn("extra", ((F.col("upto") <= F.col("left")) | (F.col("upto") - F.col("left") < F.col("left") - (F.col("upto") - F.col("n_tokens")))).cast("int"))
        .drop("upto")
    )
    return sure.unionByName(last).withColumn("uses", F.least(F.col("epochs") + F.col("extra"), F.col("max_repeats"))).where("uses > 0").select(*group, "doc_id", "uses", "n_tokens")


def shares(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """Per mix and source: target and actual share of the tokens, repeats used, and whether the target was reached."""
    used = drawn.groupBy("mix_name", "source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("used_tokens"), F.count("*").alias("used_docs"), F.max("uses").alias("most_uses"))
    t = plan.select("mix_name", "source", "target_share", "max_repeats", "budget").join(used, ["mix_name", "source"], "left").fillna(0, ["used_tokens", "used_docs", "most_uses"])
    total = F.sum("used_tokens").over(Window.partitionBy("mix_name"))
    share = F.coalesce(F.col("used_tokens") / F.when(total > 0, total), F.lit(0.0))
    return t.select("mix_name", "source", "target_share", F.round(share, 6).alias("actual_share"), "budget", "used_tokens", "used_docs", "most_uses", "max_repeats", (F.abs(share - F.col("target_share")) <= 0.01).alias("reached"))
