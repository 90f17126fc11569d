"""Cost ledger, tasks, retention and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICRO = 1_000_000


def month_total(charges: DataFrame, reservations: DataFrame, by: list[str] | None = None, scope: str | None = None, adapter: str | None = None) -> DataFrame:
    """month, spent: settled charges of each month plus all open reservations, in whole cents.

    charges: month, scope_id, adapter_kind, cents; reservations: scope_id, adapter_kind, cents of requests not yet
    ended. A filter that is None does not apply; ``by`` splits the total by further columns.
    """
    keep = lambda rows: rows.where((F.lit(scope is None) | (F.col("scope_id") == F.lit(scope))) & (F.lit(adapter is None) | (F.col("adapter_kind") == F.lit(adapter))))
    by = by or []
    spent = keep(charges).groupBy("month", *by).agg(F.sum("cents").alias("settled"))
    held = keep(reservations).groupBy(*by).agg(F.sum("cents").alias("open"))
    if by:
        months = keep(charges).select("month").distinct()
        every = months.crossJoin(F.broadcast(keep(charges).select(*by).union(keep(reservations).select(*by)).distinct()))  # months and scopes of a ledger, not its rows
        spent, held = every.join(spent, ["month", *by], "left"), held
        joined = spent.join(held, by, "left")
    else:
        joined = spent.crossJoin(held)  # one row
    return joined.select("month", *by, (F.coalesce("settled", F.lit(0)) + F.coalesce("open", F.lit(0))).alias("spent"))


def cap_check(candidates: DataFrame, totals: DataFrame, caps: dict[str, int | None]) -> DataFrame:
    """What becomes of each candidate charge: exempt (costs nothing), the first layer that denies it, or allowed.

    candidates: id, month, scope_id, adapter_kind, cents; totals: month, layer (device, folder, per_adapter), key,
    spent. A layer denies when its month's total and the candidate reach the cap together; a cap of None does not apply.
    """
    out = candidates
    for layer, key in (("device", F.lit("")), ("folder", F.col("scope_id")), ("per_adapter", F.col("adapter_kind"))):
        t = totals.where(F.col("layer") == layer).select("month", F.col("key").alias("k_"), F.col("spent").alias(layer))
        out = out.withColumn("k_", key).join(t, ["month", "k_"], "left").drop("k_").fillna(0, [layer])
    verdict = F.when(F.col("cents") == 0, "exempt")
    for layer in ("device", "folder", "per_adapter"):
        if caps.get(layer) is not None:
            verdict = verdict.when(F.col(layer) + F.col("cents") >= caps[layer], "denied_" + layer)
    return out.withColumn("verdict", verdict.otherwise("allowed"))


def latest_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; a partial aggregate, so a hot key costs one row a task."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r_")).select(key, "r_.*")


def retention(commits: DataFrame, tips: DataFrame, now: Column, branch: str = "scope_id", hours: int = 24, days: int = 7, weeks: int = 4, months: int = 6, derived: int = 5) -> DataFrame:
    """commit_hash, kept: whose tree retention keeps.

    Commits of type auto: all of the last ``hours``, the last of each hour for ``days``, of each day for ``weeks``, of
    each week for ``months`` (of 30 days), none beyond. Migrated and repaired ones: the newest ``derived`` of each
    type and branch. Other types and the commits that refs point to (tips) are always kept.
    """
    age = F.unix_seconds(now) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    hour, day, week = 3600, 86400, 7 * 86400
    level = F.when(age < hours * hour, 0).when(age < days * day, 1).when(age < weeks * week, 2).when(age < months * 30 * day, 3).otherwise(4)
    bucket = F.when(F.col("level") == 1, F.date_trunc("hour", "created_at")).when(F.col("level") == 2, F.date_trunc("day", "created_at")).when(F.col("level") == 3, F.date_trunc("week", "created_at"))
    last = F.row_number().over(Window.partitionBy(branch, "commit_type", "level", "bucket").orderBy(F.desc("created_at"), F.desc("commit_hash")))
    nth = F.row_number().over(Window.partitionBy(branch, "commit_type").orderBy(F.desc("created_at"), F.desc("commit_hash")))
    c = commits.withColumn("level", level).withColumn("bucket", bucket).withColumn("last", last).withColumn("nth", nth)
    c = c.join(tips.select("commit_hash").distinct().withColumn("tip", F.lit(True)), "commit_hash", "left")
    auto = (F.col("level") == 0) | ((F.col("level") < 4) & (F.col("last") == 1))
    kept = F.when(F.coalesce("tip", F.lit(False)), True).when(F.col("commit_type") == "auto", auto).when(F.col("commit_type").isin("migrated", "repaired"), F.col("nth") <= derived).otherwise(True)
    return c.select("commit_hash", kept.alias("kept"))


def nearest_rank(rows: DataFrame, group: list[str], value: str, percents: list[int], parts: int = 256) -> DataFrame:
    """Percentiles by nearest rank: the ceil(p * n)-th value, smallest and greatest.

    Two passes: values are counted in ``parts`` ranges of each group with partial sums, then only the ranges that hold a
    wanted rank are sorted, so a group that holds most rows is no single task. Null values take no part.
    """
    r = rows.where(F.col(value).isNotNull())
    ends = r.groupBy(*group).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("n"))
    width = (F.col("most") - F.col("least")) / parts
    placed = r.join(ends, group).withColumn("part", F.when(width > 0, F.least(F.floor((F.col(value) - F.col("least")) / width), F.lit(parts - 1))).otherwise(0).cast("int"))
    counts = placed.groupBy(*group, "part").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    w = Window.partitionBy(*group).orderBy("part")
    before = F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = F.array(*[F.ceil(F.col("n") * F.lit(p) / 100) for p in percents])
    held = counts.withColumn("before", before).withColumn("ranks", F.filter(wanted, lambda k: (k > F.col("before")) & (k <= F.col("before") + F.col("c")))).where(F.size("ranks") > 0)
    inside = placed.select(*group, "part", value).join(held.select(*group, "part", "before", "n"), [*group, "part"])
    ranked = inside.withColumn("rn", F.col("before") + F.row_number().over(Window.partitionBy(*group, "part").orderBy(value)))
    picks = ranked.groupBy(*group).agg(*[F.max(F.when(F.col("rn") == F.ceil(F.col("n") * F.lit(p) / 100), F.col(value))).alias(f"p{p}") for p in percents])
    return picks.join(ends.drop("n"), group)


def recall_at_k(got: DataFrame, expected: DataFrame, key: str, k: int) -> DataFrame:
    """Share of the distinct expected keys of each query that stand in its first k rows."""
    e = expected.select("query_id", key).distinct()
    hit = e.join(got.where(F.col("rank") <= k).select("query_id", key).distinct().withColumn("hit", F.lit(1)), ["query_id", key], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def worst_expected_rank(got: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Smallest prefix of each query's list that holds all expected keys; null where one is missing."""
    e = expected.select("query_id", key).distinct().join(got.groupBy("query_id", key).agg(F.min("rank").alias("rank")), ["query_id", key], "left")
    return e.groupBy("query_id").agg(F.when(F.count("rank") == F.count("*"), F.max("rank")).alias("worst"))


def task_state(done: Column, failed: Column, precondition_failed: Column) -> Column:
    """State of a task from its units: failed, partial, done or (nothing yet done or failed) pending."""
    return F.when(precondition_failed | ((done == 0) & (failed > 0)), "failed").when((done > 0) & (failed > 0), "partial").when(done > 0, "done").otherwise("pending")


# Retry class of each kind of failure: whether it is retried, most attempts (None: no limit), back-off, whether it pauses.
RETRY = {
    "network_error": (True, 5, "exp(base=2s,cap=60s,full_jitter)", False),
    "rate_limit": (True, None, "retry_after", False),
    "auth_error": (False, 0, "user_action", True),
    "quota_exceeded": (True, 3, "fixed(1h)", False),
    "invalid_input": (False, 0, "none", False),
    "contract_violation": (True, 1, "immediate", False),
    "budget_exceeded": (False, 0, "override_budget_required", True),
}


def retries(tasks: DataFrame) -> DataFrame:
    """Adds kind, backoff, paused, retry (allowed once more) to tasks (status, reason, attempts); unknown reasons count
    as contract violations."""
    spark = tasks.sparkSession
    table = spark.createDataFrame([(k, r, m, b, p) for k, (r, m, b, p) in RETRY.items()], "kind string, retryable boolean, most int, backoff string, paused boolean")
    kind = F.when(F.col("reason").isin([k for k in RETRY if k != "contract_violation"]), F.col("reason")).otherwise("contract_violation")
    retry = F.col("retryable") & (F.col("most").isNull() | (F.col("attempts") < F.col("most")))
    return tasks.withColumn("kind", kind).join(F.broadcast(table), "kind").withColumn("retry", retry).withColumn("terminal", (F.col("status") == "failed") & ~retry).drop("retryable", "most")


# Steps a task may take; chosen here, as the archive records states and does not check their order.
STEPS = [("pending", "running"), ("pending", "paused"), ("running", "done"), ("running", "partial"), ("running", "failed"), ("running", "paused"), ("paused", "pending"), ("failed", "pending"), ("partial", "pending")]


def task_machine(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """The last state of each task and how many of its steps the machine does not allow; a first state must be pending."""
    before = F.coalesce(F.lag(state).over(Window.partitionBy(key).orderBy(*order)), F.lit("none"))
    allowed = (F.col("before") == F.col(state)) | ((F.col("before") == "none") & (F.col(state) == "pending"))
    for a, b in STEPS:
        allowed = allowed | ((F.col("before") == a) & (F.col(state) == b))
    return events.withColumn("before", before).groupBy(key).agg(F.max_by(state, F.struct(*order)).alias("state"), F.count_if(~allowed).alias("violations"), F.count("*").alias("events"))


def stale_reservations(rows: DataFrame, now: Column, scope: str | None = None) -> DataFrame:
    """Synchronous requests still open whose time is up (or was never set); their owner must settle or release them."""
    due = (F.col("request_kind") == "sync") & F.col("state").isin(0, 1) & (F.col("stale_after_at").isNull() | (F.col("stale_after_at") <= now))
    return rows.where(due if scope is None else due & (F.col("scope_id") == scope))


def recovery_candidates(rows: DataFrame) -> DataFrame:
    """Batch requests a restart must look at: still open, or ended with an intent token left."""
    return rows.where((F.col("request_kind") == "batch") & (F.col("state").isin(0, 1) | (F.col("state").isin(2, 3) & F.col("intent_token").isNotNull())))


def poll_candidates(rows: DataFrame) -> DataFrame:
    """Batch requests still open whose provider job is known."""
    return rows.where((F.col("request_kind") == "batch") & F.col("state").isin(0, 1) & F.col("batch_job_id").isNotNull())


def sweep_capacity(prune: int, general: int, total: int, least_prune: int) -> tuple[int, int]:
    """(prunes, others) of one bounded sweep: some capacity is kept for pruning, and what one side leaves the other may use."""
    kept = min(least_prune, prune)
    others = min(general, total - kept)
    prunes = min(prune, total - others)
    return prunes, others


def sweep(rows: DataFrame, own: Column, prune: Column, order: str, total: int, least_prune: int, own_limit: int) -> DataFrame:
    """pool, order column: a sweep's rows: those of the own key first, then general and prunable ones within the capacity."""
    others = rows.where(~own)
    n = others.agg(F.count_if(prune).alias("p"), F.count_if(~prune).alias("g")).first()
    prunes, general = sweep_capacity(n.p, n.g, total, least_prune)
    take = lambda part, name, k: part.orderBy(order).limit(k).select(F.lit(name).alias("pool"), order)
    return take(rows.where(own), "own", own_limit).unionByName(take(others.where(~prune), "general", general)).unionByName(take(others.where(prune), "prune", prunes))


def submit_once(requests: DataFrame, settled: DataFrame) -> DataFrame:
    """Two-phase submission: intents (key, seq, at) not yet settled, one each; the first of repeated intents counts."""
    once = requests.groupBy("key", "seq").agg(F.min("at").alias("at"))
    return once.join(settled.select("key", "seq").distinct(), ["key", "seq"], "left_anti")


def budget_warning(spent: dict[str, Column], caps: dict[str, int], percent: int) -> Column:
    """'<layer> budget at <n>% of cap' of the worst layer at or over the warning line, null where none is; ties go to the first."""
    shares = F.array(*[F.struct((spent[k] * 100.0 / caps[k]).alias("pct"), F.lit(-i).alias("i"), F.lit(k).alias("layer")) for i, k in enumerate(spent) if caps.get(k)])
    worst = F.array_max(F.filter(shares, lambda s: s["pct"] >= percent))
    return F.when(worst.isNotNull(), F.concat(worst["layer"], F.lit(" budget at "), F.round(worst["pct"]).cast("bigint").cast("string"), F.lit("% of cap")))


# Kinds of billable units.
BILLABLE = ["pages", "tokens_in", "tokens_out"]


def billed(reports: DataFrame, prices: dict[str, int], estimate: str = "estimate") -> DataFrame:
    """id, billed, estimated: a report's units at their prices, or the estimate where anything about the report is unsound.

    reports: id, kind, count (one row a unit; a null kind for a report without units), estimate. Unsound are: no
    units, an unknown or unpriced kind, a kind given twice, a count that is negative, broken or not finite.
    """
    price = F.create_map(*[F.lit(x) for p in prices.items() for x in p])
    unit = F.try_element_at(price, F.col("kind"))
    count = F.col("count").cast("double")
    sound = F.coalesce(F.col("kind").isin(BILLABLE) & unit.isNotNull() & (count >= 0) & (count < float("inf")) & (count == F.floor(count)), F.lit(False))
    g = reports.withColumn("sound", sound).withColumn("unit", unit).groupBy("id").agg(F.bool_and("sound").alias("ok"), F.count("kind").alias("n"), F.countDistinct("kind").alias("kinds"), F.sum(F.when(F.col("sound"), (count * F.col("unit")).cast("bigint"))).alias("total"), F.max(estimate).alias("est"))
    good = F.col("ok") & (F.col("n") > 0) & (F.col("n") == F.col("kinds"))
    return g.select("id", F.when(good, F.col("total")).otherwise(F.col("est")).alias("billed"), (~good).alias("estimated"))


def cost_preview(files: DataFrame, page_price: int, token_price: int) -> DataFrame:
    """scope_id, pages, tokens, page_cost, token_cost: 3,000 bytes a page over what is not native text, 4 bytes a token over all."""
    from corvida.functions.text import TEXT_NATIVE

    size = F.coalesce("byte_size", F.lit(0))
    g = files.groupBy("scope_id").agg(F.sum(F.when(F.col("media_type").isin(TEXT_NATIVE), 0).otherwise(size)).alias("scanned"), F.sum(size).alias("bytes"))
    pages, tokens = F.ceil(F.col("scanned") / 3000.0), F.col("bytes") / 4.0
    return g.select("scope_id", pages.alias("pages"), tokens.alias("tokens"), (pages * page_price).alias("page_cost"), (tokens * token_price).alias("token_cost"))


def reconcile_jobs(provider: DataFrame, rows: DataFrame) -> DataFrame:
    """job_id, state: known (both sides), orphan (the provider's only), unknown (ours only)."""
    p, r = provider.select("job_id", F.lit(1).alias("p")).distinct(), rows.where("job_id is not null").select("job_id", F.lit(1).alias("r")).distinct()
    return p.join(r, "job_id", "full_outer").select("job_id", F.when(F.col("p").isNull(), "unknown").when(F.col("r").isNull(), "orphan").otherwise("known").alias("state"))


def promotable(instances: DataFrame) -> DataFrame:
    """Instances (instance, unit, status, expected) all of whose expected units are there and done: only those replace what refs show."""
    g = instances.groupBy("instance").agg(F.bool_and(F.col("status") == "done").alias("all_done"), F.countDistinct("unit").alias("n"), F.max("expected").alias("expected"))
    return g.where("all_done and n = expected").select("instance")


def batch_lines(requests: DataFrame, results: DataFrame) -> DataFrame:
    """batch, asked, answered, state: a batch short of answers is no success; answers to nothing asked are an error."""
    a, b = requests.select("batch", "key").distinct(), results.select("batch", "key").distinct()
    j = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), ["batch", "key"], "full_outer")
    g = j.groupBy("batch").agg(F.count("a").alias("asked"), F.count(F.when(F.col("a").isNotNull(), F.col("b"))).alias("answered"), F.count_if(F.col("a").isNull()).alias("strange"))
    return g.select("batch", "asked", "answered", F.when(F.col("strange") > 0, "contract_violation").when(F.col("answered") < F.col("asked"), "incomplete").otherwise("done").alias("state"))


# Exit code of each outcome.
EXIT_CODES = {
    "success": 0, "failure": 1, "invalid_usage": 2, "partial_failure": 3, "permanent_failure": 4, "auth_error": 5,
    "budget_exceeded": 6, "interrupted": 7, "incompatible_profile": 8, "confirmation_rejected": 9,
}


def exit_code(outcome: Column) -> Column:
    """Exit code of an outcome; unknown outcomes are general failures, none is success."""
    code = F.try_element_at(F.create_map(*[F.lit(x) for p in EXIT_CODES.items() for x in p]), outcome)
    return F.when(outcome.isNull(), 0).otherwise(F.coalesce(code, F.lit(1)))


def run_outcome(done: Column, retryable: Column, permanent: Column) -> Column:
    """Outcome of a run from its counts of tasks done, failed for now and failed for good."""
    return F.when((retryable + permanent) == 0, "success").when((done == 0) & (retryable == 0), "permanent_failure").otherwise("partial_failure")


# Media types that OCR can discover units of, and the kind of unit each has.
OCR_UNITS = {"application/pdf": "page", "image/png": "image", "image/jpeg": "image", "image/webp": "image", "image/gif": "image"}


def ocr_unit_kind(media_type: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in OCR_UNITS.items() for x in p]), media_type)


def discovery_error(units: DataFrame) -> DataFrame:
    """raw_hash, error of discovered units (raw_hash, media_type, kind, selector, n): a medium without OCR, a unit of
    another kind, an image in several units, numbers with gaps or repeats, selectors that are no page numbers in order."""
    want = ocr_unit_kind(F.col("media_type"))
    place = F.row_number().over(Window.partitionBy("raw_hash").orderBy("n", "selector"))
    u = units.withColumn("want", want).withColumn("place", place)
    g = u.groupBy("raw_hash").agg(
        F.first("want").alias("want"), F.count("*").alias("units"), F.bool_and(F.col("kind") == F.col("want")).alias("kinds"), F.bool_and(F.col("n") == F.col("place") - 1).alias("order"),
        F.bool_and((F.col("kind") != "page") | (F.col("selector") == F.col("place").cast("string"))).alias("selectors"),
    )
    error = F.when(F.col("want").isNull(), "unsupported_media").when(~F.col("kinds"), "unexpected_kind").when((F.col("want") == "image") & (F.col("units") != 1), "not_one_unit").when(~F.col("order"), "not_contiguous").when(~F.col("selectors"), "not_canonical")
    return g.select("raw_hash", error.alias("error"))


# Layout labels whose text a page's Markdown leaves out and that are recovered.
RECOVERED = ["header", "footer", "number"]
LAYOUT = "struct<prunedResult:struct<parsing_res_list:array<struct<block_label:string,block_bbox:array<bigint>,block_content:string>>>>"


def layout_blocks(pages: DataFrame, key: str, json: str) -> DataFrame:
    """key, n, label, content, x, y of the blocks in a page's layout JSON; a box without four corners is none."""
    each = pages.select(key, F.posexplode(F.from_json(F.col(json), LAYOUT)["prunedResult"]["parsing_res_list"]).alias("n", "b"))
    box = F.when(F.size("b.block_bbox") == 4, F.col("b.block_bbox"))
    return each.where("b.block_label is not null").select(key, "n", F.col("b.block_label").alias("label"), F.coalesce("b.block_content", F.lit("")).alias("content"), box[0].alias("x"), box[1].alias("y"))


def recovered_blocks(blocks: DataFrame, key: str) -> DataFrame:
    """key, recovered: contents of recovered labels, not blank, boxes top to bottom and left to right, the rest after them."""
    kept = blocks.where(F.col("label").isin(RECOVERED) & F.col("content").rlike(r"\S"))
    item = F.struct(F.col("y").isNull().cast("int").alias("boxless"), "y", "x", "n", F.trim("content").alias("content"))
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda b: b["content"]).alias("recovered"))


def task_owner(kind: Column, online_done: Column, has_units: Column, bbox_set: Column) -> Column:
    """Which lane owns a task, by the kind of its output reference."""
    instance = F.when(bbox_set & (has_units | online_done), "online")
    return F.when(kind == "online", "online").when(kind == "normalized_instance", instance).when(kind == "offline", "offline").when(kind == "embedding", "embedding")


def within_limits(entries: DataFrame, scope: str, order: str, size: str, most_file: int, most_scope: int, most_entries: int) -> DataFrame:
    """entries with ``over``: the ceiling an entry breaks (file, entries, scope) in its scope's order, null where none."""
    w = Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n, total = F.count("*").over(w), F.sum(F.coalesce(F.col(size), F.lit(0))).over(w)
    return entries.withColumn("over", F.when(F.col(size) > most_file, "file").when(n > most_entries, "entries").when(total > most_scope, "scope"))


def coverage_gates(required: DataFrame, recalled: DataFrame) -> DataFrame:
    """kind, required, recalled, passed: whether every required item (kind, key) is recalled."""
    j = required.select("kind", "key").distinct().join(recalled.select("kind", "key").distinct().withColumn("got", F.lit(1)), ["kind", "key"], "left")
    return j.groupBy("kind").agg(F.count("*").alias("required"), F.count("got").alias("recalled")).withColumn("passed", F.col("required") == F.col("recalled"))


def rerank_effect(before: DataFrame, after: DataFrame) -> DataFrame:
    """improved, worsened, same: how the rank of each (query_id, key) moved; a missing rank counts as the worst."""
    b, a = before.select("query_id", "key", F.col("rank").alias("b")), after.select("query_id", "key", F.col("rank").alias("a"))
    worst = F.lit(1 << 30)
    j = b.join(a, ["query_id", "key"], "full_outer").select(F.coalesce("b", worst).alias("b"), F.coalesce("a", worst).alias("a"))
    return j.agg(F.count_if(F.col("a") < F.col("b")).alias("improved"), F.count_if(F.col("a") > F.col("b")).alias("worsened"), F.count_if(F.col("a") == F.col("b")).alias("same"))


def error_rate(pairs: DataFrame, truth: str, read: str) -> DataFrame:
    """Adds distance and cer: edit distance and its share of the true length; an empty truth gives 0 or 1."""
    n = F.char_length(truth)
    return pairs.withColumn("distance", F.levenshtein(truth, read)).withColumn("cer", F.when(n > 0, F.col("distance") / n).otherwise(F.when(F.char_length(read) > 0, 1.0).otherwise(0.0)))


def best_window_distance(text: Column, needle: Column) -> Column:
    """Smallest edit distance between a needle and any piece of its length in the text."""
    n = F.greatest(F.char_length(needle), F.lit(1))
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(text) - n + 1, F.lit(1)))
    return F.array_min(F.transform(starts, lambda i: F.levenshtein(F.substring(text, i, n), needle)))


def token_recall(truth: Column, read: Column) -> Column:
    """Share of the distinct tokens of the truth that were read; null without tokens."""
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != ""))
    return F.when(F.size(split(truth)) > 0, F.size(F.array_intersect(split(truth), split(read))) / F.size(split(truth)))
