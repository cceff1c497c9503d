"""Costs of model calls: prices, rollups, scenarios, escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_prices(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Prices by exact model name, else by the name before an @. The price book has a row for each model; it is broadcast if small."""
    exact = prices.select(F.col("model").alias("_m1"), F.struct("p_in", "p_out", "p_cached").alias("_e"))
    bare = prices.select(F.col("model").alias("_m2"), F.struct("p_in", "p_out", "p_cached").alias("_b"))
    out = usage.join(exact, F.col("model") == F.col("_m1"), "left").join(bare, F.substring_index("model", "@", 1) == F.col("_m2"), "left")
    return out.withColumn("_p", F.coalesce("_e", "_b")).select(*usage.columns, "_p.*")


def call_cost(batch_factor: float = 0.5) -> Column:
    """Cost of a call; cached tokens at their own price, or the input's where there is none. Null without a price."""
    return F.when(F.col("batch_used"), base_cost() * batch_factor).otherwise(base_cost())


def rollup(priced: DataFrame, *keys: str) -> DataFrame:
    """Calls, tokens and cost; the cost is null if any priced call lacks a price. Failed calls count tokens but cost nothing."""
    billed = F.col("status") == "ok"
    missing = F.max((billed & F.col("cost").isNull()).cast("int")) == 1
    return priced.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.when(~missing, F.round(F.sum(F.when(billed, F.col("cost"))), 6)).alias("cost"))


def rollups(priced: DataFrame, keys: list[str]) -> DataFrame:
    """The rollup by each key and in total, in one pass over the data (grouping sets)."""
    billed = F.col("status") == "ok"
    g = priced.withColumn("_missing", (billed & F.col("cost").isNull()).cast("int")).withColumn("_cost", F.when(billed, F.col("cost")))
    sets = [[F.col(k)] for k in keys] + [[]]
    out = g.groupingSets(sets, *(F.col(k) for k in keys)).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.when(F.max("_missing") == 0, F.round(F.sum("_cost"), 6)).alias("cost"), F.grouping_id(*keys).alias("_g"))
    full = (1 << len(keys)) - 1
    name, value = F.lit("total"), F.lit("all")
    for i, k in enumerate(keys):
        only = full ^ (1 << (len(keys) - 1 - i))
        name = F.when(F.col("_g") == only, F.lit(k)).otherwise(name)
        value = F.when(F.col("_g") == only, F.col(k)).otherwise(value)
    return out.select(name.alias("by"), value.alias("value"), "calls", "input_tokens", "cost")


def escalation(usage: DataFrame) -> DataFrame:
    """Items of a stage, how many went beyond level 1, and the share."""
    items = usage.groupBy("stage", "item_id").agg(F.max("level").alias("top"))
    n, up = F.count("*"), F.count_if(F.col("top") >= 2)
    return items.groupBy("stage").agg(n.alias("items"), up.alias("escalated"), F.round(up / n, 6).alias("rate"))


def base_cost() -> Column:
    """A call's cost at the regular price."""
    return (F.col("input_tokens") - F.col("cached_tokens")) * F.col("p_in") / 1e6 + F.col("output_tokens") * F.col("p_out") / 1e6 + F.col("cached_tokens") * F.coalesce("p_cached", "p_in") / 1e6


def batch_savings(priced: DataFrame) -> DataFrame:
    """What batched calls would have cost at the regular price, what they did, and the difference."""
    batched = priced.where(F.col("batch_used") & (F.col("status") == "ok") & F.col("cost").isNotNull())
    regular, paid = F.sum(base_cost()), F.sum("cost")
    return batched.groupBy("stage").agg(F.round(regular, 6).alias("regular"), F.round(paid, 6).alias("discounted"), F.round(regular - paid, 6).alias("saved"))


def scenarios(priced: DataFrame, prices: DataFrame, spread: float = 0.25, batch_factor: float = 0.5) -> DataFrame:
    """Four scenarios: every item goes to the strong model at once (A), that batched (B), the cascade as it was without
    batch discounts (C), the cascade as it was (D). One row each: tokens, cost (low, central, high), per paper, savings against A.

    Items are the stages and items that a level has seen; an item's prompt has the tokens of its first record. The strong
    model is the most frequent one of level 3 (the first seen of equals). It is expected to answer with the stage's mean
    positive output of level 3, else of all levels, else with nothing; low and high change that by `spread`.
    A cost is null if a price is missing. `priced` has event_id (the order of records), prices and cost.
    """
    level3 = priced.where("level = 3")
    strong = level3.groupBy("model").agg(F.count("*").alias("_n"), F.min("event_id").alias("_first")).orderBy(F.desc("_n"), "_first").limit(1).select(F.col("model").alias("_strong"))
    price = strong.join(prices, F.col("_strong") == F.col("model"), "left").join(prices.select(F.col("model").alias("_bare"), F.col("p_in").alias("_bi"), F.col("p_out").alias("_bo")), F.substring_index("_strong", "@", 1) == F.col("_bare"), "left")
    price = price.select(F.coalesce("p_in", "_bi").alias("s_in"), F.coalesce("p_out", "_bo").alias("s_out"))
    items = priced.where("level IS NOT NULL").groupBy("stage", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).agg(F.min_by("input_tokens", "event_id").alias("tokens"))
    positive = F.when(F.col("output_tokens") > 0, F.col("output_tokens"))
    answer = priced.groupBy("stage").agg(F.coalesce(F.avg(F.when(F.col("level") == 3, positive)), F.avg(positive), F.lit(0.0)).alias("answer"))
    asked = items.groupBy("stage").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).join(answer, "stage").agg(F.sum("tokens").alias("i"), F.sum(F.col("n") * F.col("answer")).alias("o"))
    # one row: A and B from the items, C and D from the records, and the number of papers
    billed = F.col("status") == "ok"
    known = F.coalesce(F.max((billed & F.col("cost").isNull()).cast("int")), F.lit(0)) == 0
    flat = F.col("input_tokens") * F.col("p_in") / 1e6 + F.col("output_tokens") * F.col("p_out") / 1e6
    real = priced.agg(
        F.sum(F.when(billed, F.col("input_tokens"))).alias("ci"), F.sum(F.when(billed, F.col("output_tokens"))).alias("co"), F.when(known, F.sum(F.when(billed, flat))).alias("c"),
        F.sum("input_tokens").alias("di"), F.sum("output_tokens").alias("do"), F.when(known, F.sum(F.when(billed, F.col("cost")))).alias("d"), F.greatest(F.count_distinct("paper_id"), F.lit(1)).alias("papers"),
    )
    one = asked.join(F.broadcast(real), F.lit(True)).join(F.broadcast(price), F.lit(True), "left")  # a row each
    whole = lambda x: F.floor(F.col("o") * x)
    strong_cost = lambda x: F.col("i") * F.col("s_in") / 1e6 + whole(x) * F.col("s_out") / 1e6
    row = lambda name, i, o, costs: F.struct(F.lit(name).alias("scenario"), i.alias("input_tokens"), o.cast("long").alias("output_tokens"), *(c.alias(n) for n, c in zip(("low", "central", "high"), costs, strict=True)))
    a = [strong_cost(x) for x in (1 - spread, 1.0, 1 + spread)]
    rows = F.array(row("A", F.col("i"), whole(1.0), a), row("B", F.col("i"), whole(1.0), [x * batch_factor for x in a]), row("C", F.col("ci"), F.col("co"), [F.col("c")] * 3), row("D", F.col("di"), F.col("do"), [F.col("d")] * 3))
    out = one.select(F.explode(rows).alias("r"), a[1].alias("a"), "papers").select("r.*", "a", "papers")
    saved = F.col("a") - F.col("central")
    return out.select(
        "scenario", "input_tokens", "output_tokens", *(F.round(x, 4).alias(x) for x in ("low", "central", "high")), F.round(F.col("central") / F.col("papers"), 4).alias("per_paper"),
        F.round(saved, 4).alias("saved"), F.round(F.when(F.col("a") > 0, 100 * saved / F.col("a")).otherwise(F.when(saved.isNotNull(), 0.0)), 4).alias("saving_pct"),
    )


def tier_estimate(papers: DataFrame, tiers: DataFrame, prices: DataFrame, chunk_in: int, chunk_out: int, batch_factor: float = 0.5) -> DataFrame:
    """Calls, tokens and costs by paper (id, chunks) and model of a tier (level, model, rate): all chunks reach level 1, a
    rounded share (halves to even) the others. `tiers` and `prices` are a handful of rows."""
    t = with_prices(tiers, prices)
    calls = F.bround(F.col("chunks") * F.col("rate"), 0).cast("long")
    cost = F.col("calls") * chunk_in * F.col("p_in") / 1e6 + F.col("calls") * chunk_out * F.col("p_out") / 1e6
    out = papers.join(F.broadcast(t), F.lit(True)).withColumn("calls", calls)
    return out.select("id", "level", "model", "calls", (F.col("calls") * chunk_in).alias("input_tokens"), (F.col("calls") * chunk_out).alias("output_tokens"), F.round(cost, 6).alias("cost"), F.round(cost * batch_factor, 6).alias("batch_cost"))


#: Blended prices of a call at levels 2 and 3 (fixed values).
TIER_PRICES = (9.60, 18.00)


def escalation_cost(l2: Column, l3: Column, chunks: Column) -> Column:
    """What a cascade's escalations cost of what they could, 0 to 1: calls of levels 2 and 3 weighted by price; 0 without chunks."""
    w2, w3 = TIER_PRICES
    return F.when(chunks > 0, (w2 * F.coalesce(l2, F.lit(0)) + w3 * F.coalesce(l3, F.lit(0))) / ((w2 + w3) * chunks)).otherwise(0.0)


def cumulative(rows: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """A running sum and the share of rows up to here, by key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("running", F.round(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), 6)).withColumn("rank", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
