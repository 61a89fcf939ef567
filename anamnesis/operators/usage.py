"""Roll-ups of token and request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day(at: str = "at") -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def token_usage(log: DataFrame, since: Column) -> DataFrame:
    """Tokens by day and step since then."""
    rows = log.where(F.col("at") >= since)
    return rows.groupBy(day().alias("day"), "step").agg(F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output"))


def spend(log: DataFrame, steps: tuple[str, ...], price_in: float, price_out: float) -> DataFrame:
    """Money by day for the steps given; prices are for a million tokens."""
    rows = log.where(F.col("step").isin(*steps)).groupBy(day().alias("day"))
    totals = rows.agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    return totals.select("day", (F.col("i") * F.lit(price_in) / 1e6 + F.col("o") * F.lit(price_out) / 1e6).alias("spent"))


def activity(log: DataFrame, since: Column) -> DataFrame:
    """Requests by day and category, and by client and category, in one pass."""
    rows = log.where(F.col("at") >= since).select(
        day().alias("day"), "category", F.coalesce(F.nullif("client", F.lit("")), F.lit("unknown")).alias("client"), "req_bytes", "res_bytes"
    )
    sets = [[F.col("day"), F.col("category")], [F.col("client"), F.col("category")]]
    return rows.groupingSets(sets, "day", "client", "category").agg(
        F.count("*").alias("n"), F.sum("req_bytes").alias("req_bytes"), F.sum("res_bytes").alias("res_bytes")
    )


def recent_requests(log: DataFrame, limit: int = 30) -> DataFrame:
    return log.orderBy(F.desc("id")).limit(limit)


def category_of(path: Column) -> Column:
    """What a request asks for, by its path."""
    first = F.regexp_extract(path, "^/?([a-z]+)", 1)
    return F.when(first.isin("recall", "probe", "inject", "memories", "sync", "ingest", "profiles"), first).otherwise("other")


def client_of(header: Column, agent: Column, address: Column) -> Column:
    """The client's own name, else its program, else its address."""
    blank = F.lit("")
    return F.coalesce(F.nullif(F.trim(header), blank), F.nullif(F.regexp_extract(agent, "^([^/ ]+)", 1), blank), address, blank)


def machine_ledger(pushes: DataFrame) -> DataFrame:
    """First and last sight, last address and all bytes of each machine."""
    return pushes.groupBy("machine").agg(
        F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.max_by("ip", F.struct("at", "ip")).alias("ip"), F.sum("bytes").alias("bytes")
    )


def run_totals(log: DataFrame) -> DataFrame:
    """Tokens and calls of each run."""
    return log.where("run_id IS NOT NULL").groupBy("run_id").agg(
        F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output"), F.count("*").alias("calls")
    )
