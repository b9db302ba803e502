"""Fetch outcomes, retries, politeness, proxies, resume and the summary of a run, over a table of fetches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators.ordered import at_positions, numbered, running_max, running_sum
from webloom.operators.sized import checkpointed, rows_with_keys

# Fixed values.
RETRIED_STATUS = [202, 429, 500, 502, 503, 504]
RETRIED_OUTCOMES = ["timeout", "connection_error", "empty_response"]


def fetches(log: DataFrame, columns: list[str]) -> DataFrame:
    """Each ``fetch_id`` once with ``columns``; its repeats differ in ``logged_at`` only.  Rows without an id are left out."""
    return log.select("fetch_id", *columns).where(F.col("fetch_id").isNotNull()).dropDuplicates(["fetch_id"])


def fetches_with_bodies(log: DataFrame, columns: list[str]) -> DataFrame:
    """As ``fetches``, for columns as wide as pages: only fetches that occur twice or more are shuffled with them."""
    rows = log.select("fetch_id", *columns).where(F.col("fetch_id").isNotNull())
    repeated = checkpointed(rows.groupBy("fetch_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fetch_id"))
    return rows_with_keys(rows, repeated, "fetch_id", how="left_anti").unionByName(rows_with_keys(rows, repeated, "fetch_id").dropDuplicates(["fetch_id"])).select("fetch_id", *columns)


def with_page_bytes(log: DataFrame) -> DataFrame:
    """``log`` with ``page_bytes``, so that pages themselves needn't go where their size is wanted."""
    return log.withColumn("page_bytes", F.coalesce(F.octet_length("html"), F.lit(0)).cast("bigint"))


def outcome(status: Column, body: Column, failure: Column, robots_allowed: Column) -> Column:
    """``fetch_status`` from a response: ``failure`` names the exception's class, if there was one."""
    return (
        F.when(~robots_allowed, "robots_disallowed")
        .when(failure.isin("timeout", "ssl_error", "proxy_error", "connection_error", "redirect_loop"), failure)
        .when(failure.isNotNull() & (failure != ""), "error")
        .when((status == 200) & (F.trim(F.coalesce(body, F.lit(""))) == ""), "empty_response")
        .when(status == 200, "ok")
        .when(status.isNotNull(), "http_error")
        .otherwise("error")
    )


def is_retried(status: Column, fetch_status: Column, has_proxies: bool = False) -> Column:
    again = F.coalesce(status.isin(RETRIED_STATUS), F.lit(False)) | F.coalesce(fetch_status.isin(RETRIED_OUTCOMES), F.lit(False))
    return again | F.coalesce(fetch_status == "proxy_error", F.lit(False)) if has_proxies else again


def backoff_seconds(attempt: Column, jitter: Column | None = None) -> Column:
    """Wait before another try: powers of two up to 16 seconds, times a jitter between a half and one."""
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(16.0)) * (F.lit(1.0) if jitter is None else jitter)


def error_key(fetch_error: Column) -> Column:
    return F.left(F.substring_index(F.coalesce(fetch_error, F.lit("")), ";", 1), F.lit(80))


def status_histogram(log: DataFrame) -> DataFrame:
    return fetches(log, ["fetch_status"]).groupBy("fetch_status").agg(F.count(F.lit(1)).alias("n"))


def top_errors(log: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` commonest errors of fetches that weren't ok, ties by their text."""
    rows = fetches(log, ["fetch_status", "fetch_error"]).where("fetch_status <> 'ok'")
    return rows.groupBy(error_key(F.col("fetch_error")).alias("error")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error").limit(k)


def top_domains(log: DataFrame, k: int = 10) -> DataFrame:
    return fetches(log, ["host"]).where("host <> ''").groupBy(F.col("host").alias("domain")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "domain").limit(k)


def response_times(log: DataFrame) -> DataFrame:
    """One row: count, extremes, mean of one decimal, upper median and 95th percentile by place, of ok fetches."""
    times = fetches(log, ["fetch_status", "timing"]).where("fetch_status = 'ok'").select("timing")
    median, p95 = F.floor(F.col("n") / 2), F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(0.95)))
    places = at_positions(times, "timing", F.lit(True)).agg(
        F.max(F.when(median.between(F.col("first"), F.col("last")), F.col("timing"))).alias("median_ms"),
        F.max(F.when(p95.between(F.col("first"), F.col("last")), F.col("timing"))).alias("p95_ms"),
        F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("n"), F.min("timing").alias("min_ms"), F.max("timing").alias("max_ms"),
        F.bround(F.sum(F.col("timing") * (F.col("last") - F.col("first") + 1)) / F.max("n"), 1).alias("mean_ms"),
    )
    return places.select("n", "min_ms", "median_ms", "p95_ms", "max_ms", "mean_ms")


def verdict(rate: Column, rows: Column) -> Column:
    return F.when(rows == 0, "no_data").when(rate >= 90, "excellent").when(rate >= 75, "good").when(rate >= 50, "fair").otherwise("poor")


def warnings(rate: Column, p95: Column) -> Column:
    low = F.when(rate < 50, F.format_string("Success rate %.1f%% is low: see the top errors; raise the timeout or try again later.", rate))
    slow = F.when(p95 > 15000, F.format_string("The 95th percentile of response times, %d ms, is high.", p95))
    return F.array_compact(F.array(low, slow))


def health(log: DataFrame, by: list[str]) -> DataFrame:
    """Rows, ok rows, success rate and verdict of each group."""
    rows = fetches(log, [*by, "fetch_status"]).groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("fetch_status") == "ok").alias("n_ok"))
    rate = F.bround(F.lit(100.0) * F.col("n_ok") / F.col("n_rows"), 1)
    return rows.withColumn("success_rate_percent", rate).withColumn("verdict", verdict(F.col("success_rate_percent"), F.col("n_rows")))


def worker_totals(log: DataFrame, worker: str = "proxy") -> DataFrame:
    """Totals of each worker with its first and last address; fetches without a worker form one group."""
    rows = fetches(with_page_bytes(log), [worker, "fetch_status", "timing", "page_bytes", "url", "fetched_at"])
    return rows.groupBy(worker).agg(
        F.count(F.lit(1)).alias("done"), F.count_if(F.col("fetch_status") == "ok").alias("ok"), F.count_if(~F.coalesce(F.col("fetch_status") == "ok", F.lit(False))).alias("failed"),
        F.sum("timing").alias("total_ms"), F.sum("page_bytes").alias("total_bytes"),
        F.min_by("url", F.struct("fetched_at", "fetch_id")).alias("first_url"), F.max_by("url", F.struct("fetched_at", "fetch_id")).alias("last_url"),
    )


def network_totals(log: DataFrame) -> DataFrame:
    """One row: retries, fetches that robots forbade and the first twenty of their addresses by time."""
    rows = fetches(log, ["attempts", "fetch_status", "url", "fetched_at"])
    totals = rows.agg(F.coalesce(F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(0)).cast("bigint").alias("retries"), F.count_if(F.col("fetch_status") == "robots_disallowed").alias("robots_blocked"))
    sample = rows.where("fetch_status = 'robots_disallowed'").orderBy("fetched_at", "fetch_id").limit(20)
    listed = sample.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fetched_at", "fetch_id", "url"))), lambda x: x["url"]), "\n").alias("blocked_sample"))
    return totals.crossJoin(F.broadcast(listed))  # one row each


def politeness_schedule(log: DataFrame, gap_ms: int = 1000) -> DataFrame:
    """``(fetch_id, host, arrival_ms, slot_ms)``: when each fetch may begin if fetches of a host are ``gap_ms`` apart.

    A slot is the arrival or the gap after the host's previous slot, whichever is later; in closed form the number of the
    fetch times the gap plus the greatest lead so far.  Ties of arrival go by ``fetch_id``.
    """
    rows = fetches(log, ["host", "fetched_at"]).where("host IS NOT NULL AND fetched_at IS NOT NULL").select("fetch_id", "host", F.unix_millis("fetched_at").alias("arrival_ms"))
    hour = F.floor(F.col("arrival_ms") / 3_600_000)
    rows = numbered(rows, ["host"], hour, ["arrival_ms", "fetch_id"]).withColumn("lead", F.col("arrival_ms") - F.col("rn") * gap_ms)
    rows = running_max(rows, ["host"], "lead", ["arrival_ms", "fetch_id"], "most")
    return rows.select("fetch_id", "host", "arrival_ms", (F.col("rn") * gap_ms + F.col("most")).cast("bigint").alias("slot_ms"))


def proxy_quarantines(log: DataFrame, max_failures: int = 3) -> DataFrame:
    """``(proxy, runs, longest_run, quarantines)``: runs of consecutive failures of each proxy; a success ends one.

    A fetch failed if it got no response or one of 500 and above; a run of ``max_failures`` is a quarantine.
    """
    rows = fetches(log, ["proxy", "http_status", "fetched_at"]).where("proxy IS NOT NULL")
    rows = rows.withColumn("ok", F.coalesce(F.col("http_status") < 500, F.lit(False)).cast("int"))
    rows = rows.withColumn("_bucket", F.date_trunc("hour", "fetched_at"))
    rows = running_sum(rows, ["proxy"], F.col("ok"), ["fetched_at", "fetch_id"], "island")
    runs = rows.where("ok = 0").groupBy("proxy", "island").agg(F.count(F.lit(1)).alias("length"))
    every = rows.select("proxy").distinct()
    found = runs.groupBy("proxy").agg(F.count(F.lit(1)).alias("runs"), F.max("length").alias("longest_run"), F.count_if(F.col("length") >= max_failures).alias("quarantines"))
    return every.join(found, "proxy", "left").select("proxy", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("runs", "longest_run", "quarantines")])


def round_robin(log: DataFrame, proxies: list[str]) -> DataFrame:
    """``(fetch_id, proxy)``: proxies in turn by time of fetch."""
    rows = fetches(log, ["fetched_at"]).where("fetched_at IS NOT NULL")
    rows = numbered(rows, [], F.date_trunc("hour", "fetched_at"), ["fetched_at", "fetch_id"])
    return rows.select("fetch_id", F.element_at(F.array(*[F.lit(p) for p in proxies]), (F.col("rn") % len(proxies) + 1).cast("int")).alias("proxy"))


def pending(requested: DataFrame, done: DataFrame, key: str = "url", retry_failed: bool = False) -> DataFrame:
    """Requested rows whose ``key`` isn't done yet; a failed fetch counts as done unless ``retry_failed``."""
    finished = done.where("fetch_status = 'ok'") if retry_failed else done
    return requested.join(finished.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def skipped(requested: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    return requested.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def human_duration(seconds: Column) -> Column:
    s = F.bround(seconds).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), r)).otherwise(F.format_string("%dh %dm %ds", h, m, r))


def run_summary(log: DataFrame) -> DataFrame:
    """One nested row: results, throughput over the log's span, data quality, domains, response times and health."""
    rows = fetches(with_page_bytes(log), ["fetch_status", "fetched_at", "page_bytes", "host"])
    base = rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("fetch_status") == "ok").alias("n_ok"), F.coalesce(F.sum("page_bytes"), F.lit(0)).alias("total_bytes"),
        F.coalesce((F.max(F.unix_millis("fetched_at")) - F.min(F.unix_millis("fetched_at"))) / 1000.0, F.lit(0.0)).alias("elapsed"), F.countDistinct(F.nullif("host", F.lit(""))).alias("unique_domains"),
    )
    entries = lambda df, key: df.agg(F.collect_list(F.struct(F.col(key).alias("key"), "n")).alias("x"))
    listed = lambda c: F.array_sort(F.col(c), lambda a, b: F.when(a["n"] != b["n"], (b["n"] - a["n"]).cast("int")).when(a["key"] < b["key"], -1).otherwise(1))
    hist = status_histogram(log).where("fetch_status IS NOT NULL").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fetch_status", "n")))).alias("hist"))
    errors = entries(top_errors(log), "error").withColumnRenamed("x", "errors")
    domains = entries(top_domains(log), "domain").withColumnRenamed("x", "domains")
    one = base
    for part in (hist, errors, domains, response_times(log).select(F.struct("*").alias("times"))):
        one = one.crossJoin(F.broadcast(part))  # one row each
    n, ok = F.col("n_rows"), F.col("n_ok")
    rate = F.coalesce(F.bround(F.lit(100.0) * ok / F.nullif(n, F.lit(0)), 1), F.lit(0.0))
    elapsed = F.nullif("elapsed", F.lit(0.0))
    return one.select(
        F.struct(n.alias("total_requested"), ok.alias("scraped_ok"), (n - ok).alias("failed"), rate.alias("success_rate_percent")).alias("results"),
        F.struct(F.bround("elapsed", 1).alias("total_seconds"), human_duration(F.col("elapsed")).alias("elapsed_human"), F.bround(n / elapsed, 2).alias("sites_per_second"), F.bround(F.lit(60.0) * n / elapsed, 1).alias("sites_per_minute")).alias("throughput"),
        F.struct(F.col("hist").alias("fetch_status_histogram"), listed("errors").alias("top_errors"), F.col("total_bytes").alias("bytes_scraped_total"), F.bround(F.col("total_bytes") / F.greatest(ok, F.lit(1)) / 1024, 1).alias("mean_page_kb")).alias("data_quality"),
        F.struct("unique_domains", listed("domains").alias("top_domains")).alias("domain_analysis"), F.col("times").alias("response_time_analysis"),
        F.struct(verdict(rate, n).alias("verdict"), warnings(rate, F.col("times.p95_ms")).alias("warnings")).alias("health"),
    )
