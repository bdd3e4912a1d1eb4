"""Operation logs from the given tables: one row per operation, ordered by seq inside a key, times as µs since the epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR_US, MINUTE_US = 3_600_000_000, 60_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, seq, now_us, kind (the event's type), k (a small integer), cents (value in hundredths)."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"),
        F.col("event_id").alias("seq"),
        F.expr("unix_micros(cast(ts as timestamp))").alias("now_us"),
        F.col("event_type").alias("kind"),
        F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )


def bytes_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups set with an expiry of k hours, purchases set without, errors delete, views get, clicks ask for existence."""
    e = events(spark, sf_dir)
    op = F.when(F.col("kind") == "signup", "set_ex").when(F.col("kind") == "purchase", "set").when(F.col("kind") == "error", "delete").when(F.col("kind") == "view", "get").otherwise("exists")
    return e.select("key", "seq", "now_us", op.alias("op"), F.col("cents").cast("string").alias("value"), F.when(F.col("kind") == "signup", F.col("now_us") + F.col("k") * HOUR_US).alias("expires_us"))


def counter_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks add k, purchases subtract k, errors delete."""
    e = events(spark, sf_dir).where(F.col("kind").isin("click", "purchase", "error"))
    op = F.when(F.col("kind") == "error", "delete").otherwise("add")
    return e.select("key", "seq", "now_us", op.alias("op"), F.when(F.col("kind") == "click", F.col("k")).when(F.col("kind") == "purchase", -F.col("k")).otherwise(0).alias("delta"))


def bounded_log(spark: SparkSession, sf_dir: str, groups: int = 10) -> DataFrame:
    """One bounded counter for each group of users: clicks add k, purchases subtract k."""
    e = events(spark, sf_dir).where(F.col("kind").isin("click", "purchase"))
    return e.select((F.col("key") % groups).alias("key"), "seq", F.when(F.col("kind") == "click", F.col("k")).otherwise(-F.col("k")).alias("delta"))


def lease_log(spark: SparkSession, sf_dir: str, resources: int = 15) -> DataFrame:
    """Three owners of each resource: sign-ups acquire for k minutes (0: for ever), views renew, errors release. Both give the last
    grant's token, every fifth event that of the grant before."""
    e = events(spark, sf_dir).where(F.col("kind").isin("signup", "view", "error"))
    op = F.when(F.col("kind") == "signup", "lease_acquire").when(F.col("kind") == "view", "lease_renew").otherwise("lease_release")
    behind = F.when(F.col("kind") != "signup", F.when(F.col("seq") % 5 == 0, 1).otherwise(0)).cast("long")
    owner = F.expr(f"key div {resources} % 3")
    return e.select((F.col("key") % resources).alias("key"), "seq", "now_us", op.alias("op"), owner.alias("owner"), (F.col("k") * MINUTE_US).alias("ttl_us"), F.lit(None).cast("long").alias("token"), behind.alias("behind"))


def share_log(spark: SparkSession, sf_dir: str, groups: int = 10, capacity: int = 500) -> DataFrame:
    """Bounded counters by group of users: the first row creates, clicks add k, purchases subtract k, views ask, sign-ups narrow the
    share by k mod 8 on the side of their id's parity, errors create again and, every 20th, drop the counter first."""
    e = events(spark, sf_dir).withColumns({"user": F.col("key"), "key": F.col("key") % groups})
    first = e.groupBy("key").agg((F.min("seq") * 3 - 1).alias("seq"), F.lit("create").alias("op"), F.lit(capacity).cast("long").alias("amount"))
    op = F.when(F.col("kind").isin("click", "purchase"), "add").when(F.col("kind") == "view", "get").when(F.col("kind") == "signup", "share").otherwise("create")
    amount = F.when(F.col("kind") == "click", F.col("k")).when(F.col("kind") == "purchase", -F.col("k")).when(F.col("kind") == "error", capacity)
    side = F.col("seq") % 2 == 0
    low = F.when(F.col("kind") == "signup", F.when(side, F.col("k") % 8).otherwise(0)).cast("long")
    high = F.when(F.col("kind") == "signup", F.when(side, capacity).otherwise(capacity - F.col("k") % 8)).cast("long")
    rows = e.select("key", (F.col("seq") * 3 + 1).alias("seq"), op.alias("op"), amount.cast("long").alias("amount"), low.alias("low"), high.alias("high"))
    drops = e.where("kind = 'error' and seq % 20 = 0").select("key", (F.col("seq") * 3).alias("seq"), F.lit("drop").alias("op"))
    return rows.unionByName(first, allowMissingColumns=True).unionByName(drops, allowMissingColumns=True)


def overflow_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counter log in steps of 2^59: counters overflow."""
    return counter_log(spark, sf_dir).withColumn("delta", F.expr("case when op = 'add' then sign(delta) * least(abs(delta), 7) else 0 end").cast("long") * (1 << 59))


def conditional_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups set where absent, to expire in k hours; purchases set where present and keep the expiry; clicks set always, and keep
    it where k is odd, else clear it; views set where absent without one; errors delete."""
    e = events(spark, sf_dir)
    kind, odd = F.col("kind"), F.col("k") % 2 == 1
    condition = F.when(kind.isin("signup", "view"), "IfAbsent").when(kind == "purchase", "IfPresent").when(kind == "click", "Always")
    expiry = F.when(kind == "signup", "At").when((kind == "purchase") | (kind == "click") & odd, "Keep").when(kind.isin("view", "click"), "Clear")
    at = F.when(kind == "signup", F.col("now_us") + F.col("k") * HOUR_US)
    op = F.when(kind == "error", "delete").otherwise("set")
    return e.select("key", "seq", "now_us", op.alias("op"), F.col("cents").cast("string").alias("value"), condition.alias("condition"), expiry.alias("expiry"), at.alias("at_us"))


def expiry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups set with an expiry of k hours, purchases set without, errors delete, clicks move the expiry to k minutes from
    now, views remove it."""
    e = events(spark, sf_dir)
    op = F.when(F.col("kind").isin("signup", "purchase"), "set").when(F.col("kind") == "error", "delete").when(F.col("kind") == "click", "expire_at").otherwise("persist")
    at = F.when(F.col("kind") == "signup", F.col("now_us") + F.col("k") * HOUR_US).when(F.col("kind") == "click", F.col("now_us") + F.col("k") * MINUTE_US)
    return e.select("key", "seq", "now_us", op.alias("op"), F.col("cents").cast("string").alias("value"), at.alias("at_us"))


def splice_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups set, clicks splice two digits in at k mod 16, views read four bytes from k mod 8 on, errors delete."""
    e = events(spark, sf_dir).where("kind <> 'purchase'")
    op = F.when(F.col("kind") == "signup", "set").when(F.col("kind") == "error", "delete").when(F.col("kind") == "click", "set_range").otherwise("get_range")
    value = F.when(F.col("kind") == "signup", F.col("cents").cast("string")).when(F.col("kind") == "click", F.lpad((F.col("seq") % 100).cast("string"), 2, "0")).otherwise("4")
    return e.select("key", "seq", "now_us", op.alias("op"), value.alias("value"), F.when(F.col("kind") == "click", F.col("k") % 16).otherwise(F.col("k") % 8).alias("offset"))


def semaphore_log(spark: SparkSession, sf_dir: str, groups: int = 20, capacity: int = 200) -> DataFrame:
    """A group's semaphore is created 60 events after its first row, and again at errors; clicks acquire k permits under their own id,
    every seventh twice, every 14th of those for one permit more; purchases release the same user's latest asked for; views inspect."""
    e = events(spark, sf_dir).where("kind <> 'signup'")
    asked = F.last(F.when(F.col("kind") == "click", F.col("seq")), ignorenulls=True).over(Window.partitionBy("key").orderBy("seq"))
    e = e.withColumns({"asked": F.coalesce(asked, F.lit(-1)), "owner": F.col("key"), "key": F.col("key") % groups})
    op = F.when(F.col("kind") == "click", "acquire").when(F.col("kind") == "purchase", "release").when(F.col("kind") == "view", "inspect").otherwise("create")
    qty = F.when(F.col("kind") == "click", F.col("k")).when(F.col("kind") == "error", capacity).cast("long")
    first = e.groupBy("key").agg(((F.min("seq") + 60) * 3).alias("seq"), F.lit("create").alias("op"), F.lit(capacity).cast("long").alias("qty"))
    rows = e.select("key", (F.col("seq") * 3 + 1).alias("seq"), op.alias("op"), F.when(F.col("kind").isin("click", "purchase"), F.col("asked")).alias("permit"), "owner", qty.alias("qty"))
    again = e.where("kind = 'click' and seq % 7 = 0")
    again = again.select("key", (F.col("seq") * 3 + 2).alias("seq"), F.lit("acquire").alias("op"), F.col("asked").alias("permit"), "owner", (F.col("k") + F.when(F.col("seq") % 14 == 0, 1).otherwise(0)).alias("qty"))
    return rows.unionByName(again).unionByName(first, allowMissingColumns=True)


def stream_log(spark: SparkSession, sf_dir: str, shards: int = 4, keep: int | None = 50, block: int | None = None) -> DataFrame:
    """The first row of a shard creates it, every row appends its props to its user's partition; before its append, the first
    row of each hour trims the shard to `keep` behind its next offset (no trims without). seq is three times the event's id,
    plus 0 for a create, 1 for a trim, 2 for an append. With `block`, the first row of each `block` event ids trims too: as ids
    are unique, a shard holds fewer than keep + block entries, however many events an hour has and whether or not hours come back."""
    e = table(spark, sf_dir, "events").select(
        (F.col("user_id") % shards).alias("key"), F.col("event_id").alias("seq"), F.expr(f"unix_micros(cast(ts as timestamp)) div {HOUR_US}").alias("hour"),
        F.col("user_id").alias("partition"), F.coalesce(F.octet_length("props"), F.lit(0)).cast("long").alias("payload_bytes"),
    )
    creates = e.groupBy("key").agg((F.min("seq") * 3).alias("seq"), F.lit("create").alias("op"))
    appends = e.select("key", (F.col("seq") * 3 + 2).alias("seq"), F.lit("append").alias("op"), "partition", F.octet_length(F.coalesce(F.col("partition").cast("string"), F.lit(""))).cast("long").alias("partition_bytes"), "payload_bytes")
    log = appends.unionByName(creates, allowMissingColumns=True).withColumn("through", F.lit(keep).cast("long"))
    if keep is None:
        return log
    e = e.withColumn("block", F.col("seq") - F.pmod(F.col("seq"), F.lit(block)) if block else F.lit(0))
    trims = e.groupBy("key", "hour", "block").agg((F.min("seq") * 3 + 1).alias("seq"), F.lit("trim_behind").alias("op"), F.lit(keep).cast("long").alias("through"))
    return log.unionByName(trims.drop("hour", "block"), allowMissingColumns=True)


def retry_log(spark: SparkSession, sf_dir: str, sessions: int = 40, lag: int = 8) -> DataFrame:
    """The counter log as numbered requests of sessions, each acknowledging what lies `lag` requests back. Every 11th is sent
    again: where its event's id is odd at once, else 12 requests later, when it has been acknowledged."""
    w = Window.partitionBy("key").orderBy("event")
    log = counter_log(spark, sf_dir).select((F.col("key") % sessions).alias("key"), F.col("seq").alias("event"), "delta")
    log = log.withColumn("request", F.row_number().over(w).cast("long")).withColumn("ack", F.greatest(F.col("request") - lag, F.lit(0)))
    later = F.when(F.col("event") % 2 == 1, 0).otherwise(12)
    first, again = log.withColumn("seq", F.col("request") * 2), log.where("event % 11 = 0").withColumn("seq", (F.col("request") + later) * 2 + 1)
    return first.unionByName(again)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a versioned ordered keyspace: a second version where the order key is a multiple of 5, gone at multiples of 17."""
    o = table(spark, sf_dir, "orders")
    alive = o.where(F.col("o_orderkey") % 17 != 0)
    return alive.select(
        F.format_string("order:%010d", "o_orderkey").alias("key"),
        F.round(F.col("o_totalprice") * 100).cast("long").cast("string").alias("value"),
        F.when(F.col("o_orderkey") % 5 == 0, 2).otherwise(1).cast("long").alias("version"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderkey").alias("id"),
    )


def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index on status: each entry carries the version of its primary when it was written; some are stale."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderstatus").alias("term"),
        F.format_string("order:%010d", "o_orderkey").alias("primary"),
        F.when((F.col("o_orderkey") % 5 == 0) & (F.col("o_orderkey") % 10 != 0), 2).otherwise(1).cast("long").alias("version"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by scope and hourly window: a read or a write each, a latency in ns, and a hot-key sighting."""
    e = events(spark, sf_dir)
    return e.select(
        (F.col("key") % 8).alias("scope"),
        F.expr(f"now_us div {HOUR_US}").alias("window"),
        F.col("seq").alias("sequence"),
        F.col("key").alias("item"),
        (F.col("kind") == "view").cast("long").alias("reads"),
        (F.col("kind") != "view").cast("long").alias("writes"),
        (F.col("cents") * 10_000).alias("latency_ns"),
        (F.col("kind") == "purchase").alias("critical"),
        (F.col("cents") > 10_000).alias("tail"),
        (F.col("k") * 1000).alias("stall"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample of every signal family for each order, by scope of its customer; sequence is the order's key."""
    o = table(spark, sf_dir, "orders").withColumn("c", F.round(F.col("o_totalprice") * 100).cast("long"))
    return o.selectExpr(
        "o_custkey as customer", "o_custkey % 8 as scope", "o_orderkey as sequence", "o_orderkey % 97 as depth", "c % 1000 as wait_p50", "c % 1000 + o_custkey % 500 as wait_p99", "c % 1000 + o_custkey % 500 + 7 as wait_p999",
        "o_orderkey % 3 as rejections", "c % 10000 as cpu_ns", "c % 30000 + 1 as service_ns", "c % 1000000 as resident_bytes", "c % 2000000 as logical_bytes", "o_orderkey % 101 as pressure_pct", "o_orderkey % 5 as attempts",
        "o_orderkey % 2 as failures", "c as moved_bytes", "1L as moves", "c % 1000000 as received", "c % 2000000 as transmitted", "c % 70000 as storage_read", "c % 90000 as storage_written", "c % 10000 as storage_synced",
        "c % 70000 as commit_lag", "c % 90000 as replica_lag", "c % 70000 as checkpoint_bytes", "o_orderkey % 97 as checkpoint_age", "o_orderkey % 5 as repair_assets", "c % 90000 as repair_bytes", "o_orderkey % 101 as repair_age",
        "c % 1000 as scrub_bytes", "c % 1000 + o_custkey % 500 as scrub_age", "c % 2000000 + c % 30000 + 1 as physical_bytes", "c % 1000000 as stored_bytes", "o_orderkey % 3 as fragments", "o_orderkey % 2 as degraded_assets",
        "o_orderkey % 97 + c % 1000 as busiest_worker", "o_orderkey % 97 as mean_worker", "c % 1000 + o_custkey % 500 as busiest_tablet", "c % 1000 as mean_tablet",
    )
