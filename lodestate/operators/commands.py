"""The command dialect: argument lists as typed operations, with the dialect's errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Commands that are known but not supported, and those that concern the session alone.
UNSUPPORTED = ["AUTH", "INCR", "DECR", "INCRBY", "DECRBY", "MGET", "MSET"]
SESSION = ["PING", "ECHO", "HELLO", "CLIENT", "SELECT", "QUIT", "COMMAND"]
#: Microseconds of one unit of each expiry option, and whether it counts from now.
EXPIRY = {"EX": (1_000_000, True), "PX": (1_000, True), "EXAT": (1_000_000, False), "PXAT": (1_000, False)}
EXPIRE = {"EXPIRE": (1_000_000, True), "PEXPIRE": (1_000, True), "EXPIREAT": (1_000_000, False), "PEXPIREAT": (1_000, False)}


def translate(commands: DataFrame) -> DataFrame:
    """commands (now_us, argv: array of strings, and more) with op, status, condition, expiry and at_us.

    SET takes one of NX and XX and one of EX, PX, EXAT, PXAT and KEEPTTL; a second one, a time that is not a positive number, or
    any other word is an error. EXPIRE and its kin take a number, whatever its sign."""
    argv, rest = F.col("argv"), F.col("rest")
    rows = commands.withColumns({"verb": F.upper(F.get(argv, F.lit(0))), "rest": F.transform(F.when(F.size(argv) > 3, F.slice("argv", 4, 1000)).otherwise(F.array().cast("array<string>")), lambda w: F.upper(w))})
    with_time = F.array(*map(F.lit, EXPIRY))
    words = F.filter(rest, lambda w, i: (i == 0) | ~F.array_contains(with_time, F.get(rest, i - 1)))  # options, without their times
    unless = F.array(*map(F.lit, [*EXPIRY, "KEEPTTL", "NX", "XX"]))
    conditions = F.filter(words, lambda w: w.isin("NX", "XX"))
    expiries = F.filter(words, lambda w: w.isin("KEEPTTL", *EXPIRY))
    number = lambda text: F.when(text.rlike("^-?[0-9]{1,18}$"), text.cast("long"))
    option = F.get(expiries, F.lit(0))
    time = number(F.get(rest, F.array_position(rest, option).cast("int")))
    given = lambda verb, table, amount: F.coalesce(*(F.when(verb == name, amount * unit + (F.col("now_us") if relative else 0)) for name, (unit, relative) in table.items()))
    set_at = given(option, EXPIRY, time)
    syntax = (F.size(argv) < 3) | (F.size(conditions) > 1) | (F.size(expiries) > 1) | F.exists(words, lambda w: ~F.array_contains(unless, w))
    bad_time = option.isin(*EXPIRY) & (time.isNull() | (time <= 0))
    verb, is_set, is_expire = F.col("verb"), F.col("verb") == "SET", F.col("verb").isin(*EXPIRE)
    reads = {"GET": "get", "DEL": "delete", "EXISTS": "exists", "TTL": "ttl", "PTTL": "pttl", "STRLEN": "length", "PERSIST": "persist", "EXPIRETIME": "expire_time", "PEXPIRETIME": "expire_time", "GETRANGE": "get_range", "SETRANGE": "set_range"}
    op = F.when(is_set, "set").when(is_expire, "expire_at")
    for name, does in reads.items():
        op = op.when((verb == name) & (does != "set_range") | (verb == name) & (F.octet_length(F.get(argv, F.lit(3))) > 0), does)
    op = op.when(verb == "SETRANGE", "length")  # an empty patch asks for the length
    status = (
        F.when(verb.isin(*UNSUPPORTED), "Unsupported").when(verb.isin(*SESSION), "Session").when(is_set & syntax, "SyntaxError").when(is_set & F.coalesce(bad_time, F.lit(False)), "InvalidExpire")
        .when(is_expire & ((F.size(argv) != 3) | number(F.get(argv, F.lit(2))).isNull()), "SyntaxError").when(op.isNull(), "UnknownCommand").otherwise("Ok")
    )
    ok = F.col("status") == "Ok"
    kind = F.when(option.isin(*EXPIRY), "At").when(option == "KEEPTTL", "Keep").otherwise("Clear")
    condition = F.when(F.get(conditions, F.lit(0)) == "NX", "IfAbsent").when(F.get(conditions, F.lit(0)) == "XX", "IfPresent").otherwise("Always")
    out = rows.withColumn("status", status).withColumns({
        "op": F.when(ok, op), "condition": F.when(ok & is_set, condition), "expiry": F.when(ok & is_set, kind),
        "at_us": F.when(ok & is_set, set_at).when(ok & is_expire, given(verb, EXPIRE, number(F.get(argv, F.lit(2))))),
    })
    return out.drop("verb", "rest")
