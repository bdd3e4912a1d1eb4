"""Scalar rules of the command dialect: remaining times and byte ranges, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_live(expires_us: Column, now_us: Column) -> Column:
    """No stamp, or one still ahead: an object is expired from its stamp on."""
    return expires_us.isNull() | (now_us < expires_us)


def ttl_seconds(present: Column, expires_us: Column, now_us: Column) -> Column:
    """-2 missing, -1 immortal, else whole seconds rounded up, 1 at least."""
    left = F.ceil((expires_us - now_us) / 1_000_000).cast("long")
    return F.when(~present, -2).when(expires_us.isNull(), -1).otherwise(F.greatest(left, F.lit(1))).cast("long")


def pttl_ms(present: Column, expires_us: Column, now_us: Column) -> Column:
    """-2 missing, -1 immortal, else whole milliseconds rounded down, 0 at least."""
    left = F.floor((expires_us - now_us) / 1000).cast("long")
    return F.when(~present, -2).when(expires_us.isNull(), -1).otherwise(F.greatest(left, F.lit(0))).cast("long")


def expire_time(present: Column, expires_us: Column) -> Column:
    return F.when(~present, -2).when(expires_us.isNull(), -1).otherwise(F.floor(expires_us / 1_000_000)).cast("long")


def get_range(value: Column, first: int, last: int) -> Column:
    """Inclusive; negative places count from the end; clamped; empty when nothing is left."""
    n = F.octet_length(value)
    start = F.lit(first) if first >= 0 else F.greatest(n + first, F.lit(0))
    end = F.least(F.lit(last) if last >= 0 else n + last, n - 1)
    return F.when((start > end) | (n == 0), F.lit("")).otherwise(F.substring(value, start + 1, end - start + 1))


def freshness(version: Column, current: Column) -> Column:
    return F.when(version == current, "Current").when(version < current, "Stale").otherwise("Future")


def stream_shard(partition: Column, shards: int) -> Column:
    """FNV-1a (64 bits) of the partition's UTF-8 bytes, mod shards; 0 without shards or partition. The hash is held as two
    halves of 32 bits, so that no product overflows."""
    if shards == 0:
        return F.lit(0).cast("long")
    mask = F.lit(0xFFFFFFFF)
    digits = F.hex(F.encode(partition, "UTF-8"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).otherwise(F.array().cast("array<int>"))
    octets = F.transform(places, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(h, octet):
        lo = h["lo"].bitwiseXOR(octet)  # times 2^40 + 435
        low = lo * 435
        high = h["hi"] * 435 + F.shiftright(low, 32) + lo * 256
        return F.struct(high.bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))

    h = F.aggregate(octets, start, step)
    return F.coalesce((h["hi"] % shards * ((1 << 32) % shards) + h["lo"]) % shards, F.lit(0)).cast("long")


def bits_of_hex(digits: Column) -> Column:
    """Hex digits as bits, four for each."""
    places = F.sequence(F.lit(1), F.length(digits))
    return F.array_join(F.transform(places, lambda i: F.lpad(F.conv(F.substring(digits, i, F.lit(1)), 16, 2), 4, "0")), "")


#: The first bytes of every index key, in hex: no user's key begins so.
INDEX_TAG = b"LODE-IDX1".hex().upper()


def _pairs(digits: Column) -> Column:
    return F.regexp_replace(digits, "(..)", "$1 ")


def escaped_hex(text: Column) -> Column:
    """The UTF-8 bytes of text in hex, each 00 as 00FF, and the end mark 00."""
    return F.concat(F.replace(F.replace(_pairs(F.hex(F.encode(text, "UTF-8"))), F.lit("00 "), F.lit("00 FF ")), F.lit(" "), F.lit("")), F.lit("00"))


def term_prefix(index: Column, term: Column) -> Column:
    """What all index keys of a term begin with, in hex: tag, index in eight bytes, 00, the escaped term. It is a unique entry's key."""
    return F.concat(F.lit(INDEX_TAG), F.lpad(F.hex(index.cast("long")), 16, "0"), F.lit("00"), escaped_hex(term))


def index_key(index: Column, term: Column, primary: Column) -> Column:
    """A non-unique entry's key in hex; keys sort by index, term, primary."""
    return F.concat(term_prefix(index, term), escaped_hex(primary))


def prefix_successor(digits: Column) -> Column:
    """The first key, in hex, behind all that begin with the prefix: its last byte below FF raised by one and what follows cut; null
    where there is none."""
    head = F.trim(F.regexp_replace(_pairs(digits), "(FF )+$", ""))
    last = F.lpad(F.hex(F.conv(F.substring(head, -2, 2), 16, 10).cast("long") + 1), 2, "0")
    return F.when(head != "", F.concat(F.replace(F.substring(head, F.lit(1), F.length(head) - 2), F.lit(" "), F.lit("")), last))


def window_kind(start: Column, end: Column) -> Column:
    """What scan bounds (hex) ask an index for: TermWindow (all of one term), TermRange (terms from one to another), else Scan."""
    prefix = f"^{INDEX_TAG}[0-9A-F]{{16}}00(?:(?!00)..|00FF)*00$"
    bare = start.rlike(prefix)
    both = bare & end.rlike(prefix) & (F.substring(start, 1, 34) == F.substring(end, 1, 34)) & (start < end)
    return F.when(bare & (prefix_successor(start) == end), "TermWindow").when(both, "TermRange").otherwise("Scan")


def derived_id(session: Column, sequence: Column, attempt: Column) -> Column:
    """The identity of a permit or a transaction: 128 bits (hex) of a hash of who asked, which request, which attempt."""
    return F.substring(F.sha2(F.concat_ws(":", session, sequence, attempt).cast("binary"), 256), 1, 32)
