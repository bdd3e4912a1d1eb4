"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass one folds the cells of every text's digest into a counting Bloom filter; the cells hit twice or more become bitmaps of
32,768 bits. Pass two looks each digest up in those bitmaps: a digest with a cell that was hit once cannot repeat, so its row
goes straight through; only the possibly repeated rows shuffle, by digest, and get the smallest id and the size of their group.
False positives of the filter only shuffle a few rows more.

Scale: the filter has at least CELLS_PER_ROW cells for each row, at every size: the rows are dealt by their digest into parts of at
most `part_rows` rows (expected), each with a filter of its own, which is broadcast: 2 * CELLS_PER_ROW * part_rows / 8 bytes (64 MB)
are the proven bound. The digests are written by part without a shuffle, and each part's rows are read with its filter.
What shuffles in pass one is cells (a part and a number), never rows. Groups are pre-aggregated before the shuffle. Their
results come back to the rows in two ways: groups with one in HEAVY of all rows or more (so there are at most HEAVY of them, 6 MB)
are broadcast, and the rest, none of which is a hot key, join by digest.

Defined cases: null text counts as empty; rows that repeat a doc_id are counted as rows of their group and share its verdict, but
`exact_dedup` decides by (doc_id, digest) and keeps one row (the first by its columns) of those equal in both; an empty table gives
an empty result; further columns of the input, whatever their names, are carried by `exact_dedup` untouched.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, discard, join_groups, materialize, text_of, unused

#: Bits in one bitmap of Spark's bitmap_construct_agg.
BITMAP_BITS = 32768
CELLS_PER_ROW = 16
#: Rows that share a filter.
PART_ROWS = 1 << 24


def normalized(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), r"[\x20\x09-\x0D]+", " ")


def _cell(digest: str, seed: int, cells: int) -> Column:
    return F.pmod(F.xxhash64(F.col(digest), F.lit(seed)), F.lit(cells))


def possibly_repeated(digests: DataFrame, digest: str, parts: int, cells: int) -> DataFrame:
    """digests (with `_part`, of 0 to parts - 1) with a boolean `_maybe`: false only where the digest occurs once."""
    hit = (
        digests.select("_part", F.explode(F.array(_cell(digest, 1, cells), _cell(digest, 2, cells))).alias("cell"))
        .groupBy("_part", "cell")
        .count()
        .where("count > 1")
    )
    maps = hit.groupBy("_part", F.expr(f"cell div {BITMAP_BITS}").alias("slot")).agg(
        F.expr(f"bitmap_construct_agg(cell % {BITMAP_BITS})").alias("bits")
    )
    maps = materialize(maps, "bloom", by="_part")
    bit = lambda s: (
        f"coalesce(shiftright(cast(conv(hex(substring(_bits{s}, cast(_cell{s} % {BITMAP_BITS} div 8 as int) + 1, 1)), 16, 10) as int),"
        f" cast(_cell{s} % 8 as int)) & 1, 0) = 1"
    )
    flagged = []
    for part in range(parts):
        out = digests.where(F.col("_part") == part)
        for seed in (1, 2):
            side = maps.where(F.col("_part") == part).select(F.col("slot").alias(f"_slot{seed}"), F.col("bits").alias(f"_bits{seed}"))
            out = out.withColumn(f"_cell{seed}", _cell(digest, seed, cells)).join(
                F.broadcast(side), F.expr(f"_cell{seed} div {BITMAP_BITS} = _slot{seed}"), "left"
            )
        flagged.append(out.withColumn("_maybe", F.expr(f"{bit(1)} and {bit(2)}")).select(*digests.columns, "_maybe"))
    return functools.reduce(DataFrame.unionByName, flagged)


def duplicate_groups(docs: DataFrame, part_rows: int = PART_ROWS, cells_per_row: int = CELLS_PER_ROW, heavy: int = HEAVY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.count()
    parts = max(1, -(-rows // part_rows))
    cells = max(1, cells_per_row * -(-rows // parts))
    digests = docs.select("doc_id", F.sha2(normalized().cast("binary"), 256).alias("text_sha256"))
    digests = materialize(digests.withColumn("_part", F.pmod(F.xxhash64("text_sha256"), F.lit(parts)).cast("int")), "digests", by="_part")
    flagged = materialize(possibly_repeated(digests, "text_sha256", parts, cells).drop("_part"), "flagged")
    discard(digests)
    maybe = flagged.where("_maybe").drop("_maybe")
    groups = maybe.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups, "groups")
    looked_up = join_groups(maybe, groups, ["text_sha256"], "group_size", rows, heavy=heavy)
    straight = flagged.where("not _maybe").select(
        "text_sha256", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    return looked_up.unionByName(straight).select(
        "doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts one row, with the smallest doc_id."""
    columns = docs.columns
    sha, one_row, of_id, of_sha = (unused(docs, n) for n in ("_text_sha", "_row", "_of_id", "_of_sha"))
    seen = duplicate_groups(docs).where("group_size > 1").groupBy("doc_id", "text_sha256").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    seen = seen.where("not kept or rows > 1").select(F.col("doc_id").alias(of_id), F.col("text_sha256").alias(of_sha), "kept")
    seen = materialize(seen, "seen")
    rows = docs.withColumn(sha, F.sha2(normalized().cast("binary"), 256))
    gone, repeated = seen.select(of_id, of_sha), seen.where("kept").select(of_id, of_sha)
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(sha) == F.col(of_sha))
    stay = rows.join(gone, same, "left_anti").select(columns)
    if repeated.isEmpty():
        return stay
    ordered = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    one = rows.join(repeated, same, "left_semi").groupBy("doc_id", sha).agg(F.min_by(F.struct(*columns), F.struct(*ordered)).alias(one_row))
    return stay.unionByName(one.select(f"{one_row}.*"))
