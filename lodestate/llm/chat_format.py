"""Chat formatting over reply trees, in DataFrame operations only.

Messages form trees by parent pointers. Iterative self-joins by pointer doubling build, for each k, the table of
2^k-th ancestors; joining leaves with those tables enumerates every root-to-leaf path in log2(depth) rounds, whatever the
depth. Branches are ranked by the mean score of their messages (ties: smaller leaf); only the best `keep` paths of a tree meet
their texts, and are formatted as one conversation each, with the spans of the assistant texts as loss mask. A conversation's text
is one row by definition, so a very long one needs that much memory in one task; a tree of many branches does not.

Template: `[INST] role\\ntext [/INST]` for each message but the assistant's, `<s>text</s>` for those. Inside texts and roles
the control strings and the escape sign `~` are replaced by `~` and a digit, which `unescape` turns back exactly; a line
break inside a role becomes `~5`.

Defined cases: null text and null role count as empty; messages of equal position keep the order given to
`from_turns` (turn, role, text); an orphan (its parent is missing) counts as a root; an empty table gives no rows; a
message on a parent cycle has no root and is on no path; messages of the null tree are a tree of their own; texts of any length
are formatted whole. Only the named columns of the input are read, whatever others are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize

# What the template's control strings become inside a text. The escape sign comes first.
ESCAPES = [("~", "~0"), ("</s>", "~1"), ("<s>", "~2"), ("[INST]", "~3"), ("[/INST]", "~4")]
ROLE_ESCAPES = [*ESCAPES, ("\n", "~5")]


def escape(text: Column, table: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, code in table:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, table: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, code in reversed(table):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def from_turns(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a reply tree: each message answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select(
        F.col("conv_id").alias("tree"),
        F.row_number().over(order).cast("long").alias("node"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).select("tree", "node", F.expr("if(node > 1, node - 1, null)").alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def _join(left: DataFrame, right: DataFrame, node: str, how: str = "inner") -> DataFrame:
    """left (as a) and right (as b) where a's column `node` is b's node in the same tree; the null tree is one too."""
    return left.alias("a").join(right.alias("b"), F.expr(f"a.tree <=> b.tree and a.{node} = b.node"), how)


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) for every node on the path from each leaf to its root; up counts the steps from the leaf."""
    edges = messages.select("tree", "node", "parent")
    jumps = [materialize(_join(edges.where("parent is not null"), edges.select("tree", "node"), "parent", "left_semi").select("tree", "node", F.col("parent").alias("to")), "jump")]
    limit = max(1, messages.count()).bit_length() + 1
    while len(jumps) <= limit:
        step = jumps[-1]
        longer = _join(step, step, "to").select("a.tree", "a.node", F.col("b.to").alias("to"))
        longer = materialize(longer, "jump")
        if longer.isEmpty():
            break
        jumps.append(longer)
    parents = jumps[0].select("tree", F.col("to").alias("node"))
    at = _join(edges, parents, "node", "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(jumps))):
        more = _join(at, jumps[k], "node").select("a.tree", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        at = materialize(at.unionByName(more), "path")
    discard(*jumps)
    return at


def chosen_paths(messages: DataFrame, keep: int) -> DataFrame:
    """(tree, leaf, node, up, score) of the best `keep` paths of each tree, score being the path's."""
    every = paths(messages)
    scored = _join(every, messages.select("tree", "node", "score"), "node").select("a.tree", "leaf", "score")
    scored = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc_nulls_last("score"), "leaf"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= keep)
    return every.alias("p").join(best.alias("q"), F.expr("p.tree <=> q.tree and p.leaf = q.leaf")).select("p.*", "q.score")


def format_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """One row per chosen path: tree, leaf, score, formatted (string), loss (array of start and length in code points)."""
    part = F.when(F.col("role") == "assistant", F.concat(F.lit("<s>"), escape(F.col("text")), F.lit("</s>"))).otherwise(
        F.concat(F.lit("[INST] "), escape(F.col("role"), ROLE_ESCAPES), F.lit("\n"), escape(F.col("text")), F.lit(" [/INST]"))
    )
    parts = messages.select("tree", "node", part.alias("part"), (F.col("role") == "assistant").alias("own"))
    turns = _join(chosen_paths(messages, keep), parts, "node").select("a.*", "part", "own", F.length("part").cast("long").alias("size"))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)) + 3)
    turn = F.struct((-F.col("up")).alias("at"), "part", F.when(F.col("own"), F.struct("start", (F.col("size") - 7).alias("length"))).alias("span"))
    whole = turns.groupBy("tree", "leaf").agg(F.first("score").alias("score"), F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return whole.select("tree", "leaf", "score", F.array_join(F.transform("turns", lambda t: t["part"]), "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted strings: adds `turns` (array of role and text) and `loss_texts`, both unescaped."""
    pieces = F.filter(F.split("formatted", r"(?=\[INST\] |<s>)"), lambda p: p != "")

    def turn(p):
        body = F.substring(p, F.lit(8), F.length(p) - 15)
        cut = F.instr(body, F.lit("\n"))
        other = F.struct(
            unescape(F.substring(body, F.lit(1), cut - 1), ROLE_ESCAPES).alias("role"),
            unescape(F.substring(body, cut + 1, F.length(body))).alias("text"),
        )
        own = F.struct(F.lit("assistant").alias("role"), unescape(F.substring(p, F.lit(4), F.length(p) - 7)).alias("text"))
        return F.when(p.startswith("<s>"), own).otherwise(other)

    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_texts", loss)


def digest(formatted: DataFrame) -> DataFrame:
    back = read_back(formatted)
    loss = F.array_join("loss_texts", "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_control_case(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """conversations and conversation -1, whose texts hold control strings."""
    return conversations.select("conv_id", "turn", "role", "text").unionByName(
        spark.range(2).select(
            F.lit(-1).cast("long").alias("conv_id"),
            F.col("id").cast(conversations.schema["turn"].dataType).alias("turn"),
            F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
            F.lit("</s>[INST] ok [/INST]").alias("text"),
        )
    )
