"""Chat formatting of reply trees, in DataFrame functions only.

Messages name their parent. Iterative self-joins double the distance that each node's pointer spans, so
the depth of a node and the score of its path from the root take log2(depth) rounds; leaves are ranked by
the score of their path, and the chosen paths are listed by running the same pointer tables backwards.
Each chosen path becomes one conversation.

Template: ``<s>`` then ``[INST role] text [/INST]`` for each turn, then ``</s>``. In roles and texts the
characters backslash, ``[``, ``]`` and ``<`` are written as ``\\b``, ``\\o``, ``\\c`` and ``\\l``, so no
control string can occur inside and the original comes back by undoing the four in reverse.

Defined results: null text counts as empty, null role as an empty role; a parent that is missing makes a
root; rows of a linear conversation go by (turn, role, text), so ties and repeated rows are turns in a
row; a row without a conversation id is a conversation of its own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ESCAPES = (("\\", "\\b"), ("[", "\\o"), ("]", "\\c"), ("<", "\\l"))
BEGIN, END = "<s>", "</s>"
TURN = r"\[INST ([^\[\]<]*)\] ([^\[\]<]*) \[/INST\]"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def tree_paths(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, node, depth) of the ``best`` root-to-leaf paths of each tree (None: all).

    ``nodes`` has tree, node (unique in its tree), parent (null: root) and score (null: 0).
    """
    ids = materialize(nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0)).cast("double").alias("score")), "nodes")
    known = ids.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    state = ids.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("ptr"), F.lit(1).cast("long").alias("depth"), "score")
    state, levels, most = materialize(state, "jump"), [], 2 * ids.count()
    while (left := state.filter("ptr is not null")).limit(1).count():
        if 1 << len(levels) > most:  # a pointer has passed more ancestors than there are nodes
            raise ValueError("a reply tree has a cycle")
        levels.append(left.select("tree", "node", "ptr"))
        far = state.select("tree", F.col("node").alias("ptr"), F.col("ptr").alias("next"), F.col("depth").alias("d"), F.col("score").alias("s"))
        # only nodes that have not met their root are joined: one deep tree does not cost the others a round
        jumped = left.join(far, ["tree", "ptr"]).select("tree", "node", F.col("next").alias("ptr"), (F.col("depth") + F.col("d")).alias("depth"), (F.col("score") + F.col("s")).alias("score"))
        state = materialize(jumped.unionAll(state.filter("ptr is null").select("tree", "node", "ptr", "depth", "score")), "jump")
    parents = levels[0].select("tree", F.col("ptr").alias("node")).distinct() if levels else state.select("tree", "node").limit(0)
    leaves = state.join(parents, ["tree", "node"], "left_anti")
    leaves = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "node")))
    if best is not None:
        leaves = leaves.filter(F.col("rank") <= best)
    paths = leaves.select("tree", F.col("node").alias("leaf"), "rank", "node")
    for level in reversed(levels):
        paths = materialize(paths, "paths")
        up = paths.join(level, ["tree", "node"]).select("tree", "leaf", "rank", F.col("ptr").alias("node"))
        paths = paths.unionAll(up)
    return paths.join(state.select("tree", "node", "depth"), ["tree", "node"])


def format_paths(paths: DataFrame, texts: DataFrame) -> DataFrame:
    """tree, leaf, rank, formatted, loss: byte ranges (start, size) of the assistant texts in it.

    ``texts`` has tree, node, role, text.
    """
    turns = paths.join(texts, ["tree", "node"]).select("tree", "leaf", "rank", "depth", "role", escape(F.coalesce("role", F.lit(""))).alias("r"), escape(F.coalesce("text", F.lit(""))).alias("t"))
    turns = turns.withColumn("piece", F.concat(F.lit("[INST "), "r", F.lit("] "), "t", F.lit(" [/INST]")))
    path = Window.partitionBy("tree", "leaf", "rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("piece")).over(path), F.lit(0)) + len(BEGIN)
    turns = turns.withColumn("start", before + F.octet_length("r") + len("[INST ] "))
    one = F.struct("depth", "piece", (F.col("role") == LEARNED).alias("learned"), "start", F.octet_length("t").alias("size"))
    whole = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    loss = F.transform(F.filter("turns", lambda x: F.coalesce(x["learned"], F.lit(False))), lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size")))
    return whole.select("tree", "leaf", "rank", F.concat(F.lit(BEGIN), F.array_join(F.transform("turns", lambda x: x["piece"]), ""), F.lit(END)).alias("formatted"), loss.alias("loss"))


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: each turn replies to the one before."""
    # where the id is null the number only has to be unique
    tree = F.coalesce(F.concat(F.lit("k"), F.col("conv_id").cast("string")), F.concat(F.lit("n"), F.monotonically_increasing_id().cast("string")))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    return conversations.select(tree.alias("tree"), "conv_id", "turn", "role", "text").select(
        "tree", "conv_id", F.row_number().over(order).alias("node"), "role", "text"
    ).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds roles, texts and loss_text as they come back from ``formatted`` and ``loss``."""
    raw = F.encode("formatted", "UTF-8")
    under = F.transform("loss", lambda s: F.decode(F.substring(raw, s["start"] + 1, s["size"]), "UTF-8"))
    return formatted.select(
        "*",
        F.transform(F.regexp_extract_all("formatted", F.lit(TURN), F.lit(1)), unescape).alias("roles"),
        F.transform(F.regexp_extract_all("formatted", F.lit(TURN), F.lit(2)), unescape).alias("texts"),
        unescape(F.array_join(under, "")).alias("loss_text"),
    )


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations formatted, and their digests as read back from the result."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, LEARNED, trap)], "conv_id long, turn long, role string, text string")
    nodes = materialize(conversation_nodes(rows.unionAll(extra)), "turns")
    done = read_back(format_paths(tree_paths(nodes), nodes.select("tree", "node", "role", "text")))
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return done.select(
        F.expr("if(tree like 'k%', try_cast(substring(tree, 2) as bigint), null)").alias("conv_id"),
        F.size("roles").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _coded(x: str) -> str:
    return f"(2 * length({x}) - length(regexp_replace({x}, '[\\\\\\[\\]<]', '', 'g')))"


OP4_SQL = f"""
with c as (
  select conv_id, turn, role, text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, '{LEARNED}', '</s>[INST] ok [/INST]'),
t as (select conv_id, alone, coalesce(role, '') as r, coalesce(text, '') as t,
      row_number() over (partition by conv_id, alone order by turn nulls first, role nulls first, text nulls first) as n
      from (select *, case when conv_id is null then row_number() over () end as alone from c)),
a as (select conv_id, count(*) as n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by n)) as turns_sha256,
      coalesce(string_agg(t, '' order by n) filter (r = '{LEARNED}'), '') as loss,
      sum({_coded("r")} + {_coded("t")} + {len("[INST ] ") + len(" [/INST]")}) + {len(BEGIN + END)} as formatted_chars from t group by conv_id, alone)
select conv_id, n_turns, turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
       cast(formatted_chars as bigint) as formatted_chars from a
"""
