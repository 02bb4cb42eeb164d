"""Chat formatting: reply trees to conversations.

Messages form trees: every message names its parent. Self-joins with doubled reach (a round joins each message's jump
pointer with itself) give every message its root, its depth and the summed score of its path in ceil(log2(depth))
rounds. A tree's leaves are its branches; they are ranked by the mean score of their path, and the best `branches`
of each tree are walked back to the root over the stored jump pointers: again a self-join a round. Each chosen path
becomes one formatted conversation.

Template, with its control strings `<s> </s> [INST] [/INST] <<SYS>> <</SYS>>`:
    <s> then for an assistant turn TEXT</s>, for any other turn [INST]ROLE\\nTEXT[/INST]
A control string inside a text or role is broken by a backslash after its first character (one more, if backslashes
stand there already); reading takes one away. So no text can forge a turn, and every text comes back unchanged.

Defined results: null text or role is the empty string; ties in turn are ordered by role, then text; repeated rows
stay as turns of their own; a conv_id of null is a conversation of its own; columns that are not named are not read, whatever their names, and very long texts are taken whole;
an empty table gives no rows. Messages on a cycle or
with a parent that isn't there: the latter are roots, the former have no root and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import pick, stored, union

_BODY = r"(/?s>|/?INST\]|<SYS>>|</SYS>>)"
_ESCAPE = rf"([<\[])(\\*){_BODY}"
_UNESCAPE = rf"([<\[])\\(\\*){_BODY}"
_TURN = r"(?s)\[INST\](.*?)\[/INST\]|(.*?)</s>"
#: Rounds of doubling; 2^40 messages in one path are out of reach.
MAX_ROUNDS = 40


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def escape_role(role: Column) -> Column:
    """A role may not hold the line feed that ends it."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.array_join(
        F.transform(F.split(unescape(role), r"\\\\"), lambda part: F.replace(part, F.lit("\\n"), F.lit("\n"))),
        "\\",
    )


def jumps(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The jump tables (id, up: the message 2^k above, null beyond the root) for k = 0, 1, ..; and id, root, depth, total."""
    own = messages.select("id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    there = own.select(F.col("id").alias("known"))
    state = (
        own.join(there, own["parent"] == there["known"], "left")
        .select("id", F.col("known").alias("up"), F.col("id").alias("top"), F.lit(1).alias("depth"), F.col("score").alias("total"))
    )
    state = stored(state, "chat-jumps")
    done, active = [state.where("up is null")], state.where("up is not null")
    levels = [active.select("id", "up")]
    for _ in range(MAX_ROUNDS):  # messages that have reached their root leave the rounds
        if active.isEmpty():
            break
        far = union([*done, active]).select(F.col("id").alias("f_id"), F.col("up").alias("f_up"), F.col("top").alias("f_top"), F.col("depth").alias("f_depth"), F.col("total").alias("f_total"))
        state = active.join(far, active["up"] == far["f_id"]).select(
            "id", F.col("f_up").alias("up"), F.col("f_top").alias("top"), (F.col("depth") + F.col("f_depth")).alias("depth"), (F.col("total") + F.col("f_total")).alias("total")
        )
        state = stored(state, "chat-jumps")
        done.append(state.where("up is null"))
        active = state.where("up is not null")
        levels.append(active.select("id", "up"))
    return levels, union(done).select("id", F.col("top").alias("root"), "depth", "total")


def ranked_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """path (its leaf), tree, place (from 1 at the root), id: the messages of the best branches of each tree.

    messages: id (any type, unique), parent (null at a root), score.
    """
    levels, reach = jumps(messages)
    inner = messages.select(F.col("parent").alias("id")).where("id is not null").distinct()
    leaves = reach.join(inner, "id", "left_anti")
    best = Window.partitionBy("root").orderBy(F.desc(F.col("total") / F.col("depth")), "id")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
    walk = stored(chosen.select(F.col("id").alias("path"), F.col("root").alias("tree"), "id"), "chat-paths")
    for k in range(len(levels) - 2, -1, -1):
        up = levels[k].select(F.col("id").alias("u_id"), F.col("up").alias("u_up"))
        higher = walk.join(up, walk["id"] == up["u_id"]).select("path", "tree", F.col("u_up").alias("id"))
        walk = stored(walk.unionByName(higher), "chat-paths")
    depth = reach.select(F.col("id").alias("d_id"), F.col("depth").alias("place"))
    return walk.join(depth, walk["id"] == depth["d_id"]).select("path", "tree", "place", "id")


def formatted(turns: DataFrame) -> DataFrame:
    """path, formatted, spans: array of (start from 1, length) in code points, the loss mask: what assistants said.

    turns: path, place, role, text. A span covers the escaped text, without the closing mark.
    """
    said = F.col("role") == "assistant"
    piece = F.when(said, F.concat(escape(F.col("text")), F.lit("</s>"))).otherwise(
        F.concat(F.lit("[INST]"), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit("[/INST]"))
    )
    whole = (
        turns.select("path", "place", piece.alias("piece"), said.alias("said"))
        .groupBy("path")
        .agg(F.sort_array(F.collect_list(F.struct("place", "piece", "said"))).alias("turns"))
    )
    start = F.struct(F.lit(4).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate(
        "turns",
        start,
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["piece"])).alias("at"),
            F.when(
                t["said"],
                F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), (F.length(t["piece"]) - 4).alias("length")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.concat(F.lit("<s>"), F.array_join(F.transform("turns", lambda t: t["piece"]), ""))
    return whole.select("path", text.alias("formatted"), spans.alias("spans"))


def parsed(conversations: DataFrame) -> DataFrame:
    """What formatted() wrote, read back: its columns, turns: array of (role, text), and loss_texts: array of strings."""
    body = F.substring(F.col("formatted"), 4, 2147483647)
    inst = F.lit("[INST]")

    def turn(x: Column) -> Column:
        asked = F.startswith(x, inst)
        inner = F.substring(x, F.lit(7), F.length(x) - 13)
        cut = F.instr(inner, F.lit("\n"))
        role = F.when(asked, unescape_role(F.substring(inner, F.lit(1), cut - 1))).otherwise("assistant")
        text = F.when(asked, F.substring(inner, cut + 1, F.length(inner))).otherwise(F.substring(x, F.lit(1), F.length(x) - 4))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return conversations.select(
        "*",
        F.transform(F.regexp_extract_all(body, F.lit(_TURN), F.lit(0)), turn).alias("turns"),
        F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"]))).alias("loss_texts"),
    )


def messages_of(conversations: DataFrame) -> DataFrame:
    """conv_id, id, parent, score, role, text: a table of turns as reply chains; each row answers the row before it."""
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.withColumn("n", F.row_number().over(order))
    key = lambda n: F.struct("conv_id", n.alias("n"))
    return numbered.select(
        "conv_id", key(F.col("n")).alias("id"), F.when(F.col("n") > 1, key(F.col("n") - 1)).alias("parent"), F.lit(0.0).alias("score"), "role", "text"
    )


def format_conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """path, formatted, spans for the best branches of every tree of messages (id, parent, score, role, text)."""
    messages = stored(messages, "chat-messages")
    paths = ranked_paths(messages.select("id", "parent", "score"), branches)
    said = messages.select(F.col("id").alias("m_id"), "role", "text")
    return formatted(paths.join(said, paths["id"] == said["m_id"]).select("path", "place", "role", "text"))


def digests(conversations: DataFrame) -> DataFrame:
    """One row per formatted conversation of messages_of(): counts and digests of what is read back."""
    back = parsed(conversations)
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        F.col("path")["conv_id"].alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(every.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


CONTROL_ROWS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def chat_digests(conversations: DataFrame) -> DataFrame:
    """All conversations, and conversation -1, whose texts hold control strings."""
    spark = conversations.sparkSession
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    more = spark.createDataFrame(CONTROL_ROWS, "conv_id bigint, turn bigint, role string, text string")
    return digests(format_conversations(messages_of(rows.unionByName(more))))


def chat_sql(conversations: str = "conversations") -> str:
    escaped = r"regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g')"
    text = escaped.format("text")
    role = escaped.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")
    return f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from {conversations}
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
agg as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as every,
    coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
    sum(case when role = 'assistant' then length({text}) + 4 else 14 + length({role}) + length({text}) end) + 3 as chars
  from rows group by conv_id)
select conv_id, n_turns, sha256(every) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, chars::bigint as formatted_chars
from agg
"""
