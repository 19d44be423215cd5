"""Reply trees to chat conversations, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidemark.storage import new_folder, written

BRANCHES = 1  # paths taken from each tree
OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
NO_ROLE = "!"  # no encoded role holds it
LEARNED = "assistant"


def escape(text: str) -> Column:
    r"""A backslash after every ``<``, ``[`` and ``\``: no control string of this or another template survives in a text."""
    return F.regexp_replace(text, r"([<\[\\])", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def thread(conversations: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: each row answers the one before it.

    Rows stand by turn, then role and text; null conversations are one
    conversation.
    """
    order = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    place = F.row_number().over(order).cast("long")
    rows = conversations.select("conv_id", place.alias("msg_id"), "role", "text")
    return rows.withColumns({"parent_id": F.when(F.col("msg_id") > 1, F.col("msg_id") - 1), "score": F.lit(0.0)})


def chosen_paths(messages: DataFrame, branches: int = BRANCHES) -> DataFrame:
    """The best ``branches`` root-to-leaf paths of every reply tree.

    ``messages`` are ``conv_id, msg_id, parent_id, score``, ids unique inside a
    conversation.  A message answers an earlier one: a parent that is missing,
    null or not smaller makes it a root, so there are no cycles.  A path's
    score is the sum of its messages' scores (null: 0), ties go to the smaller
    leaf id.  Links that skip 1, 2, 4, ... messages are made by joining them
    with themselves, so the longest thread of n messages takes log n joins;
    the chosen leaves then reach all their ancestors by the same links.
    Returns ``conv_id, leaf_id, rank, msg_id, up``, ``up`` counted from the leaf.
    """
    nodes = messages.select("conv_id", "msg_id", "parent_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    ends = nodes.select(F.col("conv_id").alias("_c"), F.col("msg_id").alias("_m"))
    answers = nodes["conv_id"].eqNullSafe(ends["_c"]) & (nodes["parent_id"] == ends["_m"]) & (nodes["parent_id"] < nodes["msg_id"])
    # From each message up to, not with, ``next``: their score and the highest of them.
    reached = written(
        nodes.join(ends, answers, "left").select("conv_id", "msg_id", F.col("_m").alias("next"), "score", F.col("msg_id").alias("root")), "reached"
    )
    links, ended = [], reached.filter("next is null")
    open_ = reached.filter("next is not null")
    while open_.limit(1).count():
        links.append(open_.select("conv_id", F.col("msg_id").alias("low"), F.col("next").alias("high")))
        far = ended.union(open_).toDF("_c", "_m", "_next", "_score", "_root")
        on = open_["conv_id"].eqNullSafe(far["_c"]) & (open_["next"] == far["_m"])
        reached = written(
            open_.join(far, on).select(
                "conv_id", "msg_id", F.col("_next").alias("next"), (F.col("score") + F.col("_score")).alias("score"), F.col("_root").alias("root")
            ),
            "reached",
        )
        ended, open_ = ended.union(reached.filter("next is null")), reached.filter("next is not null")
    parents = (links[0] if links else open_.withColumn("high", F.col("next"))).select(F.col("conv_id").alias("_c"), F.col("high").alias("_h")).distinct()
    leaf = ended["conv_id"].eqNullSafe(parents["_c"]) & (ended["msg_id"] == parents["_h"])
    scored = ended.join(parents, leaf, "left_anti")
    best = Window.partitionBy("conv_id", "root").orderBy(F.col("score").desc(), "msg_id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches)
    paths = written(ranked.select("conv_id", F.col("msg_id").alias("leaf_id"), "rank", "msg_id", F.lit(0).cast("long").alias("up")), "paths")
    for k, link in enumerate(links):
        far = link.select(F.col("conv_id").alias("_c"), F.col("low").alias("_l"), F.col("high").alias("_h"))
        more = paths.join(far, paths["conv_id"].eqNullSafe(far["_c"]) & (paths["msg_id"] == far["_l"]))
        more = more.select("conv_id", "leaf_id", "rank", F.col("_h").alias("msg_id"), (F.col("up") + (1 << k)).alias("up"))
        paths = written(paths.union(more), "paths")
    return paths


def format_chats(messages: DataFrame, branches: int = BRANCHES) -> DataFrame:
    """One formatted conversation per chosen path.

    ``messages`` are ``conv_id, msg_id, parent_id, role, text, score``; other
    columns play no part.  A turn is an opening mark with its role, the escaped
    text and a closing mark; a null text is empty, a null role stays null.
    Returns ``conv_id, leaf_id, rank, formatted`` and ``loss``, the spans
    (start from 0 and length, in characters) of the assistant's texts; no
    messages, no rows.
    """
    paths = chosen_paths(messages, branches)
    said = messages.select(F.col("conv_id").alias("_c"), F.col("msg_id").alias("_m"), "role", "text")
    rows = paths.join(said, paths["conv_id"].eqNullSafe(said["_c"]) & (paths["msg_id"] == said["_m"]))
    role = F.coalesce(F.url_encode("role"), F.lit(NO_ROLE))
    head = F.concat(F.lit(OPEN), role, F.lit(BREAK))
    body = F.coalesce(escape("text"), F.lit(""))
    turns = rows.select("conv_id", "leaf_id", "rank", "up", "role", head.alias("head"), body.alias("body"))
    order = Window.partitionBy("conv_id", "leaf_id").orderBy(F.col("up").desc())
    whole = F.char_length("head") + F.char_length("body") + len(CLOSE)
    ahead = F.coalesce(F.sum(whole).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.struct((ahead + F.char_length("head")).alias("start"), F.char_length("body").cast("long").alias("length"))
    turns = turns.withColumn("span", F.when(F.col("role") == LEARNED, span))
    parts = turns.select("conv_id", "leaf_id", "rank", F.struct(-F.col("up"), F.concat("head", "body", F.lit(CLOSE)).alias("turn"), "span").alias("part"))
    joined = parts.groupBy("conv_id", "leaf_id", "rank").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return joined.select(
        "conv_id",
        "leaf_id",
        "rank",
        F.array_join("parts.turn", "").alias("formatted"),
        F.array_compact("parts.span").alias("loss"),
    )


def read_turns(formatted: str) -> Column:
    """The turns (role, text) in a formatted conversation."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 2147483647 - 2)

    def turn(piece):
        role = F.substring_index(piece, BREAK, 1)
        body = F.substr(piece, F.char_length(role) + 2, F.char_length(piece) - F.char_length(role) - F.lit(1 + len(CLOSE)))
        return F.struct(F.when(role != NO_ROLE, F.url_decode(role)).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def learned_text(formatted: str, loss: str) -> Column:
    """All text under the loss mask, unescaped."""
    texts = F.transform(loss, lambda s: unescape(F.substr(F.col(formatted), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(texts, "")


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from nothing but their text and mask."""
    turns = formatted.withColumns({"turns": read_turns("formatted"), "learned": learned_text("formatted", "loss")})
    lines = F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n")))
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def formatted_conversations(conversations: DataFrame, **options) -> DataFrame:
    """Format linear conversations, write them to a folder of the session's and read digests from there."""
    path = new_folder(conversations.sparkSession, "chats")
    format_chats(written(thread(conversations), "threads"), **options).write.parquet(path)
    return chat_digests(conversations.sparkSession.read.parquet(path))
