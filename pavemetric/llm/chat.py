"""Chat formatting: reply trees to root-to-leaf paths, ranked branches, one conversation of text for each chosen path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import remove, saved_at

#: A turn is OPEN, its role, a new line, its text and CLOSE. In roles and texts the pairs of ESCAPES stand for the control strings.
OPEN, CLOSE, LOSS_ROLE = "<turn>", "</turn>", "assistant"
ESCAPES = [(OPEN, "<\\turn>"), (CLOSE, "<\\/turn>")]
ROLE_ESCAPES = [*ESCAPES, ("\n", "\\n")]
KEY = ["conv_id", "msg_id"]


def escaped(text: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    """text without control strings: backslashes doubled, then each control string replaced by one with a lone backslash."""
    for plain, written in [("\\", "\\\\"), *pairs]:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    """The inverse of escaped: between doubled backslashes, taken from the left, a lone one belongs to a control string."""

    def part(p: Column) -> Column:
        for plain, written in pairs:
            p = F.replace(p, F.lit(written), F.lit(plain))
        return p

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def linear_replies(turns: DataFrame) -> DataFrame:
    """Messages conv_id, msg_id, parent_id, role, text, score of conversations (conv_id, turn, role, text) without branches.

    A conversation's rows stand by turn (null last), then role, then text; each replies to the one before. Rows with a null
    conv_id are one conversation. Null role and text are empty.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")).cast("long")
    return t.withColumn("msg_id", n).select(*KEY, F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def distinct_messages(messages: DataFrame) -> DataFrame:
    """One message for each (conv_id, msg_id): of several the one with the smallest parent, role, text and score; nulls come first."""
    best = F.min(F.struct(F.col("parent_id").cast("long").alias("parent_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    return messages.where("msg_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id"), F.col("msg_id").cast("long").alias("msg_id")).agg(best.alias("m")).select(*KEY, "m.*")


def _same(left: DataFrame, right: DataFrame, node: str) -> Column:
    return left["conv_id"].eqNullSafe(right["k_conv"]) & (left[node] == right["k_msg"])


def _keyed(df: DataFrame, **columns: str) -> DataFrame:
    return df.select(F.col("conv_id").alias("k_conv"), F.col("msg_id").alias("k_msg"), *[F.col(c).alias(n) for n, c in columns.items()])


def lifts(messages: DataFrame) -> tuple[list[DataFrame], DataFrame, list[str]]:
    """What self-joins of messages find, joining ways of length 1, 2, 4 ... with themselves until none goes further.

    Tables k: (conv_id, msg_id, up, total, depth) of messages with 2**(k-1) above them or more (0: all): the ancestor 2**k replies
    above, null beyond the root; the sum of the scores of the 2**k messages from msg_id, fewer at the root, and how many these are.
    Then (conv_id, msg_id, depth, total) of messages whose replies lead to a root, over the whole way. Last the tables' places.
    """
    known = _keyed(messages)
    # a parent that isn't there, or the message itself, makes a root
    now = messages.select(*KEY, F.when(F.col("parent_id") != F.col("msg_id"), F.col("parent_id")).alias("up"), F.col("score").alias("total"))
    now = now.join(known, _same(now, known, "up"), "left").select(*KEY, F.col("k_msg").alias("up"), "total", F.lit(1).cast("long").alias("depth"))
    # without circles no way is longer than the largest conversation has messages
    longest = messages.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    tables, places, ended, size = [], [], None, 1
    while True:
        now, at = saved_at(now, "reply-lift")
        tables.append(now)
        places.append(at)
        done, now = now.where("up is null"), now.where("up is not null")
        ended = done if ended is None else ended.unionByName(done)
        if size > longest or now.isEmpty():
            return tables, ended.select(*KEY, "depth", "total"), places
        size *= 2
        above = _keyed(now.unionByName(ended), k_up="up", k_total="total", k_depth="depth")
        joined = now.join(above, _same(now, above, "up"), "left")
        more = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
        now = joined.select(*KEY, F.col("k_up").alias("up"), more("total", "k_total"), more("depth", "k_depth"))


def reply_paths(messages: DataFrame, branches: int | None = 1) -> tuple[DataFrame, list[str]]:
    """(conv_id, branch, pos, msg_id): the messages of the chosen root-to-leaf paths, and the places of the tables below it.

    messages (conv_id, msg_id, parent_id, score) with one row for each conv_id and msg_id. A conversation's paths rank by the mean
    score of their messages, then the longer one, then the smaller leaf; the first `branches` are chosen (None: all), numbered
    from 1. A message whose replies run in a circle lies on no path.
    """
    tables, ends, places = lifts(messages.select(*KEY, "parent_id", "score"))
    parents = tables[0].where("up is not null").select(F.col("conv_id").alias("k_conv"), F.col("up").alias("k_msg")).distinct()
    leaves = ends.join(parents, _same(ends, parents, "msg_id"), "left_anti")
    order = Window.partitionBy("conv_id").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "msg_id")
    ranked = leaves.withColumn("branch", F.row_number().over(order))
    chosen = ranked if branches is None else ranked.where(F.col("branch") <= branches)
    # a way of 2**(k+1) messages is two of 2**k; pos counts from the root
    ways = chosen.select("conv_id", "branch", F.col("depth").alias("pos"), "msg_id")
    for table in reversed(tables[:-1]):
        up = _keyed(table.where("up is not null"), k_up="up", k_depth="depth")
        joined = ways.join(up, _same(ways, up, "msg_id"), "left")
        halves = F.array(F.struct("pos", "msg_id"), F.struct((F.col("pos") - F.col("k_depth")).alias("pos"), F.col("k_up").alias("msg_id")))
        ways = joined.select("conv_id", "branch", F.inline(F.filter(halves, lambda h: h["msg_id"].isNotNull())))
    return ways, places


def formatted(messages: DataFrame, branches: int | None = 1, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, branch, text and loss of each chosen path (see reply_paths) of a written table of messages.

    text: its turns one after another; loss: the spans (start, length; code points of text, from 0) of what turns of
    loss_role say. Only ids move while paths are found; a path's turns meet in one row, which is the conversation.
    """
    ways, places = reply_paths(messages, branches)
    parts = messages.select(F.col("conv_id").alias("k_conv"), F.col("msg_id").alias("k_msg"), (F.col("role") == loss_role).alias("loss"), F.concat(F.lit(OPEN), escaped(F.col("role"), ROLE_ESCAPES), F.lit("\n")).alias("head"), escaped(F.col("text")).alias("body"))
    turns = ways.join(parts, _same(ways, parts, "msg_id"))
    size = F.length("head") + F.length("body") + len(CLOSE)
    start = F.sum(size).over(Window.partitionBy("conv_id", "branch").orderBy("pos")) - size + F.length("head")
    turns = turns.select("conv_id", "branch", "pos", F.concat("head", "body", F.lit(CLOSE)).alias("turn"), F.when(F.col("loss"), F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("length"))).alias("span"))
    rows = turns.groupBy("conv_id", "branch").agg(F.array_sort(F.collect_list(F.struct("pos", "turn", "span"))).alias("t"))
    spans = F.filter(F.transform("t", lambda t: t["span"]), lambda s: s.isNotNull())
    out, _ = saved_at(rows.select("conv_id", "branch", F.array_join(F.transform("t", lambda t: t["turn"]), "").alias("text"), spans.alias("loss")), "chat")
    remove(messages.sparkSession, *places)
    return out


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(text, CLOSE, -1), lambda p: p != "")
    body = F.lit(len(OPEN) + 1)

    def turn(p: Column) -> Column:
        line = F.substring_index(p, "\n", 1)
        return F.struct(unescaped(F.substr(line, body), ROLE_ESCAPES).alias("role"), unescaped(F.substr(p, F.length(line) + 2)).alias("text"))

    return F.transform(pieces, turn)


def masked_text(text: Column, loss: Column) -> Column:
    """What lies under the loss mask, span after span, as it was before escaping."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def format_trees(messages: DataFrame, branches: int | None = 1, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, branch, text and loss of the chosen paths of messages (conv_id, msg_id, parent_id, role, text, score).

    Null role, text and score: empty and 0; null msg_id: left out, as nobody can reply to it; null conv_id: one conversation. Of
    rows with one msg_id one stays (see distinct_messages). A parent that isn't there makes a root, so a conversation may have
    several. Other columns are ignored; an empty table gives an empty one.
    """
    rows, at = saved_at(distinct_messages(messages), "messages")
    out = formatted(rows, branches, loss_role)
    remove(messages.sparkSession, at)
    return out


def format_turns(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, branch (1), text and loss of conversations (conv_id, turn, role, text); see linear_replies. Every row is kept."""
    rows, at = saved_at(linear_replies(turns), "messages")
    out = formatted(rows, None, loss_role)
    remove(turns.sparkSession, at)
    return out


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and branch, all read from text and loss."""
    read = chats.withColumn("turns", read_turns(F.col("text"))).withColumn("masked", masked_text(F.col("text"), F.col("loss")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(lines).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"), sha(F.col("masked")).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"), F.col("branch").cast("long").alias("branch"))
