"""Reply trees to training conversations: root-to-leaf paths by iterative self-joins, ranked, each formatted once.

A message points to its parent. Pointer doubling finds for every message its root and the sum of scores above it in
log2(depth) self-joins; leaves are then ranked, and the chosen leaves collect their ancestors by the
same doubled pointers, so a path of 1,000 turns costs ten joins and not a thousand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.llm.storage import cut

BEGIN, END = "<s>", "</s>"
#: Strings with a meaning in chat templates; in texts they get a ~ behind their first character, or one more.
_CONTROL = r"([<\[])(~*)(/?s>|/?INST\]|/?<SYS>>|<SYS>>|</SYS>>|\|)"
_ESCAPED = r"([<\[])~(~*)(/?s>|/?INST\]|/?<SYS>>|<SYS>>|</SYS>>|\|)"


def escape(text: Column) -> Column:
    """No control string is left in the result, and unescape gives the text back."""
    return F.regexp_replace(text, _CONTROL, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _marked(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN), _escape_role(turn["role"]), F.lit("\n"), escape(turn["text"]), F.lit(END + "\n"))


def formatted(turns: Column) -> Column:
    """One string from array<struct<role, text>>: <s>role, newline, text, </s>, newline for each turn."""
    return F.concat_ws("", F.transform(turns, _marked))


def loss_spans(turns: Column, loss_role: str) -> Column:
    """array<struct<start, length>> in code points of formatted(turns): the texts of the role that is learned, escapes included."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = F.length(_escape_role(t["role"])) + len(BEGIN) + 1
        n = F.length(escape(t["text"])).cast("long")
        span = F.struct((acc["at"] + head).cast("long").alias("start"), n.alias("length"))
        spans = F.when(t["role"] == loss_role, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + head + n + len(END) + 1).cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def parsed(text: Column) -> Column:
    """The turns read back from a formatted string."""
    parts = F.slice(F.split(text, END + "\n", -1), 1, F.greatest(F.size(F.split(text, END + "\n", -1)) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        body = F.substring(p, F.lit(len(BEGIN) + 1), F.length(p))
        role = F.substring_index(body, "\n", 1)
        return F.struct(_unescape_role(role).alias("role"), unescape(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"))

    return F.transform(parts, turn)


def masked_text(text: Column, spans: Column) -> Column:
    """What the loss mask covers, unescaped and joined without anything between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))))


def best_paths(
    messages: DataFrame,
    *,
    tree_col: str = "tree_id",
    id_col: str = "message_id",
    parent_col: str = "parent_id",
    role_col: str = "role",
    text_col: str = "text",
    score_col: str | None = "score",
    top: int | None = None,
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per chosen root-to-leaf path: tree_col, leaf, rank, n_turns, score, formatted, loss_spans.

    A branch's score is the mean of its messages' scores (null or no score: 0); branches of a tree are ranked by it,
    equal ones by leaf id; top keeps the best so many, None all. A message whose parent is null or not in its tree is a
    root. Null roles and texts count as empty. A null tree is a tree. Ids are unique in a tree and not null; of rows that repeat
    an id the one with the least (parent, role, text) counts. Messages on or under a cycle have no root and belong to no
    path. An empty table gives an empty table; other columns are ignored.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    key = F.concat(F.when(F.col(tree_col).isNull(), "-").otherwise("+"), F.coalesce(F.col(tree_col).cast("string"), F.lit("")))
    score = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    a = messages.select(
        key.alias("tree"), F.col(id_col).alias("id"), F.struct(F.col(parent_col).alias("parent"), text(role_col).alias("role"), text(text_col).alias("text"), score.alias("score")).alias("of"), F.col(tree_col).alias("name")
    ).where("id is not null")
    a = cut(a.groupBy("tree", "id").agg(F.min("of").alias("of"), F.min("name").alias("name")).select("tree", "id", "name", "of.*"))
    there = a.select("tree", F.col("id").alias("parent"), F.lit(True).alias("known"))
    tied = a.select("tree", "id", "parent", "score").join(there, ["tree", "parent"], "left")
    jump = cut(tied.select("tree", "id", F.when(F.col("known"), F.col("parent")).alias("to"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("n")))

    # jumps[k] leads 2**k messages up; a message whose jump is null has its root inside the sum and is settled, so
    # that each step only moves the messages that lie deeper than the steps so far
    settled, rising = [jump.where("to is null")], jump.where("to is not null")
    jumps, open_rows = [rising.select("tree", "id", "to")], None
    while True:
        now = rising.count()
        if not now or now == open_rows:  # nothing left, or only cycles
            break
        open_rows = now
        up = rising
        for part in settled:
            up = up.union(part)
        up = up.select("tree", F.col("id").alias("to"), F.col("to").alias("next"), F.col("sum").alias("more"), F.col("n").alias("above"))
        risen = rising.join(up, ["tree", "to"], "left").select("tree", "id", F.col("next").alias("to"), (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("sum"), (F.col("n") + F.coalesce("above", F.lit(0))).alias("n"))
        risen = cut(risen)
        settled.append(risen.where("to is null"))
        rising = risen.where("to is not null")
        jumps.append(rising.select("tree", "id", "to"))
    rooted = settled[0]
    for part in settled[1:]:
        rooted = rooted.union(part)
    parents = cut(tied.where("known").select("tree", F.col("parent").alias("id")).distinct())  # once, not for each settled part
    leaves = rooted.join(parents, ["tree", "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("score").desc(), "id"))
    leaves = leaves.select("tree", "id", (F.col("sum") / F.col("n")).alias("score"), "n").withColumn("rank", rank)
    if top is not None:
        leaves = leaves.where(F.col("rank") <= top)
    leaves = cut(leaves)

    # every chosen leaf with its ancestors: what is within 2**k of the leaf, then 2**k further up from each of those
    path = leaves.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up"))
    for k, j in enumerate(jumps):
        path = cut(path.union(path.join(j, ["tree", "id"]).select("tree", "leaf", F.col("to").alias("id"), (F.col("up") + (1 << k)).alias("up"))))
    turns = path.join(a.select("tree", "id", "name", "role", "text"), ["tree", "id"]).groupBy("tree", "leaf").agg(
        F.min("name").alias("name"), F.transform(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("o"), "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns")
    )
    done = turns.join(leaves.select("tree", F.col("id").alias("leaf"), "score", "rank", "n"), ["tree", "leaf"])
    return done.select(F.col("name").alias(tree_col), "leaf", "rank", F.col("n").alias("n_turns"), "score", formatted(F.col("turns")).alias("formatted"), loss_spans(F.col("turns"), loss_role).alias("loss_spans"))


def threads(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Linear conversations as reply trees: each row answers the one before it in its conversation by (turn, role, text)."""
    over = Window.partitionBy(conv_col).orderBy(F.col(turn_col).asc_nulls_first(), F.col(role_col).asc_nulls_first(), F.col(text_col).asc_nulls_first())
    at = F.row_number().over(over).cast("long")
    return rows.select(F.col(conv_col).alias("tree_id"), at.alias("message_id"), F.when(at > 1, at - 1).alias("parent_id"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
