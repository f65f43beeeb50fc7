"""Chat formatting of reply trees with DataFrame functions only.

Messages that answer messages form trees. Iterative self-joins double the distance that each message can look up its
ancestors, so all root-to-leaf paths are listed in a number of rounds that grows with the logarithm of the depth.
Branches are ranked by score and each chosen path becomes one conversation in one template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import save

# The marks of the template, by role; a role of another name is written between [ROLE] and [/ROLE].
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]", "</ROLE>")
# Control strings that start with < and with [, less that first character.
ANGLE, SQUARE = r"<SYS>>|</SYS>>|/?s>|/ROLE>", r"/?INST\]|/?ROLE\]"


def escape(text: Column) -> Column:
    """Texts without control strings; unescape() gives the original back. Only control strings and look-alikes of escapes change."""
    out = F.regexp_replace(text, "&(amp|lt|#91);", "&amp;$1;")
    out = F.regexp_replace(out, f"<({ANGLE})", "&lt;$1")
    return F.regexp_replace(out, rf"\[({SQUARE})", "&#91;$1")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&#91;"), F.lit("[")), F.lit("&amp;"), F.lit("&"))


def _by_role(role: Column, of) -> Column:
    out = None
    for name, marks in MARKS.items():
        out = (out.when if out is not None else F.when)(role == name, of(marks))
    return out


def paths(messages: DataFrame) -> DataFrame:
    """messages (conv_id, msg_id, parent_id, ...) -> (conv_id, leaf, msg_id, up): every message of every root-to-leaf path.

    up is the number of steps from the leaf. A parent that isn't there makes a root. Messages on a cycle have no root,
    and leaves that lead into one are left out. Rows double the reach each round; the result has one row for each
    message of a path, and nothing larger is built.
    """
    nodes = messages.select("conv_id", "msg_id", "parent_id")
    known = nodes.select("conv_id", F.col("msg_id").alias("parent_id"), F.lit(True).alias("found"))
    nodes = save(nodes.join(known, ["conv_id", "parent_id"], "left").select("conv_id", "msg_id", F.when(F.col("found"), F.col("parent_id")).alias("above")), "nodes")
    jump = nodes.where("above is not null")
    leaves = nodes.join(jump.select("conv_id", F.col("above").alias("msg_id")).distinct(), ["conv_id", "msg_id"], "left_anti")
    found = save(leaves.select("conv_id", F.col("msg_id").alias("leaf"), "msg_id", F.lit(0).cast("long").alias("up")), "paths")
    reach, rows, left = 1, nodes.count(), jump.count()
    while left and reach <= 2 * rows:
        step = found.join(jump, ["conv_id", "msg_id"]).select("conv_id", "leaf", F.col("above").alias("msg_id"), (F.col("up") + reach).alias("up"))
        found = save(found.union(step), "paths")
        twice = jump.select("conv_id", F.col("msg_id").alias("from"), F.col("above").alias("msg_id")).join(jump, ["conv_id", "msg_id"])
        jump = save(twice.select("conv_id", F.col("from").alias("msg_id"), "above"), "jumps")
        reach, left = reach * 2, jump.count()
    endless = found.join(jump.select("conv_id", "msg_id").distinct(), ["conv_id", "msg_id"]).select("conv_id", "leaf").distinct() if left else None
    return found.join(endless, ["conv_id", "leaf"], "left_anti") if endless is not None else found


def format_trees(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """messages (conv_id, msg_id, parent_id, role, text, score, ...) -> one formatted conversation for each chosen path.

    Returns conv_id, branch (rank from 1 by mean score, then smaller leaf), leaf, branch_score, formatted, and loss_spans:
    the code point ranges (start, end) of assistant texts in formatted. branches: how many of each tree are formatted (all
    if None). Rows without conv_id are one conversation, whose conv_id is null; msg_id must be unique within a
    conversation, and rows where it is null are left out. Null text, role or score:
    empty, empty, 0. An empty text is a turn like any other. Other columns are not read. An empty table gives an empty result.
    """
    told = messages.where("msg_id is not null").select(
        F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv_id"), F.col("msg_id").cast("long").alias("msg_id"), F.col("parent_id").cast("long").alias("parent_id"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    told = save(told, "messages")
    listed = paths(told)
    scored = listed.join(told.select("conv_id", "msg_id", "score"), ["conv_id", "msg_id"]).groupBy("conv_id", "leaf").agg(F.avg("score").alias("branch_score"))
    ranked = scored.withColumn("branch", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("branch_score"), "leaf")))
    chosen = ranked if branches is None else ranked.where(F.col("branch") <= branches)
    role, text = F.col("role"), escape(F.col("text"))
    opening = F.coalesce(_by_role(role, lambda m: F.lit(m[0])), F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1])))
    closing = F.coalesce(_by_role(role, lambda m: F.lit(m[1])), F.lit(OTHER[2]))
    turns = told.select("conv_id", "msg_id", role, opening.alias("opening"), text.alias("body"), closing.alias("closing"))
    turns = listed.join(chosen, ["conv_id", "leaf"]).join(turns, ["conv_id", "msg_id"])
    size = F.length("opening") + F.length("body") + F.length("closing")
    order = Window.partitionBy("conv_id", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(size.cast("long")).over(order), F.lit(0).cast("long")) + F.length("opening"))
    turns = turns.groupBy("conv_id", "branch", "leaf", "branch_score").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("k"), "role", F.concat("opening", "body", "closing").alias("turn"), "at", (F.col("at") + F.length("body")).alias("to")))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["at"].alias("start"), t["to"].alias("end")))
    conv_id = F.when(F.col("conv_id") != "", F.col("conv_id").cast("long")).alias("conv_id")
    return turns.select(conv_id, "branch", "leaf", "branch_score", F.concat_ws("", F.transform("turns", lambda t: t["turn"])).alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    body = "(?s)" + "|".join(f"{a}.*?{b}" for a, b in [("<<SYS>>", "<</SYS>>"), (r"\[INST\]", r"\[/INST\]"), ("<s>", "</s>"), (r"\[ROLE\].*?\[/ROLE\]", "</ROLE>")])
    turns = F.regexp_extract_all(formatted, F.lit(f"({body})"), F.lit(1))

    def parse(turn: Column) -> Column:
        cut = lambda a, b: F.substring(turn, F.lit(len(a) + 1), F.length(turn) - len(a) - len(b))
        starts = {name: turn.startswith(marks[0]) for name, marks in MARKS.items()}
        role = F.when(starts["system"], "system").when(starts["user"], "user").when(starts["assistant"], "assistant")
        text = F.when(starts["system"], cut(*MARKS["system"])).when(starts["user"], cut(*MARKS["user"])).when(starts["assistant"], cut(*MARKS["assistant"]))
        rest = cut(OTHER[0], OTHER[2])
        edge = F.locate(OTHER[1], rest)
        role = F.coalesce(role, unescape(F.substring(rest, F.lit(1), edge - 1)))
        text = F.coalesce(text, F.substring(rest, edge + len(OTHER[1]), F.length(rest)))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(turns, parse)


def digest(formatted: DataFrame) -> DataFrame:
    """Adds what can be read back from format_trees' output: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = read_back(F.col("formatted"))
    loss = F.concat_ws("", F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))))
    out = formatted.withColumn("turns", turns).withColumn("loss", loss)
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def threads(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, ...) as messages: each row answers the one before it (by turn, role, text; null turns first)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", "turn", "role", "text").withColumn("msg_id", F.row_number().over(order).cast("long"))
    return numbered.select("conv_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))
