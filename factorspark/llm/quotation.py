"""Chat formatting by quotation linking, in DataFrame functions.

Every line of a message has a quote level, the number of its leading ``>``. Passages are lines of some length, and paragraphs of any
length: neighbouring lines of one level without an empty one between, put together, so that short answers and quotations wrapped
anew are found as well. Quoted passages are normalised and hashed and joined to the earliest earlier message of the conversation that
says the same in its own words. The message whose passages a message quotes most at the lowest level is the one it replies to. Depths and thread roots come from pointer doubling, and
each conversation is put in reply order: by the first message of the thread, then the depth, then the turn. Texts come out
without quotes and attribution lines, and as formatted chat turns.

Originals are reduced to one row for each conversation and passage before the join and sent for those that are quoted only; quoting rows
are salted. Places in a conversation come from a range partitioning of the whole order, so one conversation may hold
any share of the rows; nothing is collected for a conversation or a message.

Defined cases: a null or empty text has no passages and stays as it is. A message without a linked quotation starts a thread of its own.
A quotation of nothing said before links nothing, and is taken out all the same. Rows that repeat are kept, each
with a place; a turn that occurs more than once replies to the smallest of the turns its rows reply to. Null conversations or turns link to
nothing and are ordered first. A passage said more than once belongs to the earliest turn. An empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

LEVELS = r"^[ \t]*((?:>[ \t]?)+)"
ATTRIBUTION = r"^(?:On\b.{0,200}\bwrote|.{0,80} schrieb am .{0,80}|Le\b.{0,200} a écrit ?|El\b.{0,200} escribió):[ \t]*$"
#: Characters that a line must have to be a passage without the rest of its paragraph.
LEAST = 12
#: A paragraph among lines written as level, bar, text. The possessive repetitions neither backtrack nor recurse.
PARAGRAPH = r"(?m)^(\d+)\|[^\n]++(?:\n\1\|[^\n]++)*+"
#: Parts of the quoting rows of one passage.
SALTS = 8
DOUBLINGS = 64


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, LEVELS, 1), r"[^>]", ""))


def normalised(line: Column) -> Column:
    """Without quote marks, in lower case, white space as single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, LEVELS, "")), r"[ \t\r\f\x0B]+", " "))


def unquoted(text: Column) -> Column:
    """The text's own lines, without quotes, attribution lines and the empty lines they leave at either end."""
    own = F.filter(F.split(text, "\n", -1), lambda x: ~F.regexp_like(x, F.lit(LEVELS)) & ~F.regexp_like(x, F.lit(ATTRIBUTION)))
    return F.when(F.regexp_like(text, F.lit(f"(?m){LEVELS}")), F.regexp_replace(F.array_join(own, "\n"), r"^\n+|\n+\z", "")).otherwise(text)


def formatted(role: Column, text: Column) -> Column:
    """A turn between role marks."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>"))


def passages(text: Column) -> Column:
    """Array of ``level, passage`` of a text: its long lines, and its paragraphs that are more than one of them."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.struct(level(x).alias("level"), normalised(x).alias("passage")))
    marked = F.array_join(F.transform(lines, lambda x: F.concat(x["level"].cast("string"), F.lit("|"), x["passage"])), "\n")
    runs = F.transform(F.regexp_extract_all(marked, F.lit(PARAGRAPH), F.lit(0)), lambda x: F.struct(
        F.substring_index(x, "|", 1).cast("int").alias("level"), F.trim(F.regexp_replace(x, r"(?:^|\n)\d+\|", " ")).alias("passage"), F.contains(x, F.lit("\n")).alias("wrapped")))
    runs = F.filter(runs, lambda x: x["wrapped"] | (F.length(x["passage"]) < LEAST))
    return F.concat(F.filter(lines, lambda x: F.length(x["passage"]) >= LEAST), F.transform(runs, lambda x: F.struct(x["level"].alias("level"), x["passage"].alias("passage"))))


def _passages(messages: DataFrame) -> DataFrame:
    found = messages.select("conv_id", "turn", F.explode(passages(F.col("text"))).alias("p")).select("conv_id", "turn", "p.level", "p.passage")
    return found.select("conv_id", "turn", "level", F.xxhash64("passage").alias("hash"), F.length("passage").alias("size"))


def links(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, parent_turn`` of the turns whose quotations were said before, one row each."""
    messages = messages.where("conv_id is not null and turn is not null")
    with_quotes = messages.where(F.regexp_like("text", F.lit(f"(?m){LEVELS}")))
    quoted = durable(_passages(with_quotes).where("level > 0"), "quoted")
    wanted = quoted.select("conv_id", "hash").distinct()
    said = _passages(messages).where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    said = said.join(wanted, ["conv_id", "hash"], "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = quoted.withColumn("salt", F.pmod(F.hash("turn"), F.lit(SALTS))).join(said, ["conv_id", "hash", "salt"]).where("source < turn")
    votes = rows.groupBy("conv_id", "turn", "level", "source").agg(F.sum("size").alias("votes"))
    # The lowest level first, then the most quoted, then the latest.
    best = F.max_by("source", F.struct(-F.col("level"), F.col("votes"), F.col("source")))
    return votes.groupBy("conv_id", "turn").agg(best.alias("parent_turn"))


def threads(linked: DataFrame) -> DataFrame:
    """``conv_id, turn, parent_turn, root_turn, depth``: each doubling joins every turn's ancestor to that one's ancestor."""
    state = durable(linked.select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("open")), "threads")
    for _ in range(DOUBLINGS):
        if state.where("open").isEmpty():
            return state.drop("open")
        above = state.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("above"), F.col("depth").alias("more"))
        state = durable(state.join(above, ["conv_id", "root_turn"], "left").select(
            "conv_id", "turn", "parent_turn", F.coalesce("above", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("above").isNotNull().alias("open")), "threads")
    raise RuntimeError("threads did not settle")


def placed(rows: DataFrame, group: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """``rows`` with ``place``, from 1, within ``group`` in the given order; a group is split where the range partitioning splits it."""
    count = partitions or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = durable(rows.repartitionByRange(count, group, *order).withColumn("_part", F.spark_partition_id()), "placed")
    local = Window.partitionBy("_part", group).orderBy(*order)
    sizes = dealt.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_local", F.row_number().over(local))
    ranked = ranked.join(sizes, (ranked["_part"] == sizes["_of"]) & ranked[group].eqNullSafe(sizes["_group"]))
    return ranked.select(*rows.columns, (F.col("_before") + F.col("_local")).cast("long").alias("place"))


def conversations(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, parent_turn, root_turn, depth, place, chat`` of every message, in reply order by ``place``."""
    rows = messages.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"))
    found = threads(links(rows))
    # One row for each linked turn; turns that repeat take the same one.
    out = rows.join(found, ["conv_id", "turn"], "left")
    out = out.select("conv_id", "turn", "role", unquoted(F.col("text")).alias("text"), "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
    out = placed(out, "conv_id", ["root_turn", "depth", "turn", "role", "text"])
    return out.withColumn("chat", formatted(F.col("role"), F.col("text")))
