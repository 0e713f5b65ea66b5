"""Quotation linking of conversations, in DataFrame operations only.

A line's quote level is the number of ``>`` marks before its text. Consecutive lines of one level
form a passage (a blank line ends it). Passages and single lines are normalised (lower case, letters
and digits with single spaces) and hashed. The first message of a conversation whose own text has a
hash is its original; a later message that quotes it is linked. Among the originals of its level-1
quotes a message replies to the one with the most quoted characters (ties: the later turn); deeper
levels only count as links. Threads are the trees of replies; the order of a conversation is by
thread (its first turn) and then by turn, so a reply always follows what it answers, and a
conversation without quotes keeps its turns. Bodies are the lines outside quotes, without the
``On ... wrote:`` lines that introduce them.

Joins are by (conversation, hash) against one original each, and roots are found by pointer jumping
over (conversation, turn), so a conversation with a third of all messages is spread.

Defined cases: null or empty texts have no lines that link; messages with a null conversation or
turn are their own threads; rows equal in conversation, turn and text are one message when lines are
read, are ordered by their text's hash and share their links; of several originals the earliest turn is
linked; a body is the text itself where nothing is quoted, else its remaining lines joined by newlines
(also where carriage returns parted them); texts of any length are read whole; a table without rows
gives no rows; other columns pass through under any name, and columns that clash with the results are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from preftable.llm.scratch import staged
from preftable.operators.indexing import with_group_row_number

MARKS = r"^((?:[ \t]{0,3}>)+)"
HEADER = r"^On .* wrote:[ \t]*$"
RESULTS = ("n_quoted_lines", "max_level", "n_links", "parent_turn", "root_turn", "position", "body")


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[ \t]", ""))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n")


def units(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text_col: str = "text") -> DataFrame:
    """``conv, turn, level, hash, size``: every non-empty line and passage of every message, once."""
    rows = df.filter(F.col(conv).isNotNull() & F.col(turn).isNotNull()).select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.xxhash64(text_col).alias("m"), F.posexplode(_lines(F.col(text_col))).alias("at", "line"))
    rows = rows.repartition("conv", "turn", "m").dropDuplicates(["conv", "turn", "m", "at"])
    rows = rows.withColumn("level", _level(F.col("line"))).withColumn("norm", _normal(F.regexp_replace("line", MARKS, "")))
    # One message's lines: bounded by its text.
    own = Window.partitionBy("conv", "turn", "m").orderBy("at")
    rows = rows.withColumn("new", (F.col("norm") == "") | ~F.col("level").eqNullSafe(F.lag("level").over(own)) | (F.lag("norm").over(own) == ""))
    rows = rows.withColumn("run", F.sum(F.col("new").cast("int")).over(own))
    passages = rows.groupBy("conv", "turn", "m", "run", "level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "norm"))), lambda x: x["norm"]), " ").alias("norm"))
    both = rows.select("conv", "turn", "level", "norm").unionByName(passages.select("conv", "turn", "level", "norm")).filter("norm <> ''")
    return both.select("conv", "turn", "level", F.md5(F.col("norm").cast("binary")).alias("hash"), F.length("norm").alias("size")).distinct()


def links(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text_col: str = "text") -> DataFrame:
    """``conv, turn, level, original, size``: quoted lines and passages with the turn that wrote them."""
    found = staged(units(df, conv, turn, text_col), "quote-units")
    original = found.filter("level = 0").groupBy("conv", "hash").agg(F.min("turn").alias("original"))
    return found.filter("level > 0").join(original, ["conv", "hash"]).filter("original < turn").select("conv", "turn", "level", "original", "size")


def roots(parents: DataFrame) -> DataFrame:
    """``conv, turn, root`` for every replying message, by pointer jumping (rounds: log of the depth)."""
    now = staged(parents.select("conv", "turn", F.col("parent").alias("root")), "roots")
    while True:
        up = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"))
        moved = now.join(up, ["conv", "root"], "left").select("conv", "turn", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        now = staged(moved, "roots")
        if now.filter("moved").isEmpty():
            return now.select("conv", "turn", "root")


def conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text_col: str = "text") -> DataFrame:
    """Every message with ``n_quoted_lines, max_level, n_links, parent_turn, root_turn``, its ``position`` in
    the conversation's reply order (from 0) and its ``body`` without quotes."""
    given = df.drop(*RESULTS)
    base = given.select(F.struct(*[F.col(f"`{c}`") for c in given.columns]).alias("__row"), F.col(conv).alias("__conv"), F.col(turn).alias("__turn"), F.col(text_col).alias("__text"))
    columns, (conv, turn, text_col) = given.columns, ("__conv", "__turn", "__text")
    found = staged(links(base, conv, turn, text_col), "quote-links")
    scores = found.filter("level = 1").groupBy("conv", "turn", "original").agg(F.sum("size").alias("size"))
    parents = scores.groupBy("conv", "turn").agg(F.max(F.struct("size", "original"))["original"].alias("parent"))
    parents = staged(parents, "quote-parents")
    counts = found.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n_links"))
    tree = counts.join(parents, ["conv", "turn"], "left").join(roots(parents), ["conv", "turn"], "left")
    lines = _lines(F.col(text_col))
    quoted = F.filter(lines, lambda x: _level(x) > 0)
    body = F.filter(lines, lambda x: (_level(x) == 0) & ~x.rlike(HEADER))
    out = base.withColumn("n_quoted_lines", F.size(quoted)).withColumn("max_level", F.coalesce(F.array_max(F.transform(quoted, _level)), F.lit(0))).withColumn("body", F.when(F.col("n_quoted_lines") > 0, F.array_join(body, "\n")).otherwise(F.coalesce(F.col(text_col), F.lit(""))))
    tree = tree.select(F.col("conv").alias("__c"), F.col("turn").alias("__t"), "n_links", F.col("parent").alias("parent_turn"), F.col("root").alias("__root"))
    out = out.join(tree, (F.col(conv) == F.col("__c")) & (F.col(turn) == F.col("__t")), "left").drop("__c", "__t")
    out = out.withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))).withColumn("root_turn", F.coalesce("__root", turn)).drop("__root")
    keyed = out.withColumn("__m", F.xxhash64(text_col)).withColumn("__g", F.coalesce(F.col(conv).cast("string"), F.lit("null")))
    return with_group_row_number(keyed, ["__g"], ["root_turn", turn, "__m"], name="position").select(*[F.col(f"__row.`{c}`").alias(c) for c in columns], *RESULTS)
