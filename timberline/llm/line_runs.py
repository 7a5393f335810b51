"""Repeated runs of lines, by a suffix array over sequences of line ids; DataFrame functions alone.

Every document is a sequence of line ids. A line that occurs once can't be in a repeated run, so only
stretches of repeated lines are sorted. Prefix doubling ranks their suffixes by the first 1, 2, 4, ...
lines: each round sorts the distinct pairs (rank here, rank as many lines further) and numbers them.
Suffixes that share L lines, an interval of the suffix array with a common prefix of at least L, are
those that agree in the rank of 2^k lines at their start and in the one that ends with line L.

A run counts from ``min_words`` words on. It is the union of its shortest sufficient windows, those
that begin at a line and those that end at one, so only these windows are looked up; they bound the
rounds by log2(min_words). Where a window's interval has an earlier place, its lines are later copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import stage
from timberline.llm.quality import BLANK_RUN, BLANKS

#: The key of rows without an id: they come first.
NO_ID = -(1 << 63)
PLACE = ["doc", "digest"]
BROADCAST_NUMBERS = 4_000_000


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc and digest name a document; rows that repeat both are one document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text).alias("digest"),
        text.alias("text"),
    )


def line_table(docs: DataFrame) -> DataFrame:
    """doc, digest, i (number of the line), j (number among lines with a word), words, h1, h2.

    A line is told apart by two 64-bit hashes of its text without blanks around it.
    """
    trimmed = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("i"), F.btrim(line, F.lit(BLANKS)).alias("line")))
    rows = docs.select(*PLACE, F.posexplode(F.filter(trimmed, lambda x: x["line"] != "")).alias("j", "x"))
    line = F.col("x.line")
    return rows.select(
        *PLACE, F.col("x.i").alias("i"), "j",
        F.size(F.split(line, BLANK_RUN)).cast("long").alias("words"),
        F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"),
    )


def numbered(pairs: DataFrame, *by: str) -> DataFrame:
    """``pairs`` in order with a number that rises with it; written, so that it stays what it is."""
    return stage(pairs.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Lines that repeat, in stretches of neighbours with enough words, with their first rank."""
    often = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    ids = numbered(often, "h1", "h2")
    kept = lines.join(ids, ["h1", "h2"]).select(*PLACE, "i", "j", "words", "rank")
    kept = kept.dropDuplicates([*PLACE, "j"])  # a repeated row is one document
    in_doc = Window.partitionBy(*PLACE).orderBy("j")
    kept = kept.withColumn("s", F.col("j") - F.row_number().over(in_doc))
    whole = Window.partitionBy(*PLACE, "s")
    kept = kept.withColumn("total", F.sum("words").over(whole)).where(F.col("total") >= min_words)
    before = F.sum("words").over(whole.orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return kept.withColumn("after", before).withColumn("before", F.col("after") - F.col("words"))


def _doubled(suffixes: DataFrame, rounds: int) -> DataFrame:
    """``suffixes`` with r0, r1, ...: the rank among all suffixes by the first 1, 2, 4, ... lines.

    A suffix shorter than that, at the end of its stretch, sorts before all that go on.
    """
    state = suffixes.withColumnRenamed("rank", "r0")
    for k in range(rounds):
        further = F.lead(f"r{k}", 1 << k).over(Window.partitionBy(*PLACE, "s").orderBy("j"))
        state = state.withColumn("next", F.coalesce(further, F.lit(-1)))
        pairs = state.groupBy(F.col(f"r{k}").alias("a"), F.col("next").alias("b")).agg(F.count(F.lit(1)).alias("n")).drop("n")
        ranks = numbered(pairs, "a", "b").withColumnRenamed("rank", f"r{k + 1}")
        state = state.join(ranks, (F.col(f"r{k}") == F.col("a")) & (F.col("next") == F.col("b"))).drop("a", "b", "next")
        state = stage(state, "suffixes")
    return state


def _rank(k: Column, rounds: int) -> Column:
    return F.element_at(F.array(*(F.col(f"r{i}") for i in range(rounds + 1))), k + 1)


def removed_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, digest, removed array<int>, removed_words): lines that are later copies, by their number.

    The first place of a run, by doc_id and then line, stays. Lines are compared without blanks around
    them; lines without a word are passed over and stay. A document may repeat a run of its own.
    Rows that repeat an id and its text are one document; null ids come first; a null or empty text
    has no lines; an empty table gives no rows.
    """
    lines = stage(line_table(_keyed(docs, id_col, text_col)), "lines")
    start = stage(_stretches(lines, min_words), "stretches")
    by_start = Window.partitionBy(*PLACE, "s").orderBy("before").rangeBetween(0, min_words - 1)
    by_end = Window.partitionBy(*PLACE, "s").orderBy("after").rangeBetween(1 - min_words, 0)
    one = F.count(F.lit(1))
    sized = start.withColumns(
        {
            "forward": F.when(F.col("total") - F.col("before") >= min_words, one.over(by_start)),
            "backward": F.when(F.col("after") >= min_words, one.over(by_end)),
        }
    )
    longest = sized.agg(F.greatest(F.max("forward"), F.max("backward"))).head()[0] or 1
    rounds = longest.bit_length() - 1
    state = _doubled(sized, rounds)
    # A window: its first line, its number of lines, the power of two below that number.
    column = lambda kind: F.col(kind).cast("int")
    forward = state.select(*PLACE, "j", F.lit(0).alias("kind"), F.col("j").alias("first"), column("forward").alias("n"))
    backward = state.select(*PLACE, "j", F.lit(1).alias("kind"), (F.col("j") - column("backward") + 1).alias("first"), column("backward").alias("n"))
    windows = forward.union(backward).where("n is not null").withColumn("k", F.floor(F.log2("n")).cast("int"))
    windows = windows.withColumn("second", F.col("first") + F.col("n") - F.call_function("shiftleft", F.lit(1), F.col("k")))
    ranks = state.select(*PLACE, F.col("j").alias("at"), *(f"r{i}" for i in range(rounds + 1)))
    for name, side in (("first", "a"), ("second", "b")):
        windows = (
            windows.join(ranks.withColumnRenamed("at", name), [*PLACE, name])
            .withColumn(side, _rank(F.col("k"), rounds))
            .drop(*(f"r{i}" for i in range(rounds + 1)))
        )
    windows = stage(windows, "windows")
    place = F.struct("doc", "digest", "first")
    interval = ["kind", "n", "a", "b"]
    earliest = windows.groupBy(*interval).agg(F.min(place).alias("origin"), F.count(F.lit(1)).alias("times")).where("times > 1")
    copies = windows.join(earliest.drop("times"), interval).where(F.col("origin") < place)
    # Lines from the first of a window to its last are covered; reach over the lines of a document.
    marks = copies.select(*PLACE, "j", "kind", "first", (F.col("first") + F.col("n")).alias("end")).groupBy(*PLACE, "j").agg(
        F.max(F.when(F.col("kind") == 0, F.col("end"))).alias("end"), F.min(F.when(F.col("kind") == 1, F.col("first"))).alias("first")
    )
    along = Window.partitionBy(*PLACE).orderBy("j")
    covered = state.select(*PLACE, "i", "j", "words").join(marks, [*PLACE, "j"], "left").withColumns(
        {
            "reach": F.max("end").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "from": F.min("first").over(Window.partitionBy(*PLACE).orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        }
    )
    gone = covered.where((F.col("reach") > F.col("j")) | (F.col("from") <= F.col("j")))
    return gone.groupBy(*PLACE).agg(
        F.array_sort(F.collect_list("i")).alias("removed"), F.sum("words").alias("removed_words")
    )


def _without_lines(docs: DataFrame, columns: list[Column | str], min_words: int, id_col: str, text_col: str) -> DataFrame:
    """``columns`` of ``docs`` and _removed, _words of each row; nulls where nothing is removed."""
    gone = stage(removed_lines(docs, min_words, id_col, text_col), "removed")
    rows = docs.select(
        *columns,
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_doc"),
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_digest"),
    )
    # Lists of line numbers may be sent to all tasks up to 16 MB of them, counted; else rows are joined.
    size = gone.agg(F.sum(F.size("removed") + 8)).head()[0] or 0
    gone = gone.select(F.col("doc").alias("_doc"), F.col("digest").alias("_digest"), F.col("removed").alias("_removed"), F.col("removed_words").alias("_words"))
    return rows.join(F.broadcast(gone) if size <= BROADCAST_NUMBERS else gone, ["_doc", "_digest"], "left")


def line_dedup(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, lines with a word, lines and words removed, and the removed lines'
    numbers from 0, joined by commas. Texts aren't moved. Edge cases: see ``removed_lines``."""
    lines = F.size(F.filter(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    rows = _without_lines(docs, [F.col(id_col).cast("long").alias("doc_id"), lines.cast("long").alias("n_lines")], min_words, id_col, text_col)
    return rows.select(
        "doc_id", "n_lines",
        F.coalesce(F.size("_removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_words", F.lit(0)).alias("removed_words"),
        F.coalesce(F.array_join(F.col("_removed").cast("array<string>"), ","), F.lit("")).alias("removed"),
    )


def drop_repeated_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that are later copies; documents that consist of such lines go.

    Other columns stay, whatever their names.
    """
    rows = _without_lines(docs, [F.struct(*docs.columns).alias("_row")], min_words, id_col, text_col)
    own = F.col("_row")[text_col]
    lines = F.split(own, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_removed"))
    cut = rows.withColumn("_lines", F.when(F.col("_removed").isNotNull(), lines)).withColumn(
        "_left", F.when(F.col("_removed").isNotNull(), left)
    )
    # Kept lines by number: both columns are there, so nothing is split again for each line.
    short = F.array_join(F.transform("_left", lambda i: F.get(F.col("_lines"), i)), "\n")
    text = F.when(F.col("_removed").isNull(), own).otherwise(short)
    gone = F.col("_removed").isNotNull() & (F.btrim(F.col("_text"), F.lit(BLANKS)) == "")
    named = {c: F.col("_text") if c == text_col else F.col("_row")[c] for c in docs.columns}
    return cut.withColumn("_text", text).where(~gone).select(*(c.alias(n) for n, c in named.items()))
