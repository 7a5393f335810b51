"""Quality rules with host-level verdicts, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import checked_broadcast, either, stage

#: Fixed: the characters between words, and the symbols that are counted.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _pairs(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))


def text_measures(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", keys: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, host, ``keys`` as they are, and the counts of a whole text; null text counts as empty, null host stays.

    ``n_repeat_words`` counts the words in five-word windows that occur twice or more in the text.
    Windows are told apart by 64-bit hashes within one text. Everything is computed inside the row.
    """
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(host_col).cast("string").alias("host"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *keys,
    )
    trimmed = F.btrim("text", F.lit(BLANKS))
    cut = base.select(
        "doc_id",
        "host",
        *keys,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN)).alias("words"),
        F.length(without(F.col("text"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "").alias("lines"),
        (F.length("text") - F.length(without(F.col("text"), UPPER))).cast("long").alias("n_upper"),
    )
    hashed = cut.select(
        "doc_id", "host", *keys, "word_chars", "n_symbols", "n_upper",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    n = F.col("n_words").cast("int")
    kept = [c for c in hashed.columns if c != "h"]
    two = hashed.select(*kept, "h", F.when(n >= 5, _pairs(F.slice("h", 1, n - 1), F.slice("h", 2, n - 1))).alias("h2"))
    four = two.select(*kept, "h", F.when(n >= 5, _pairs(F.slice("h2", 1, n - 3), F.slice("h2", 3, n - 3))).alias("h4"))
    five = four.select(*kept, F.when(n >= 5, _pairs(F.slice("h4", 1, n - 4), F.slice("h", 5, n - 4))).alias("windows"))
    # Few texts repeat a window; only those sort theirs.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    ordered = five.select(*kept, F.when(repeats, F.array_sort(placed)).alias("sorted"))
    at = F.col("sorted")
    twice = ordered.select(
        *kept,
        F.array_sort(
            F.transform(
                F.filter(at, lambda x, i: either(*(F.get(at, i + k)["w"].eqNullSafe(x["w"]) for k in (-1, 1)))),
                lambda x: x["i"],
            )
        ).alias("places"),
    )
    places = F.col("places")
    steps = F.transform(places, lambda p, i: F.least(F.lit(5), F.coalesce(F.get(places, i + 1) - p, F.lit(5))))
    total = F.aggregate(steps, F.lit(0), lambda a, b: a + b).cast("long")
    return twice.select(*kept, F.coalesce(total, F.lit(0).cast("long")).alias("n_repeat_words"))


#: Names of the rules that count for hosts.
HOST_RULES = ("symbols", "symbols_heavy", "dup_lines", "word_length", "shouting")


def host_rules() -> dict[str, Column]:
    """Whether a document fails each rule; comparisons of whole numbers."""
    words = F.col("n_words")
    return {
        "symbols": 10 * F.col("n_symbols") > words,
        "symbols_heavy": F.col("n_symbols") > words,
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": either(F.col("word_chars") < 2 * words, F.col("word_chars") > 15 * words),
        "shouting": 2 * F.col("n_upper") > F.col("word_chars"),
    }


def host_rates(flags: DataFrame, z: float = 2.0) -> DataFrame:
    """(host, rule, overall, mean, lower): each host's failure rate, shrunk to all hosts' rate, and a lower bound.

    ``flags``: host and a boolean column for each rule. The beta prior of a rule is fitted to the
    hosts by moments: its mean is the overall rate, its strength follows from how much hosts differ
    beyond chance. The bound is ``z`` standard deviations below the posterior mean. Documents
    without a host are one host. Equal rows count each, hosts with equal rates are treated alike, an
    empty table gives no rows.
    """
    n = F.count(F.lit(1)).alias("n")
    by_host = flags.groupBy("host").agg(n, *(F.sum(F.col(r).cast("long")).alias(r) for r in HOST_RULES))
    long = by_host.select("host", "n", F.explode(F.create_map(*(x for r in HOST_RULES for x in (F.lit(r), F.col(r))))).alias("rule", "bad"))
    sums = long.groupBy("rule").agg(F.sum("n").alias("total"), F.sum("bad").alias("bads"), F.count(F.lit(1)).alias("hosts"))
    sums = sums.withColumn("m", (F.col("bads") + 0.5) / (F.col("total") + 1.0))
    spread = (
        long.join(F.broadcast(sums), "rule")  # a row per rule
        .groupBy("rule", "total", "hosts", "m")
        .agg(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2)).alias("v"))
    )
    chance = F.col("m") * (1 - F.col("m"))
    between = F.greatest(F.col("v") / F.col("total") - chance * F.col("hosts") / F.col("total"), F.lit(1e-6))
    prior = spread.select("rule", "m", F.least(F.greatest(chance / between - 1, F.lit(2.0)), F.lit(1000.0)).alias("strength"))
    a = F.col("bad") + F.col("m") * F.col("strength")
    both = F.col("n") + F.col("strength")
    mean = a / both
    return long.join(F.broadcast(prior), "rule").select(
        "host", "rule", F.col("m").alias("overall"), mean.alias("mean"), (mean - z * F.sqrt(mean * (1 - mean) / (both + 1))).alias("lower")
    )


def quality_rules(docs: DataFrame, times: float = 2.0, z: float = 2.0, keys: tuple[str, ...] = (), **columns: str) -> DataFrame:
    """A row per document: its counts, its failed rules, its host's verdict, whether it is kept, and for
    each rule the host's posterior rate and its bound (``mean_..``, ``lower_..``, to six places).

    Base: a text of under 10 words, or with over 20 % of its words in repeated windows, fails. Of the
    others those go that fail two rules, or fail a rule that their host fails too: the lower bound of
    the host's shrunk failure rate exceeds ``times`` the rate among all documents. A document that fails
    no rule is kept whatever its host. ``keys`` are columns that come along. Equal rows count each; an
    empty table gives no rows; a null text is empty and fails; a null host is a host of its own.
    """
    measures = text_measures(docs, keys=keys, **columns)
    words = F.col("n_words")
    rules = host_rules()
    flagged = measures.withColumns(
        {"base_failed": either(words < 10, 100 * F.col("n_repeat_words") > 20 * words), **rules}
    )
    flagged = stage(flagged, "measures")  # narrow; texts are read and counted once
    rates = host_rates(flagged, z)
    verdicts = rates.groupBy("host").agg(
        F.array_sort(F.collect_list(F.when(F.col("lower") > times * F.col("overall"), F.col("rule")))).alias("host_failed"),
        *(F.max(F.when(F.col("rule") == r, F.round(what, 6))).alias(f"{what}_{r}") for r in HOST_RULES for what in ("mean", "lower")),
    )
    failed = F.array_compact(F.array(*(F.when(F.col(r), F.lit(r)) for r in sorted(HOST_RULES))))
    joined = (
        flagged.withColumn("failed", failed)
        .join(checked_broadcast(stage(verdicts.withColumnRenamed("host", "verdict_host"), "hosts")), F.col("host").eqNullSafe(F.col("verdict_host")))
    )
    out = F.col("base_failed") | (F.size("failed") >= 2) | F.arrays_overlap("failed", "host_failed")
    return joined.select(
        "doc_id", *keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~out).alias("kept"),
        F.concat_ws(",", "failed").alias("failed_rules"),
        F.concat_ws(",", "host_failed").alias("host_failed_rules"),
        *(f"{what}_{r}" for r in HOST_RULES for what in ("mean", "lower")),
    )
