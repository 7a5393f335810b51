"""Secrets: shapes, and sliding-window entropy of candidate strings; DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import narrow
from timberline.llm.spans import KINDED, find_all, kinded, none_of, overlaps_any, together, written

#: Fixed shapes of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: What may be a secret without a name: long runs of its characters. Links are taken whole.
CANDIDATE = r"https?://[^\x20\x09-\x0D]+|[A-Za-z0-9+/_=-]{20,}"
#: Strings that look random and are known not to be secrets: links, numbers, words joined by marks,
#: universally unique ids, and integrity sums of packages.
ALLOWED = (
    r"^(?:https?://.*|[0-9+/_=-]+|[A-Za-z+/_=-]+|[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
    r"|sha(?:1|256|384|512)-.*)$"
)
WINDOW = 20
#: Character classes, and the entropy in bits that a window must reach.
CLASSES = {"hex": (r"^[0-9A-Fa-f]+$", 3.0), "base64": (r"^[A-Za-z0-9+/_=-]+$", 3.9)}


#: Characters of candidates are numbered from the first of them; a count takes five bits of a long.
FIRST, LAST = ord("+"), ord("z")
EACH = 12
#: n log n for each count, in parts of 2^-40: sums of whole numbers don't drift over a long string.
UNIT = 1 << 40
WEIGHTS = [0, 0, *(round(n * math.log2(n) * UNIT) for n in range(2, WINDOW + 1))]


def _changed(counts: Column, at: Column, by: int) -> Column:
    """``counts`` with the count at ``at`` one higher or lower; each long holds the counts of EACH characters."""
    one = F.call_function("shiftleft", F.lit(by).cast("long"), 5 * (at % EACH))
    return F.transform(counts, lambda x, j: F.when(j == F.floor(at / EACH), x + one).otherwise(x))


def dense_part(word: Column, least: Column) -> Column:
    """struct<first, last>: where the windows of at least ``least`` bits begin and end; null if none.

    The window moves by one character: the count of the one that leaves and of the one that enters
    change, and with them the sum of n log n from which the entropy follows. Each step costs the same.
    """
    codes = F.transform(F.split(word, ""), lambda c: F.ascii(c) - FIRST)
    weights = F.array(*(F.lit(w).cast("long") for w in WEIGHTS))
    # A window is dense if its sum is small enough; the last bits make up for rounding.
    most = F.floor((math.log2(WINDOW) - least) * WINDOW * UNIT).cast("long") + WINDOW * WINDOW

    def weight(n: Column) -> Column:
        return F.get(weights, n.cast("int"))

    def count(counts: Column, at: Column) -> Column:
        part = F.get(counts, F.floor(at / EACH).cast("int"))
        return F.call_function("shiftright", part, 5 * (at % EACH)).bitwiseAND(F.lit(31).cast("long"))

    def step(acc: Column, at: Column, way: int) -> Column:
        """What the state is once the character ``at`` has entered (1) or left (-1)."""
        n = count(acc["counts"], at)
        return F.struct(
            _changed(acc["counts"], at, way).alias("counts"), (acc["s"] + weight(n + way) - weight(n)).alias("s"),
            acc["first"].alias("first"), acc["last"].alias("last"), acc["i"].alias("i"), acc["most"].alias("most"),
        )

    def moved(acc: Column, x: Column) -> Column:
        # The parts are steps of an inner fold, so that each is computed once.
        before = F.when(x["leaves"].isNull(), acc).otherwise(step(acc, x["leaves"], -1))
        return F.aggregate(F.array(before), acc, lambda _, b: seen(step(b, x["enters"], 1), b))

    def seen(state: Column, like: Column) -> Column:
        """The state with its window judged, and one place further. ``like`` only gives the type."""
        return F.aggregate(
            F.array(state), like, lambda _, t: F.struct(
                t["counts"].alias("counts"), t["s"].alias("s"),
                F.when((t["i"] >= WINDOW - 1) & (t["s"] <= t["most"]), F.coalesce(t["first"], t["i"] - (WINDOW - 1))).otherwise(t["first"]).alias("first"),
                F.when((t["i"] >= WINDOW - 1) & (t["s"] <= t["most"]), t["i"] + 1).otherwise(t["last"]).alias("last"),
                (t["i"] + 1).alias("i"), t["most"].alias("most"),
            ),
        )

    nothing = F.lit(None).cast("int")
    groups = -(-(LAST - FIRST + 1) // EACH)
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), groups).alias("counts"), F.lit(0).cast("long").alias("s"),
        nothing.alias("first"), nothing.alias("last"), F.lit(0).alias("i"), most.alias("most"),
    )
    late = F.concat(F.array_repeat(nothing, WINDOW), codes)
    both = F.arrays_zip(codes.alias("enters"), F.slice(late, 1, F.size(codes)).alias("leaves"))
    return F.aggregate(both, start, moved, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def random_spans(text: Column) -> Column:
    """Spans of candidate strings whose windows are dense for their class and that aren't allowed."""
    found = F.filter(find_all(text, CANDIDATE), lambda s: ~s["match"].rlike(ALLOWED))

    def dense(s: Column) -> Column:
        least = F.lit(None).cast("double")
        for pattern, bits in reversed(CLASSES.values()):
            least = F.when(s["match"].rlike(pattern), F.lit(bits)).otherwise(least)
        return F.struct(s["start"].alias("start"), dense_part(s["match"], least).alias("part"))

    # In two steps: a column that is used twice would be computed twice.
    parts = F.filter(F.transform(found, dense), lambda s: s["part"]["first"].isNotNull())
    return F.transform(parts, lambda s: F.struct((s["start"] + s["part"]["first"]).alias("start"), (s["start"] + s["part"]["last"]).alias("end")))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the spans of each base kind, all spans in order, counts and digest.

    Base: assignments to a telling name with a value of 8 characters or more, access keys of 16 or
    more, lower-case hexadecimal runs of 32 or more; from the left, none overlapping within a kind,
    failing matches dropped. Kind ``entropy`` is added where no base span overlaps. A null or empty
    text has no spans. One pass, no shuffle; rows are independent, an empty table gives no rows.
    """
    text = F.col("text")
    base = {
        "assign": F.filter(find_all(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 8),
        "access": F.filter(find_all(text, ACCESS), lambda s: s["end"] - s["start"] >= 16),
        # A run of 32 or more is found as a whole or not at all, so short runs need not be listed.
        "hex": find_all(text, HEX[:-1] + "{32,}"),
    }
    kinds = list(base)
    rows = narrow(docs, id_col, text_col).select(
        "doc_id", *(kinded(spans, k, i).alias(k) for i, (k, spans) in enumerate(base.items())), random_spans(text).alias("random")
    )
    rows = rows.withColumn("base", together([F.col(k) for k in kinds]))
    extra = F.filter("random", lambda s: ~overlaps_any(s["start"], s["end"], F.col("base")))
    rows = rows.withColumn("extra", F.coalesce(kinded(extra, "entropy", len(kinds)), none_of(KINDED)))
    return rows.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in kinds),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(together([F.col("base"), F.col("extra")])).alias("spans"),
    )
