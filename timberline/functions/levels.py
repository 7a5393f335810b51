"""Severity from words, tags and prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.text import captured
from timberline.schema import CRITICAL, DEBUG, ERROR, INFO, NOTICE, WARNING

# Keywords looked for as whole words in free text, strongest set first.
ERROR_WORDS = r"error|failed|failure|fatal|crash(?:ed)?|panic|abort(?:ed)?|exception|critical|severe"
WARNING_WORDS = r"warn(?:ing)?|caution|deprecated|retrying|timeout|timed out"
DEBUG_WORDS = r"debug|trace|verbose"

# Words that name a level.
LEVEL_WORDS = {
    DEBUG: ["DEBUG"],
    INFO: ["INFO"],
    NOTICE: ["NOTICE"],
    WARNING: ["WARN", "WARNING"],
    ERROR: ["ERROR", "ERR"],
    CRITICAL: ["CRITICAL", "FATAL", "CRIT"],
}
JSON_LEVEL_WORDS = {
    DEBUG: ["trace", "verbose", "debug"],
    INFO: ["info", "information"],
    NOTICE: ["notice"],
    WARNING: ["warn", "warning"],
    ERROR: ["error", "err"],
    CRITICAL: ["fatal", "critical", "emergency", "alert"],
}
CSV_LEVEL_WORDS = {
    DEBUG: ["debug", "trace"],
    INFO: ["info", "information"],
    NOTICE: ["notice"],
    WARNING: ["warn", "warning"],
    ERROR: ["error", "err"],
    CRITICAL: ["fatal", "critical"],
}
UNIFIED_TYPES = {
    CRITICAL: ["fault"],
    ERROR: ["error"],
    NOTICE: ["default"],
    INFO: ["info"],
    DEBUG: ["debug"],
}
SCCM_TYPES = {INFO: ["1"], WARNING: ["2"], ERROR: ["3"]}
BUG_TYPES = {
    ERROR: ["109", "309", "199", "305"],
    CRITICAL: ["110"],
    WARNING: ["111", "210", "211", "288"],
    NOTICE: ["298"],
}
REPORT_WORDS = {
    CRITICAL: ["panic", "fatal"],
    ERROR: ["error", "failed", "crash"],
    WARNING: ["warning", "hang", "stuck"],
}

# Fixed value: a level word in front of a text, then an optional component and the message.
LEVEL_PREFIX = (
    r"(?is)^\[?(DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|ERR|CRITICAL|FATAL|CRIT)\b\]?\s*:?\s*"
    r"(?:([A-Za-z][A-Za-z0-9._-]{0,30}):\s+)?(.*)"
)


def _whole_words(words: str) -> str:
    return rf"(?i)\b(?:{words})\b"


def word_level(word: Column, words: dict[int, list[str]]) -> Column:
    """Rank of an exact word under ``words``; null when it names none."""
    ranks = list(words.items())
    out = F.when(word.isin(*ranks[0][1]), F.lit(ranks[0][0]))
    for rank, names in ranks[1:]:
        out = out.when(word.isin(*names), F.lit(rank))
    return out


def detect_level(text: Column) -> Column:
    """Severity by keyword: error words beat warning words beat debug words, else info.

    One scan settles the common line that has no keyword at all.
    """
    any_word = _whole_words("|".join([ERROR_WORDS, WARNING_WORDS, DEBUG_WORDS]))
    return (
        F.when(~F.coalesce(text.rlike(any_word), F.lit(False)), F.lit(INFO))
        .when(text.rlike(_whole_words(ERROR_WORDS)), F.lit(ERROR))
        .when(text.rlike(_whole_words(WARNING_WORDS)), F.lit(WARNING))
        .otherwise(F.lit(DEBUG))
    )


def recognized_level(word: Column) -> Column:
    """Rank of a level word in any case, else null."""
    return word_level(F.upper(word), LEVEL_WORDS)


def report_level(line: Column) -> Column:
    """Severity of a diagnostic-report line by substring, else info."""
    low = F.lower(line)
    out = None
    for rank, words in REPORT_WORDS.items():
        hit = low.rlike("|".join(words))
        out = F.when(hit, F.lit(rank)) if out is None else out.when(hit, F.lit(rank))
    return out.otherwise(F.lit(INFO))


def level_prefix(text: Column) -> Column:
    """Array (level word, component or "", message) of a text with a level prefix, else null."""
    return F.when(text.rlike(LEVEL_PREFIX), captured(text, LEVEL_PREFIX, 3))


def parse_level_and_component(text: Column) -> Column:
    """Struct (level, message, component) of a text that may start with a level word."""
    parts = level_prefix(text)
    return F.struct(
        F.coalesce(recognized_level(F.get(parts, F.lit(0))), detect_level(text)).alias("level"),
        F.coalesce(F.get(parts, F.lit(2)), text).alias("message"),
        F.nullif(F.get(parts, F.lit(1)), F.lit("")).alias("component"),
    )


def interpret_bracket_tag(tag: Column) -> Column:
    """Struct (level, component), either null, of a bracketed tag.

    One word is a level or else a component. Of several, a leading level word is the level and
    the rest the component; without one the whole tag is the component.
    """
    words = F.filter(F.split(tag, " "), lambda w: w != F.lit(""))
    level = recognized_level(F.get(words, F.lit(0)))
    rest = F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " ")
    component = (
        F.when(F.coalesce(tag, F.lit("")) == "", F.lit(None).cast("string"))
        .when(F.size(words) == 1, F.when(level.isNull(), F.get(words, F.lit(0))))
        .when(level.isNotNull(), rest)
        .otherwise(tag)
    )
    return F.struct(level.alias("level"), component.alias("component"))
