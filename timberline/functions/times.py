"""Timestamps from text. Text without an offset is read in an explicit zone, never the host's."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_DATE = r"\d{4}-\d{2}-\d{2}"
_CLOCK = r"\d{2}:\d{2}:\d{2}(?:\.\d+)?"
_OFFSET = r"(?:Z|[+-]\d{2}:?\d{2})"

# Which timestamp texts each format accepts, without and with an offset.
LOCAL_FORMS = {
    "plain": rf"{_DATE}[T ]{_CLOCK}",
    "json": rf"{_DATE} {_CLOCK}",
    "csv": rf"{_DATE} {_CLOCK}",
    "unified": rf"{_DATE} {_CLOCK}",
    "report": rf"{_DATE} {_CLOCK}",
}
OFFSET_FORMS = {
    "plain": rf"{_DATE}[T ]{_CLOCK}(?:Z|[+-]\d{{2}}(?::?\d{{2}})?)",
    "json": rf"{_DATE}T{_CLOCK}{_OFFSET}",
    "csv": rf"{_DATE}T{_CLOCK}{_OFFSET}",
    "unified": rf"{_DATE} {_CLOCK}{_OFFSET}",
    "report": rf"{_DATE} {_CLOCK} ?{_OFFSET}",
}
# Month-first forms, rearranged to ISO.
SCCM_FORM = rf"^(\d{{2}})-(\d{{2}})-(\d{{4}}) ({_CLOCK})$"
US_FORM = r"^(\d{2})/(\d{2})/(\d{4}) (\d{2}:\d{2}:\d{2})$"

MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def local_instant(text: Column, tz: str) -> Column:
    """ISO text without offset, read in ``tz``; null when it is no time.

    Spark reads such text in the session's zone; only for another one is it spelled out.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get("spark.sql.session.timeZone") == tz:
        return F.try_to_timestamp(text)
    return F.try_to_timestamp(F.concat(text, F.lit(f" {tz}")))


def parse_timestamp(text: Column, kind: str = "plain", tz: str = "UTC") -> Column:
    """Timestamp of ``text`` if it has one of the forms ``kind`` accepts, else null.

    ``text`` is evaluated once per form, so give it a column rather than a long expression.
    """
    if kind == "sccm":
        iso = F.regexp_replace(text, SCCM_FORM, "$3-$1-$2 $4")
        return F.when(text.rlike(SCCM_FORM), local_instant(iso, tz))
    local = local_instant(F.regexp_extract(text, f"^{LOCAL_FORMS[kind]}$", 0), tz)
    dated = F.regexp_extract(text, f"^{OFFSET_FORMS[kind]}$", 0)
    if kind == "report":
        dated = F.replace(F.replace(dated, F.lit(" +"), F.lit("+")), F.lit(" -"), F.lit("-"))
    tries = [local, F.try_to_timestamp(dated)]
    if kind == "csv":
        iso = F.regexp_replace(text, US_FORM, "$3-$1-$2 $4")
        tries.append(F.when(text.rlike(US_FORM), local_instant(iso, tz)))
    return F.coalesce(*tries)


def is_timestamp(text: Column, kind: str, tz: str = "UTC") -> Column:
    """Whether :func:`parse_timestamp` gives a time; texts not starting with a digit cost little."""
    return text.rlike(r"^\d{2}") & parse_timestamp(text, kind, tz).isNotNull()


def _literal_now(now: datetime | str | None, tz: str) -> Column:
    if now is None:
        return F.current_timestamp()
    text = now.isoformat(sep=" ") if isinstance(now, datetime) else now
    return local_instant(F.lit(text if ":" in text else f"{text} 00:00:00"), tz)


def infer_year(month: Column, day: Column, clock: Column, now=None, tz: str = "UTC") -> Column:
    """Timestamp of a date without a year: this year's, or last year's if over a day ahead.

    A day the month never has gives null; 29 February outside a leap year rolls to 1 March.
    """
    moment = _literal_now(now, tz)
    utc = F.to_utc_timestamp(moment, F.current_timezone())
    year = F.year(F.from_utc_timestamp(utc, F.lit(tz)))
    possible = day <= F.dayofmonth(F.last_day(F.make_date(F.lit(2000), month, F.lit(1))))

    def in_year(y: Column) -> Column:
        date = F.date_add(F.make_date(y, month, F.lit(1)), day - 1)
        return local_instant(F.concat(date.cast("string"), F.lit(" "), clock), tz)

    here = in_year(year)
    ahead = F.unix_micros(here) - F.unix_micros(moment) > 86_400_000_000
    return F.when(possible & (day >= 1), F.when(ahead, in_year(year - 1)).otherwise(here))


def yearless_timestamp(parts: Column, now=None, tz: str = "UTC") -> Column:
    """Words ``[EEE] MMM d HH:mm:ss[.f]`` to a timestamp by :func:`infer_year`."""
    at = F.instr(F.lit(MONTHS), F.lower(F.get(parts, F.size(parts) - 3)))
    month = F.when((at % 3) == 1, F.call_function("div", at + 2, F.lit(3)).cast("int"))
    day = F.get(parts, F.size(parts) - 2).try_cast("int")
    return infer_year(month, day, F.get(parts, F.size(parts) - 1), now, tz)


def epoch_number(text: Column) -> Column:
    """Timestamp of an epoch number: above 1e12 milliseconds, above 1e9 seconds, else null."""
    n = text.try_cast("double")
    seconds = F.when(n > 1e12, n / 1000).when(n > 1e9, n)
    return F.when(seconds < 2.5e11, F.timestamp_micros(F.round(seconds * 1_000_000).cast("long")))
