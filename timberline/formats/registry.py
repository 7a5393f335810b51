"""Known formats, per-file detection, and the parse over whole directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.formats.base import SAMPLE_LINES, LogFormat, ParseContext, Sample, settle
from timberline.formats.csv_rows import CSV
from timberline.formats.jsonl import JSON, UNIFIED
from timberline.formats.plain import PLAIN
from timberline.formats.reports import DIAG, IPS
from timberline.formats.sccm import SCCM
from timberline.schema import INFO, LOG_SCHEMA, PARSED_FIELDS
from timberline.session import prefer_compiled

# Order breaks ties between equal scores.
_BUILT_IN = [IPS, DIAG, SCCM, UNIFIED, JSON, CSV, PLAIN]
_formats: dict[str, LogFormat] = {f.name: f for f in _BUILT_IN}


def formats() -> list[LogFormat]:
    return list(_formats.values())


def register_format(fmt: LogFormat) -> None:
    """Add a format ahead of plain text, or replace the one of the same name."""
    if fmt.name in _formats:
        _formats[fmt.name] = fmt
        return
    plain = _formats.pop(PLAIN.name)
    _formats[fmt.name] = fmt
    _formats[PLAIN.name] = plain


def unregister_format(name: str) -> None:
    if any(f.name == name for f in _BUILT_IN):
        _formats[name] = next(f for f in _BUILT_IN if f.name == name)
    else:
        _formats.pop(name, None)


def _heads(lines: DataFrame, count: int = SAMPLE_LINES) -> DataFrame:
    """``(source_id, _head[, _kinds])``: the first lines of each source, in order, at most ``count`` per
    source; and the formats that these lines are given, if lines are given any.
    """
    first = lines.where(F.col("line_number").between(1, count) & (F.col("raw_line") != ""))
    kinds = [F.collect_set("format").alias("_kinds")] if "format" in lines.columns else []
    return first.groupBy("source_id").agg(
        F.sort_array(F.collect_list(F.struct("line_number", "raw_line"))).alias("_head"), *kinds
    )


def _scored(heads: DataFrame) -> DataFrame:
    """Adds ``format`` and ``score``: the strictly highest score, the earlier format on a tie."""
    known = formats()
    sample = Sample(F.col("_lines"))
    heads = heads.withColumn("_lines", F.transform("_head", lambda r: r["raw_line"]))
    heads = heads.withColumns({f"_score_{f.name}": f.score(sample).cast("double") for f in known})
    best = F.greatest(*[F.coalesce(F.col(f"_score_{f.name}"), F.lit(0.0)) for f in known], F.lit(0.0))
    name = F.coalesce(*[F.when(F.col(f"_score_{f.name}") == best, F.lit(f.name)) for f in known])
    return heads.withColumns({"format": name, "score": best})


def detect_format(lines: DataFrame) -> DataFrame:
    """``(source_id, format, score)`` of each source from its first lines."""
    return _scored(_heads(lines)).select("source_id", "format", "score")


def parse_logs(
    lines: DataFrame,
    format: str = "auto",
    tz: str = "UTC",
    now=None,
    honor_offset: bool = False,
    heads: DataFrame | None = None,
) -> DataFrame:
    """Lines ``(source_id, line_number, raw_line[, entry_id])`` to log records.

    ``format`` names one format for all lines; ``"auto"`` detects it per source; ``"column"``
    takes it from a ``format`` column already there (a stream, or a manifest that knows).

    Reports need the top of their file, which a stream doesn't have at hand: there, as with formats
    that nobody knows, their lines are plain messages of level info.

    Detection and file headers come from the first lines of each source: ``heads``, if given (see
    ``timberline.sources.read_heads``), else one pass over the lines. That
    table has a row per source and is joined without a broadcast hint: Spark broadcasts it by
    its measured size, and otherwise splits a source that holds most of the lines.
    """
    ctx = ParseContext(tz, now, honor_offset)
    prefer_compiled(lines.sparkSession)
    if format == "auto" and lines.isStreaming:
        raise ValueError("a stream has no first lines to detect a format from; name it, or use 'column'")
    if format in ("auto", "column"):
        chosen = formats()
    elif format in _formats:
        chosen = [_formats[format]]
        lines = lines.withColumn("format", F.lit(format))
    else:
        raise ValueError(f"unknown format {format!r}; known: {sorted(_formats)}")
    if lines.isStreaming:
        chosen = [f for f in chosen if not f.file_scoped]
    if "entry_id" not in lines.columns:
        lines = lines.withColumn("entry_id", F.lit(None).cast("long"))
    lines = lines.where(F.col("raw_line") != "")

    headed = [f for f in chosen if f.file_scoped]
    if format == "auto" or headed:
        if heads is not None and format != "auto":
            # A source's format goes for its first lines too.
            known = lines.select("source_id", "format").distinct() if format == "column" else None
            heads = heads.join(known, "source_id") if known is not None else heads.withColumn("format", F.lit(format))
        first = lines if heads is None else heads
        # A format that is named needs no more lines than its header.
        count = SAMPLE_LINES if format == "auto" else max(f.header_lines for f in headed)
        heads = _heads(first if format == "column" else first.drop("format"), count)
        if format == "auto":
            heads = _scored(heads)
            lines = lines.drop("format")
        # A header is read only for sources of its format.
        def mine(f: LogFormat) -> Column:
            if format == "auto":
                return F.col("format") == f.name
            return F.array_contains("_kinds", f.name) if format == "column" else F.lit(True)

        # Settled: the filter on titles would read the header a second time.
        heads = heads.withColumns(
            {f.header_column(): settle(F.when(mine(f), f.header(F.col("_head"), ctx))) for f in headed}
        )
        facts = [f.header_column() for f in headed] + (["format"] if format == "auto" else [])
        heads = heads.select("source_id", *facts)
        lines = lines.join(heads, "source_id", "left").select(*lines.columns, *facts)
        for f in headed:
            if f.title is not None:
                lines = lines.unionByName(_title_rows(heads, f, lines), allowMissingColumns=True)
    return _parse_as(lines, chosen, ctx)


def _title_rows(heads: DataFrame, fmt: LogFormat, like: DataFrame) -> DataFrame:
    """One synthetic row (line 0) per source with a header of ``fmt``."""
    header = F.col(fmt.header_column())
    given = {"line_number": F.lit(0), "raw_line": fmt.title(header)}
    if "format" in like.columns:
        given["format"] = F.lit(fmt.name)
    kept = {n: F.col(n) for n in heads.columns if n not in given}
    return heads.where(header.isNotNull()).select(
        *[
            (given | kept).get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in like.schema.fields
        ]
    )


def _parse_as(lines: DataFrame, chosen: list[LogFormat], ctx: ParseContext) -> DataFrame:
    one = len(chosen) == 1
    # What a line of no format at hand is.
    bare = {"level": F.lit(INFO), "message": F.col("raw_line")}
    base = lines.columns
    df, parsed = lines, {}
    for fmt in chosen:
        active = F.lit(True) if one else F.col("format") == fmt.name
        df, parsed[fmt.name] = fmt.parse(df, active, ctx)

    def field(name: str) -> Column:
        if one:
            return parsed[chosen[0].name][name]
        out = F.when(F.lit(False), None)
        for fmt in chosen:
            value = parsed[fmt.name][name].cast(LOG_SCHEMA[name].dataType)
            out = out.when(F.col("format") == fmt.name, value)
        return out.otherwise(bare.get(name, F.lit(None)))

    settled = df.select(
        *base, *[settle(field(n).cast(LOG_SCHEMA[n].dataType)).alias(n) for n in PARSED_FIELDS]
    )
    return settled.withColumn("source_line_number", F.col("line_number")).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA]
    )
