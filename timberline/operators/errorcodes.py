"""Looking up error codes: in a column of inputs, within a domain, and inside messages.

Codes are a dimension: about 750 built in, a list of the caller's, or a DataFrame ``(domain, code, symbol,
description)`` of any size. Matches of an input are an array, put in order before the join. A list is held by the
driver and sent to all tasks, and no lookup shuffles the rows; so is a DataFrame's table of keys if it is counted
to be small enough. A larger one is joined by key, with rows that have nothing to look up spread out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.functions.codes import code_hex, extract_error_tokens, parse_code
from timberline.operators.error_tables import DOMAINS, NUMBER_RANGE, Code, built_in_codes, load_codes
from timberline.session import stage
from timberline.settle import staged

MATCH_TYPE = T.StructType(
    [
        T.StructField("domain", T.StringType()),
        T.StructField("code", T.IntegerType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

# Domains whose symbols are not looked up by name.
UNNAMED = {"HTTP"}


def _rank(domain: str) -> int:
    return DOMAINS.index(domain) if domain in DOMAINS else len(DOMAINS)


def _in_range(code: Code) -> bool:
    low, high = NUMBER_RANGE.get(code.domain, (code.code, code.code))
    return low <= code.code <= high


def _keyed(codes: Iterable[Code] | None) -> dict[str, list[Code]]:
    """Lookup key -> matches in domain order. Keys: ``n:`` number, ``s:`` symbol in capitals, and
    both again within one domain.
    """
    keyed: dict[str, list[Code]] = defaultdict(list)
    for c in sorted(codes or built_in_codes(), key=lambda c: _rank(c.domain)):
        if _in_range(c):
            keyed[f"n:{c.code}"].append(c)
            keyed[f"{c.domain}|n:{c.code}"].append(c)
        if c.domain not in UNNAMED:
            keyed[f"s:{c.symbol.upper()}"].append(c)
            keyed[f"{c.domain}|s:{c.symbol.upper()}"].append(c)
    return keyed


def code_table(spark: SparkSession, codes: Iterable[Code] | None = None) -> DataFrame:
    """The dimension as a DataFrame ``(domain, code, symbol, description)``."""
    return spark.createDataFrame([tuple(c) for c in codes or built_in_codes()], MATCH_TYPE)


#: Keys of a DataFrame of codes that may be sent to all tasks.
SENT_KEYS = 200_000


def _keys_of(codes: DataFrame) -> DataFrame:
    """``(_key, _found)`` as :func:`_keyed` gives it, for a DataFrame of codes; written once."""
    rank = F.coalesce(*[F.when(F.col("domain") == d, F.lit(i)) for i, d in enumerate(DOMAINS)], F.lit(len(DOMAINS)))
    in_range = F.lit(True)
    for domain, (low, high) in NUMBER_RANGE.items():
        in_range = in_range & ((F.col("domain") != domain) | F.col("code").between(low, high))
    own = F.concat(F.col("domain"), F.lit("|"))
    number, symbol = F.concat(F.lit("n:"), F.col("code").cast("string")), F.concat(F.lit("s:"), F.upper("symbol"))
    named = ~F.col("domain").isin(*UNNAMED)
    keys = F.array(F.when(in_range, number), F.when(in_range, F.concat(own, number)), F.when(named, symbol), F.when(named, F.concat(own, symbol)))
    typed = codes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in MATCH_TYPE]).dropDuplicates()
    rows = typed.select(F.explode(F.array_compact(keys)).alias("_key"), F.struct(rank.alias("_rank"), *MATCH_TYPE.fieldNames()).alias("_c"))
    found = rows.groupBy("_key").agg(F.array_sort(F.collect_list("_c")).alias("_c"))
    match = lambda c: F.struct(*[c[f].alias(f) for f in MATCH_TYPE.fieldNames()])
    return stage(found.select("_key", F.transform("_c", match).alias("_found")), "codes")


def _table_of(spark: SparkSession, codes: Iterable[Code] | DataFrame | None, within: bool = False) -> DataFrame:
    """The table of keys to join; ``within``: those of a domain, with the first match each."""
    if not isinstance(codes, DataFrame):
        keyed = _keyed(codes)
        return _lookup_table(spark, {k: found[:1] for k, found in keyed.items() if "|" in k} if within else keyed)
    table = _keys_of(codes)
    if within:
        table = table.where(F.contains("_key", F.lit("|"))).withColumn("_found", F.slice("_found", 1, 1))
    return F.broadcast(table) if table.limit(SENT_KEYS + 1).count() <= SENT_KEYS else table


def _spread_nulls(key: Column, salt: Column) -> Column:
    """``key``, or where it is null one of many that no table has, so that these rows don't meet in one task."""
    return F.coalesce(key, F.concat(F.lit("-:"), F.pmod(F.xxhash64(salt), F.lit(1024)).cast("string")))


def _lookup_table(spark: SparkSession, keyed: dict[str, list[Code]]) -> DataFrame:
    schema = T.StructType(
        [T.StructField("_key", T.StringType()), T.StructField("_found", T.ArrayType(MATCH_TYPE))]
    )
    rows = [(key, [tuple(c) for c in found]) for key, found in keyed.items()]
    return F.broadcast(spark.createDataFrame(rows, schema))


def lookup_key(text: Column) -> Column:
    """``n:<number>`` if the text is a number, else ``s:<TEXT>``; null for blank text."""
    trimmed = F.trim(text)
    number = parse_code(trimmed)
    key = F.when(number.isNotNull(), F.concat(F.lit("n:"), number.cast("string"))).otherwise(
        F.concat(F.lit("s:"), F.upper(trimmed))
    )
    return F.when(trimmed != "", key)


def preferred_domain(text: Column, number: Column | None = None) -> Column:
    """The domain an input unambiguously points to, or null. More specific signs come first.

    ``number`` is :func:`parse_code` of the text, if at hand.
    """
    t = F.trim(text)
    up = F.upper(t)
    number = parse_code(t) if number is None else number
    is_hex = t.rlike(r"^0[xX][0-9A-Fa-f]+$")
    return (
        F.when(t.startswith("errSec"), F.lit("Security"))
        .when(up.startswith("SIG"), F.lit("POSIX Signal"))
        .when(up.startswith("SQLITE_"), F.lit("SQLite"))
        .when(up.startswith("KDNSSERVICEERR_"), F.lit("Bonjour"))
        .when(up.startswith("NSURL") | up.startswith("KCFERROR"), F.lit("CFNetwork"))
        .when(up.startswith("EX_"), F.lit("Exit Code"))
        .when(up.rlike(r"^E[A-Z]+$"), F.lit("errno"))
        .when(t.rlike(r"^0[xX]8[0-9A-Fa-f]{7}$"), F.lit("OSStatus"))
        .when(is_hex & number.between(0xE0000200 - 2**32, 0xE00002FF - 2**32), F.lit("IOReturn"))
        .when(~is_hex & number.between(100, 599), F.lit("HTTP"))
        .when(~is_hex & number.between(-3010, -1), F.lit("CFNetwork"))
    )


def _preferred_first(found: Column, domain: Column) -> Column:
    """Matches of ``domain`` moved to the front, order kept otherwise."""
    return F.when(domain.isNull(), found).otherwise(
        F.concat(
            F.filter(found, lambda m: m["domain"] == domain),
            F.filter(found, lambda m: m["domain"] != domain),
        )
    )


def _with_matches(df: DataFrame, key: Column, text: Column, table: DataFrame, name: str) -> DataFrame:
    asked = staged(staged(df, _at=_spread_nulls(key, text), _text=text), _number=parse_code(F.col("_text")))
    out = asked.join(table, F.col("_at") == F.col("_key"), "left")
    # Only inputs with several matches have an order to settle.
    domain = F.when(F.size("_found") > 1, preferred_domain(F.col("_text"), F.col("_number")))
    out = out.withColumn("_domain", domain)
    return out.withColumn(name, _preferred_first(F.col("_found"), F.col("_domain"))).drop(
        "_at", "_text", "_number", "_key", "_found", "_domain"
    )


def _exploded(df: DataFrame, name: str) -> DataFrame:
    columns = [c for c in df.columns if c != name]
    out = df.select(*columns, F.posexplode(name).alias("_i", "_m"))
    return out.select(
        *columns,
        (F.col("_i") + 1).alias("match_rank"),
        *[F.col(f"_m.{f}").alias(f) for f in MATCH_TYPE.fieldNames()],
        code_hex(F.col("_m.code"), F.col("_m.domain")).alias("hex"),
    )


def error_lookup(df: DataFrame, text: str, codes: Iterable[Code] | DataFrame | None = None) -> DataFrame:
    """A row per match of the input in column ``text``: ``match_rank`` from 1, domain, code,
    symbol, description, hex. Inputs without a match vanish. Matches in codes given as a DataFrame are in
    the order of domains, then of domain, code and symbol; rows that repeat are one.
    """
    table = _table_of(df.sparkSession, codes)
    return _exploded(_with_matches(df, lookup_key(F.col(text)), F.col(text), table, "_matches"), "_matches")


def error_lookup_in(
    df: DataFrame, text: str, domain: str, codes: Iterable[Code] | DataFrame | None = None
) -> DataFrame:
    """The one match of each input within the domain named in column ``domain``, or null fields."""
    key = F.concat(F.col(domain), F.lit("|"), lookup_key(F.col(text)))
    table = _table_of(df.sparkSession, codes, within=True)
    out = df.withColumn("_at", _spread_nulls(key, F.col(text))).join(table, F.col("_at") == F.col("_key"), "left")
    match = F.get("_found", F.lit(0))
    return out.select(
        *[F.col(c) for c in df.columns],
        match["code"].alias("code"),
        match["symbol"].alias("symbol"),
        match["description"].alias("description"),
        code_hex(match["code"], F.col(domain)).alias("hex"),
    )


def decode_codes(
    df: DataFrame,
    message: str = "message",
    codes: Iterable[Code] | DataFrame | None = None,
    strict: bool = False,
) -> DataFrame:
    """Add ``code_token``, the first code in the message that resolves, and ``matches``.

    Of ``errno=60`` and ``OSStatus -5`` the number is looked up in that domain, of ``error -5`` in
    all. ``strict`` looks whole tokens up as they stand, so that these never resolve.
    """
    tokens = extract_error_tokens(F.col(message))
    if strict:
        hint, bare = "CAST(NULL AS STRING)", "t"
    else:
        hint = "CASE WHEN t LIKE 'errno=%' THEN 'errno|' WHEN t LIKE 'OSStatus%' THEN 'OSStatus|' END"
        bare = r"regexp_replace(t, '^(errno=|OSStatus\\s|error\\s)', '')"
    out = staged(df, _tokens=tokens)
    out = staged(out, _tokens=F.expr(f"transform(_tokens, t -> struct(t AS token, {hint} AS hint, {bare} AS bare))"))
    keyed_token = lambda t: F.struct(
        t["token"].alias("token"),
        F.concat(F.coalesce(t["hint"], F.lit("")), lookup_key(t["bare"])).alias("key"),
    )
    out = staged(out, _tokens=F.transform("_tokens", keyed_token))
    table = _table_of(df.sparkSession, codes)
    if isinstance(codes, DataFrame):
        out = _first_resolving(out, table)
    else:
        # Membership in a literal set is one hash probe per token, inside the row.
        known = ", ".join("'" + key.replace("'", "''") + "'" for key in _keyed(codes))
        out = staged(out, _hit=F.expr(f"get(filter(_tokens, t -> t.key IN ({known})), 0)"))
    token = F.col("_hit.token")
    said = token if strict else F.regexp_replace(token, r"^(errno=|OSStatus\s|error\s)", "")
    out = _with_matches(out.withColumn("code_token", token), F.col("_hit.key"), said, table, "matches")
    return out.drop("_tokens", "_hit")


def _first_resolving(df: DataFrame, table: DataFrame) -> DataFrame:
    """Add ``_hit``, the first of ``_tokens`` whose key is in ``table``.

    What resolves depends on the tokens alone: each distinct list is looked up once, whatever number of
    messages has it, and joined back by its text.
    """
    df = df.withColumn("_list", F.when(F.size("_tokens") > 0, F.to_json("_tokens")))
    lists = df.where(F.col("_list").isNotNull()).select("_list", "_tokens").dropDuplicates(["_list"])
    each = lists.select("_list", F.posexplode("_tokens").alias("_i", "_t"))
    hits = each.join(table.select("_key"), F.col("_t.key") == F.col("_key"))
    first = stage(hits.groupBy("_list").agg(F.min_by("_t", "_i").alias("_hit")).withColumnRenamed("_list", "_with"), "hits")
    at = _spread_nulls(F.col("_list"), F.to_json(F.struct("_tokens", *[c for c in df.columns if c not in ("_tokens", "_list")][:1])))
    return df.withColumn("_list", at).join(first, F.col("_list") == F.col("_with"), "left").drop("_list", "_with")
