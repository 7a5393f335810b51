"""Personal data: labelers vote on candidate spans, their reliabilities are estimated, and a trained
classifier decides on what the base shapes don't settle. DataFrame functions alone.

The candidates of all documents are counted by kind and pattern of votes and features: a table whose
size is bounded by the kinds, labelers and features, whatever the data. Expectation-maximisation runs
on these counts, and the classifier's weights go back into the plan as literals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import narrow, stage
from timberline.llm.spans import SPAN, digits, find_all, kinded, luhn, masked, none_of, overlaps_any, together, total, written

#: Fixed shapes of the base kinds. A mail address starts where a run of its characters starts, or
#: where the last match ended; anything later in a run fails with the run.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
#: Repeated groups are possessive: nothing follows them, and the others would use a stack frame each.
#: At least 12 digits: shorter matches fail anyway, and longer ones start at the same place.
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Shapes of the kinds that the classifier decides on.
NATIONAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
LOCAL_PHONE = r"(?<![0-9+A-Za-z-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
SPELLED_EMAIL = r"[A-Za-z0-9._%+-]{1,64}\x20(?:\[at\]|\(at\)|AT)\x20[A-Za-z0-9-]{1,63}\x20(?:\[dot\]|\(dot\)|DOT)\x20[A-Za-z]{2,24}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"

BASE = ("email", "ip", "card", "phone")
EXTRA = {"national": NATIONAL, "local_phone": LOCAL_PHONE, "spelled_email": SPELLED_EMAIL, "iban": IBAN}
#: Gazetteers: country codes of accounts, top-level domains, and first digits of cards.
COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split()
DOMAINS = "com org net edu gov info io eu de fr es it nl uk us ca au".split()
#: Context before a span that speaks for personal data, and against it.
FOR = r"(?i)(?:e-?mail|mail|phone|call|tel|mobile|fax|contact|ssn|social|security|account|iban|bank|card|reach|write|address)\W{0,12}$"
AGAINST = r"(?i)(?:version|order|invoice|isbn|issn|page|part|model|serial|build|item|ticket|case|no|ref|id|figure|chapter)\W{0,6}$"
CONTEXT = 24


LABELERS, FEATURES = 4, 4
CANDIDATE = "struct<start:int,end:int,kind:string,base:boolean,v1:int,v2:int,v3:int,v4:int,f1:int,f2:int,f3:int,f4:int>"
VOTES = [f"v{i + 1}" for i in range(LABELERS)]
MARKS = [f"f{i + 1}" for i in range(FEATURES)]
#: What certain personal data (the base kinds) may add to a labeler's counts, in rows.
ANCHOR = 6.0


@dataclass(frozen=True)
class Classifier:
    """Log-odds by kind; by kind and labeler a weight for a vote for and against; a weight for each
    feature. ``votes`` are the labelers' weights over all kinds, by number of candidates."""

    bias: dict[str, float]
    weights: dict[str, tuple[tuple[float, float], ...]]
    features: tuple[float, ...]
    votes: tuple[tuple[float, float], ...]

    def score(self, kind: Column, votes: Sequence[Column], features: Sequence[Column]) -> Column:
        out = total([F.when(f > 0, F.lit(w)).otherwise(0.0) for f, w in zip(features, self.features)])
        by_kind = F.lit(0.0)
        for name, value in self.bias.items():
            parts = [F.when(v > 0, F.lit(w)).when(v < 0, F.lit(a)).otherwise(0.0) for v, (w, a) in zip(votes, self.weights[name])]
            by_kind = F.when(kind == name, total([F.lit(value), *parts])).otherwise(by_kind)
        return out + by_kind


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, -1).otherwise(0)


def base_spans(text: Column) -> dict[str, Column]:
    """The base kinds, failing matches dropped."""
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

    def card(s: Column) -> Column:
        number = digits(s["match"])
        return F.length(number).between(12, 19) & luhn(number)

    return {
        "email": F.when(F.contains(text, F.lit("@")), find_all(text, EMAIL)).otherwise(none_of(SPAN)),
        "ip": F.filter(find_all(text, IP), lambda s: s["match"].rlike(rf"^{octet}(?:\.{octet}){{3}}$")),
        "card": F.filter(find_all(text, CARD), card),
        "phone": F.filter(find_all(text, PHONE), lambda s: F.length(digits(s["match"])).between(9, 15)),
    }


def _labelled(text: Column, spans: Column, kind: str) -> Column:
    """The labelers' votes on each span: shape, gazetteer, context, and repetition."""

    def one(s: Column) -> Column:
        word, number = s["match"], digits(s["match"])
        before = F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
        shape, place = F.lit(0), F.lit(0)
        if kind in ("email", "spelled_email"):
            place = _vote(F.lower(F.substring_index(F.regexp_replace(word, r"[\x20.]+", "."), ".", -1)).isin(DOMAINS), F.lit(False))
            shape = _vote(word.rlike(r"^[A-Za-z]"), word.rlike(r"^[.%+-]"))
        elif kind == "ip":
            shape = _vote(~word.rlike(r"(?:^|\.)0[0-9]"), word.rlike(r"(?:^|\.)0[0-9]"))
            place = _vote(F.lit(False), word.rlike(r"^(?:0|127|255)\."))
        elif kind == "card":
            shape = _vote(F.length(number).isin(15, 16), F.length(number).isin(17, 18))
            place = _vote(number.rlike(r"^(?:4|5[1-5]|3[47]|6011|65)"), number.rlike(r"^[01789]"))
        elif kind == "phone":
            shape = _vote(word.rlike(r"[\x20()-]"), word.rlike(r"\.[0-9]{1,2}$"))
            place = _vote(word.rlike(r"^\+(?:1|7|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), word.rlike(r"^\+0"))
        elif kind == "national":
            shape = _vote(~word.rlike(r"^(?:000|666|9)|-00-|-0000$"), word.rlike(r"^(?:000|666|9)|-00-|-0000$"))
        elif kind == "local_phone":
            shape = _vote(word.rlike(r"^\(?[2-9][0-9]{2}\D{1,2}[2-9]"), ~word.rlike(r"^\(?[2-9][0-9]{2}\D{1,2}[2-9]"))
            place = _vote(word.startswith("("), F.lit(False))
        elif kind == "iban":
            place = _vote(F.substring(word, 1, 2).isin(COUNTRIES), ~F.substring(word, 1, 2).isin(COUNTRIES))
        context = _vote(before.rlike(FOR), before.rlike(AGAINST))
        plain = number.rlike(r"([0-9])\1{5}") | number.rlike("012345|123456|987654")
        repeated = _vote(F.lit(False), plain) if kind not in ("email", "spelled_email") else _vote(F.lit(False), word.rlike(r"(?i)^(?:no-?reply|example|test)\W"))
        after = F.substring(text, s["end"] + 1, F.lit(2))
        # A mark right before the span, a bracket or quote or line start, what ends a phrase after it, and marks inside.
        features = [F.lit(0)] * FEATURES if kind in BASE else [
            before.rlike(r"[:=#]\x20?$"), before.rlike(r"(?:^|[\n(<\x22'|])\x20?$"), after.rlike(r"^(?:$|[\n)>\x22'|]|[.,;](?:\s|$))"),
            F.length(F.regexp_replace(word, "[^\\x20().-]", "")) > 1,
        ]
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(kind in BASE).alias("base"),
            *(v.cast("int").alias(n) for v, n in zip((shape, place, context, repeated), VOTES)),
            *(f.cast("int").alias(n) for f, n in zip(features, MARKS)),
        )

    return F.transform(spans, one)


def with_candidates(docs: DataFrame, text: str = "text", name: str = "candidates") -> DataFrame:
    """``docs`` and a column for its text column: the spans of all kinds with the labelers' votes and
    the features. What overlaps a base span is settled: it is neither trained on nor decided."""
    column = F.col(text)
    base = base_spans(column)
    # The other shapes hold digits or a spelled mark; most texts have neither.
    likely = column.rlike(r"[0-9]|[\[(]at[\])]|\x20AT\x20")
    extra = {k: F.when(likely, find_all(column, p)).otherwise(none_of(SPAN)) for k, p in EXTRA.items()}
    settled = _free(docs, "settled")
    docs = docs.withColumn(settled, F.concat(none_of(CANDIDATE), *(_labelled(column, spans, k) for k, spans in base.items())))
    clear = {k: F.filter(spans, lambda s: ~overlaps_any(s["start"], s["end"], F.col(settled))) for k, spans in extra.items()}
    return docs.withColumn(name, F.concat(F.col(settled), *(_labelled(column, spans, k) for k, spans in clear.items()))).drop(settled)


def vote_counts(candidates: DataFrame) -> list[tuple[str, tuple[int, ...], int]]:
    """(kind, votes and features, number): at most kinds x 3^labelers x 2^features rows, counted
    before they are gathered."""
    each = candidates.select(F.explode("candidates").alias("c"))
    names = VOTES + MARKS
    rows = each.groupBy("c.kind", *(F.col(f"c.{n}").alias(n) for n in names)).count().collect()
    return sorted((r["kind"], tuple(r[n] for n in names), r["count"]) for r in rows)


_CELL = {1: 0, -1: 1, 0: 2}


def train(counts: Sequence[tuple[str, tuple[int, ...], int]], rounds: int = 100) -> Classifier:
    """Each added kind has its own reliabilities, by expectation-maximisation; a vote's weight is its
    log-likelihood ratio. The features' weights are then fitted to the posteriors as soft labels.

    Two classes, labelers independent given the class. Base spans are personal data for certain: they
    aren't divided, and how often labelers vote for and against them is known for that class. It adds
    the same few rows to each added kind however many base spans there are. A labeler that casts no
    vote on a kind says nothing about it, and none is taken to be worse than chance, which keeps the
    classes from swapping. Without candidates the classifier trusts every labeler alike.
    """
    sure = _sure(counts)
    bias, weights, mass, soft = {}, {}, {}, []
    for kind in EXTRA:
        own: dict[tuple[int, ...], int] = {}
        for k, pattern, n in counts:
            if k == kind:
                own[pattern[:LABELERS]] = own.get(pattern[:LABELERS], 0) + n
        bias[kind], weights[kind] = _reliabilities(own, sure, rounds)
        mass[kind] = sum(own.values())
        for k, pattern, n in counts:
            if k == kind and len(pattern) > LABELERS:
                odds = bias[kind] + sum((0.0, w, a)[v] for v, (w, a) in zip(pattern, weights[kind]))
                soft.append((kind, pattern[LABELERS:], n, _logistic(odds)))
    share = {k: m / sum(mass.values()) if any(mass.values()) else 1 / len(mass) for k, m in mass.items()}
    votes = tuple(
        tuple(sum(share[k] * weights[k][j][side] for k in EXTRA) for side in (0, 1)) for j in range(LABELERS)
    )
    offset, features = _fit(soft)
    return Classifier({k: b + offset.get(k, 0.0) for k, b in bias.items()}, weights, features, votes)


def _sure(counts: Sequence[tuple[str, tuple[int, ...], int]]) -> list[tuple[float, float, float]]:
    """By labeler, the shares of votes for, against and of none on base spans, where it votes at all;
    each base kind counts alike."""
    out = []
    for j in range(LABELERS):
        shares = []
        for kind in BASE:
            cells = [0.0, 0.0, 0.0]
            for k, pattern, n in counts:
                if k == kind:
                    cells[_CELL[pattern[j]]] += n
            if cells[0] + cells[1] > 0:
                shares.append([x / sum(cells) for x in cells])
        out.append(tuple(sum(s[c] for s in shares) / len(shares) if shares else 0.0 for c in range(3)))
    return out


def _reliabilities(own: dict[tuple[int, ...], int], sure: Sequence[tuple[float, float, float]], rounds: int):
    """(log-odds without a vote, weights) of one kind from its counts by votes."""
    start = [[[3.0 + ANCHOR * s[0], 1.0 + ANCHOR * s[1], 2.0 + ANCHOR * s[2]], [1.0, 3.0, 2.0]] for s in sure]
    silent = [bool(own) and not any(votes[j] for votes in own) for j in range(LABELERS)]
    right, prior = [_ordered(rows) for rows in start], 0.5
    for _ in range(rounds):
        cells = [[list(row) for row in rows] for rows in start]
        mass = [1.0, 1.0]
        for votes, n in own.items():
            odds = [prior, 1 - prior]
            for j, v in enumerate(votes):
                if not silent[j]:
                    odds = [o * right[j][c][_CELL[v]] for c, o in enumerate(odds)]
            p = odds[0] / (odds[0] + odds[1])
            for c, x in enumerate((n * p, n * (1 - p))):
                mass[c] += x
                for j, v in enumerate(votes):
                    cells[j][c][_CELL[v]] += x
        right, prior = [_ordered(rows) for rows in cells], mass[0] / sum(mass)
    none = [0.0 if silent[j] else _ratio(right[j], 2) for j in range(LABELERS)]
    weights = tuple((0.0, 0.0) if silent[j] else (_ratio(right[j], 0) - none[j], _ratio(right[j], 1) - none[j]) for j in range(LABELERS))
    return math.log(prior / (1 - prior)) + sum(none), weights


def _ordered(rows: Sequence[Sequence[float]]) -> list[list[float]]:
    """Shares of a labeler's votes by class. A vote for is at least as common on personal data as on the
    rest, and a vote against at most; what breaks this has the share of both classes together."""
    shares = [[x / sum(row) for x in row] for row in rows]
    both = [(a + b) / (sum(rows[0]) + sum(rows[1])) for a, b in zip(*rows)]
    for cell, sign in ((0, 1), (1, -1)):
        if sign * (shares[0][cell] - shares[1][cell]) < 0:
            for s in shares:
                s[cell] = both[cell]
    return [[x / sum(s) for x in s] for s in shares]


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def _fit(soft: Sequence[tuple[str, tuple[int, ...], int, float]], rounds: int = 50) -> tuple[dict[str, float], tuple[float, ...]]:
    """(offset by kind, weight by feature): logistic regression of the posteriors on the features, by
    Newton steps. The offset takes out the kind's own share, which the reliabilities have already."""
    if not soft:
        return {}, (0.0,) * FEATURES
    kinds = sorted({k for k, *_ in soft})
    x = np.array([[k == name for name in kinds] + list(f) for k, f, _, _ in soft], float)
    n = np.array([row[2] for row in soft], float)
    y = np.array([row[3] for row in soft])
    ridge = np.array([1e-3] * len(kinds) + [1.0] * FEATURES)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(n @ (np.logaddexp(0.0, z) - y * z) + 0.5 * ridge @ (w * w))

    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (n * (p - y)) + ridge * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    offset = {}
    for i, name in enumerate(kinds):
        of = x[:, i] > 0
        share = min(max(float(n[of] @ y[of] / n[of].sum()), 1e-9), 1 - 1e-9)
        offset[name] = float(w[i]) - math.log(share / (1 - share))
    return offset, tuple(w[len(kinds) :].tolist())


def _ratio(rows, i: int) -> float:
    return math.log(rows[0][i] / rows[1][i])


def decided(candidates: Column, classifier: Classifier) -> dict[str, Column]:
    """Spans by kind: base spans as they are; others where the classifier finds personal data more
    likely than not."""
    base = {k: _of_kind(candidates, k) for k in BASE}
    good = F.filter(
        candidates, lambda c: ~c["base"] & (classifier.score(c["kind"], [c[n] for n in VOTES], [c[n] for n in MARKS]) > 0)
    )
    return base | {k: _of_kind(good, k) for k in EXTRA}


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda c: c["kind"] == kind)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans in order.

    Base kinds: mail and network addresses, card and phone numbers. The classifier adds national
    numbers, local phones, spelled-out mail addresses and bank accounts. A null or empty text has no
    spans; equal rows are judged alike and each counts in training; an empty table gives no rows.
    One pass over the texts; only candidates are kept for the second step.
    """
    rows = stage(with_candidates(narrow(docs, id_col, text_col)).select("doc_id", "candidates"), "candidates")
    spans = decided(F.col("candidates"), train(vote_counts(rows)))
    by_kind = rows.select("doc_id", *(kinded(s, k, i).alias(k) for i, (k, s) in enumerate(spans.items())))
    return by_kind.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(written(together([F.col(k) for k in BASE])), 256).alias("base_sha256"),
        written(together([F.col(k) for k in spans])).alias("spans"),
    )


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``find_pii`` replaced by its kind in brackets; null texts stay.

    Texts are not moved: the candidates are found once to train and once more in place.
    """
    text, found, spans = (_free(docs, n) for n in ("text", "candidates", "spans"))
    whole = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    counted = with_candidates(whole.select(F.col(text).alias("text"))).select("candidates")
    by_kind = decided(F.col(found), train(vote_counts(counted)))
    merged = with_candidates(whole, text, found).withColumn(
        spans, together([kinded(s, k, i) for i, (k, s) in enumerate(by_kind.items())])
    )
    hidden = F.when(F.col(text_col).isNotNull(), masked(F.col(text), F.col(spans)))
    return merged.withColumn(text_col, hidden).select(*docs.columns)


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name
