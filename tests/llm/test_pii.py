"""Personal data against a plain version of the base kinds, and the classifier on planted votes."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from timberline.llm.pii import find_pii, mask_pii, train


def luhn(s):
    ds = [int(c) for c in reversed(s)]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(ds)) % 10 == 0


def n_digits(s):
    return re.sub("[^0-9]", "", s)


SHAPES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(n_digits(s)) <= 19 and luhn(n_digits(s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(n_digits(s)) <= 15),
}


def plain(text):
    spans = [(m.start(), i, m.end(), k) for i, (k, (p, ok)) in enumerate(SHAPES.items()) for m in re.finditer(p, text or "") if ok(m[0])]
    return sorted(spans)


TEXTS = [
    None, "", "nothing", "mail hein.19@mail5.example.com now", "a@b.com_x@y.org", "..@a.b @x.y a@b a@b.c.d@e.f", "🙂é x@y.zz 1.2.3.4",
    "8.196.197.208 256.1.1.1 1.2.3.4.5.6.7.8 01.002.0003.4", "4111 1111 1111 1111 and 4111111111111112", "4111-1111-1111-1111-1",
    "+1 (743) 555-3824 +1 +22 +123456789012345678", "+1 (521) 555-6210.", "1 2 3 4 5 6 7 8 9 0 1 2 3", "0" * 50, "a" * 30000 + "@",
    "x@" * 5000, "1.1.1.1 " * 2000, "+4930123456 4539 1488 0343 6467", "9" * 5000,
]


def test_base(spark):
    rnd = random.Random(8)
    parts = ["a", "b.c", "@", ".", "x-y", "com", " ", "+1", "555", "-", "(", ")", "4111111111111111", "127.0.0.1", "9", "é", "🙂", "\n", "0", "12"]
    texts = TEXTS + ["".join(rnd.choices(parts, k=rnd.randrange(1, 50))) for _ in range(600)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, "x@y.zz", None)]
    got = find_pii(spark.createDataFrame(rows, "doc_id long, text string, candidates string")).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = plain("x@y.zz" if r.doc_id is None else texts[r.doc_id])
        names = [f"{k}:{s}:{e}" for s, _, e, k in spans]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in spans) for k in SHAPES], r
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s.split(":")[0] in SHAPES] == names
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_added_and_masked(spark):
    good = [f"call me at ({200 + i}) 555-01{i:02d}" for i in range(40)] + [f"SSN: {301 + i}-12-34{i:02d}" for i in range(40)]
    bad = [f"order {900 + i}-00-0000 was sent" for i in range(40)] + [f"version 123.456.{7000 + i} out" for i in range(40)]
    rows = [(i, t, "s", "c", 1) for i, t in enumerate(good + bad + ["write joe (at) mail (dot) com", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, candidates string, _text int")
    spans = {r.doc_id: r.spans for r in find_pii(docs).collect()}
    assert all("local_phone" in spans[i] for i in range(40)) and all("national" in spans[i] for i in range(40, 80))
    assert not any(spans[i] for i in range(80, 160))
    out = mask_pii(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[0] == "call me at [LOCAL_PHONE]" and texts[81] == bad[1] and texts[161] is None
    mails = spark.createDataFrame([(1, "é x@y.zz, 1.2.3.4")], "doc_id long, text string")
    assert mask_pii(mails).head().text == "é [EMAIL], [IP]"


def test_reliabilities():
    """Votes drawn from known reliabilities: the better labeler weighs more, abstention nothing much."""
    rnd = random.Random(3)
    counts = {}
    for _ in range(20000):
        true = rnd.random() < 0.5
        votes = [0, 0, 0, 0]
        for j, right in enumerate((0.95, 0.85, 0.75)):
            vote = true if rnd.random() < right else not true
            votes[j] = 0 if rnd.random() < 0.3 else (1 if vote else -1)
        key = ("national", tuple(votes))
        counts[key] = counts.get(key, 0) + 1
    c = train([(k, v, n) for (k, v), n in counts.items()])
    up = [w for w, _ in c.votes[:3]]
    assert up[0] > up[1] > up[2] > 0 and up[0] == pytest.approx(2.94, abs=0.5)
    assert all(a < 0 < w for w, a in c.votes[:3])
    assert F is not None and train([]).bias.keys() == c.bias.keys()


def test_added_among_base_kinds(spark):
    """Added kinds are found in a corpus full of base kinds, which don't turn what is not personal into personal data."""
    good = [f"SSN: {301 + i}-12-34{i:02d}" for i in range(20)] + [f"so {301 + i}-12-34{i:02d} it" for i in range(20)]
    good += [f"here is joe{i} (at) mail (dot) com" for i in range(20)] + [f"the DE{i + 10} 3704 0044 0532 0130 00 is it" for i in range(20)]
    bad = [f"order {900 + i}-00-0000 was sent" for i in range(40)] + [f"so {900 + i}-00-0000 it" for i in range(40)]
    bad += [f"the QX{i + 10} 3704 0044 0532 0130 00 is it" for i in range(20)]
    base = ["mail19@mail5.example.com and 8.196.197.208 or 4539148803436467 so +1 (743) 555-3824 it"] * 180
    docs = spark.createDataFrame(list(enumerate(good + bad + base)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in find_pii(docs).where("doc_id < 180").collect()}
    kinds = ["national"] * 40 + ["spelled_email"] * 20 + ["iban"] * 20 + [""] * 100
    assert [spans[i].split(":")[0] for i in range(180)] == kinds


def test_base_counts_do_not_matter():
    """A million base spans decide nothing but what certain personal data looks like, and the classes keep their names."""
    added = [("national", (1, 0, 1, 0), 40), ("national", (1, 0, 0, 0), 300), ("national", (-1, 0, -1, -1), 3000)]
    for n in (10, 1_000_000):
        base = [("email", (1, 1, 0, 0), n), ("card", (1, -1, 0, 0), n), ("phone", (1, 1, 0, 0), n), ("ip", (1, 0, 0, 0), n)]
        c = train(base + added)
        score = [c.bias["national"] + sum((0.0, w, a)[v] for v, (w, a) in zip(votes, c.weights["national"])) for _, votes, _ in added]
        assert score[0] > 0 and score[1] > 0 > score[2]


def test_features_follow_the_posteriors():
    """Where votes leave it open, a feature that goes with personal data decides."""
    counts = [("national", (1, 0, 1, 0, 1, 0, 0, 0), 500), ("national", (-1, 0, -1, 0, 0, 0, 0, 0), 500)]
    c = train(counts + [("national", (-1, 0, 1, 0, 1, 0, 0, 0), 1), ("national", (-1, 0, 1, 0, 0, 0, 0, 0), 1)])
    assert c.features[0] > 2 and c.features[1:] == pytest.approx((0, 0, 0))
