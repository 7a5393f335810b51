"""Quality rules and host verdicts against plain Python."""

import random
import re
from collections import Counter

import pytest

from timberline.llm.quality import HOST_RULES, quality_rules


def measures(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 5)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated), "n_lines": len(lines),
        "n_upper": sum("A" <= c <= "Z" for c in text),
    }


def failures(m):
    w = m["n_words"]
    return {
        "symbols": 10 * m["n_symbols"] > w, "symbols_heavy": m["n_symbols"] > w, "dup_lines": 10 * m["n_dup_lines"] > 3 * m["n_lines"],
        "word_length": m["word_chars"] < 2 * w or m["word_chars"] > 15 * w, "shouting": 2 * m["n_upper"] > m["word_chars"],
    }


def bounds(rows, z=2.0):
    """(host, rule) -> overall, mean, lower."""
    out = {}
    for rule in HOST_RULES:
        n, bad = Counter(), Counter()
        for host, failed in rows:
            n[host] += 1
            bad[host] += failed[rule]
        total = sum(n.values())
        m = (sum(bad.values()) + 0.5) / (total + 1)
        chance = m * (1 - m)
        between = max((sum(n[h] * (bad[h] / n[h] - m) ** 2 for h in n) - chance * len(n)) / max(total, 1), 1e-6)
        k = min(max(chance / between - 1, 2.0), 1000.0)
        for h in n:
            mean = (bad[h] + m * k) / (n[h] + k)
            out[h, rule] = m, mean, mean - z * (mean * (1 - mean) / (n[h] + k + 1)) ** 0.5
    return out


def plain(rows, times=2.0):
    found = [(d, h, measures(t)) for d, t, h in rows]
    flags = [(h, failures(m)) for _, h, m in found]
    rate = bounds(flags)
    out = []
    for (doc, host, m), (_, failed) in zip(found, flags):
        poor = sorted(r for r in HOST_RULES if rate[host, r][2] > times * rate[host, r][0])
        own = sorted(r for r in HOST_RULES if failed[r])
        base = m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]
        kept = not (base or len(own) >= 2 or set(own) & set(poor))
        counts = tuple(m[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        out.append(((doc, *counts, base, kept, ",".join(own), ",".join(poor)), [x for r in HOST_RULES for x in rate[host, r][1:]]))
    return out


def judged(spark, rows):
    docs = spark.createDataFrame(
        [(d, t, h, "x", 1, ["y"], True) for d, t, h in rows],
        "doc_id long, text string, source string, host string, n_words int, words array<string>, kept boolean",
    )
    return [tuple(r) for r in quality_rules(docs.repartition(3)).collect()]


def same(got, want):
    got, want = sorted(got, key=str), sorted(want, key=lambda w: str(w[0])[:-1])
    assert [r[:10] for r in got] == [w[0] for w in want]
    for r, (_, rates) in zip(got, want):
        assert all(abs(a - b) < 2e-6 for a, b in zip(r[10:], rates))


SYMBOLIC = "some plain words of text with a few signs ## in the middle {} and an end"
PLAIN = "some plain words of text with nothing odd in the middle {} and an end"


def corpus():
    rows = []
    for h in range(12):
        rows += [(len(rows) + i, (SYMBOLIC if i % 25 == 0 else PLAIN).format(i), f"host{h}") for i in range(60)]
    # A host whose texts are full of signs: those of them that fail that rule alone go as well.
    rows += [(1000 + i, (SYMBOLIC if i % 3 else PLAIN).format(i), "signs") for i in range(200)]
    rows += [(2000 + i, (SYMBOLIC if i % 3 else PLAIN).format(i), None) for i in range(90)]
    rows += [(3000 + i, SYMBOLIC.format(i), f"small{i}") for i in range(3)]  # one text says little of a host
    return rows


def test_hosts_decide(spark):
    rows = corpus()
    got = judged(spark, rows)
    same(got, plain(rows))
    kept = {r[0]: r[7] for r in got}
    by = {d: (t, h) for d, t, h in rows}
    for doc, (text, host) in by.items():
        gone = "##" in text and host in ("signs", None)
        assert kept[doc] == (not gone), (doc, host)


def test_odd_texts(spark):
    rnd = random.Random(3)
    texts = [None, "", " \n\t\n", "one", "a\n\na\n a\na\tb\x0bc\x0cd\re", "x " * 30000, "A" * 50000 + " b", "é ü ñ 漢字     words that are not cut there, ten of them at least"]
    texts += [" ".join(rnd.choices("ab", k=rnd.randrange(40))) for _ in range(30)]
    texts += ["\n".join(rnd.choices(["THE SAME LINE", "another | line", "third < line"], k=8)) for _ in range(10)]
    long = " ".join(f"w{i}" for i in range(40000))
    texts += [long, long + " " + long[:2000], "#" * 200 + " w" * 12]
    rows = [(i, t, f"h{i % 4}") for i, t in enumerate(texts)]
    rows += rows[:3] * 2 + [(None, texts[-1], None), (5, texts[8], None)]
    same(judged(spark, rows), plain(rows))


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, PLAIN, "a")] * 4])
def test_small(spark, rows):
    same(judged(spark, rows), plain(rows))
