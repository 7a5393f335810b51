"""URL rules and host reputation against plain Python, on tables where each level decides."""

import re

import pytest

from timberline.llm.urls import SUFFIXES, levels, url_filter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0] if rest[len(host) :].startswith("/") else ""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def domain_of(host):
    bare = host.rsplit("@", 1)[-1]
    bare = re.sub(r":[0-9]*\Z", "", bare)
    bare = bare[:-1] if bare.endswith(".") else bare
    if re.fullmatch("[0-9.]+", bare) or ":" in bare or "[" in bare:
        return bare, bare
    names = bare.split(".")
    n = 2 if ".".join(names[-2:]) in SUFFIXES else 1
    return ".".join(names[-n - 1 :]), ".".join(names[-n:])


def shrunk(groups):
    """groups: name -> (n, bad, above); name -> mean, and the strength."""
    known = [g for g in groups.values() if g[0]]
    k = 2.0
    if known:
        pages = sum(n for n, _, _ in known)
        between = (sum(n * (b / n - a) ** 2 for n, b, a in known) - sum(a * (1 - a) for _, _, a in known)) / pages
        k = min(max(sum(n * a * (1 - a) for n, _, a in known) / pages / max(between, 1e-6) - 1, 2.0), 1000.0)
    return {name: (b + k * a) / (n + k) for name, (n, b, a) in groups.items()}, k


def plain(pages, labels, times=1.5):
    bad = {}
    for doc, quality, toxic in labels:
        bad[doc] = max(bad.get(doc, 0), int(quality == 0 or toxic == 1))
    count = {}
    for _, url in pages:
        host, path = parts(url)
        n, b = count.get(host, (0, 0))
        m = re.search("/([0-9]{1,18})", path)
        if m and int(m[1]) in bad:
            n, b = n + 1, b + bad[int(m[1])]
        count[host] = n, b

    def summed(key, above):
        out = {}
        for host, (n, b) in count.items():
            old = out.get(key(host), (0, 0))
            out[key(host)] = old[0] + n, old[1] + b
        return {name: (n, b, above(name)) for name, (n, b) in out.items()}

    overall = (sum(b for _, b in count.values()) + 0.5) / (sum(n for n, _ in count.values()) + 1)
    suffix, _ = shrunk(summed(lambda h: domain_of(h)[1], lambda _: overall))
    domain, _ = shrunk(summed(domain_of, lambda d: suffix[d[1]]))
    mean, k = shrunk(summed(lambda h: h, lambda h: domain[domain_of(h)]))
    out = []
    for page, url in pages:
        host, path = parts(url)
        fits = [(len(h + p), v == "block", h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[2:] if fits else (None, None)
        m = mean[host]
        lower = m - (m * (1 - m) / (count[host][0] + k + 1)) ** 0.5
        out.append((page, host, path, rule, verdict or ("block" if lower > times * overall else "allow"), count[host][0], m, lower))
    return out


def judged(spark, pages, labels, **more):
    pages = spark.createDataFrame([(p, u, "x", "y", 0.5) for p, u in pages], "page_id long, url string, host string, verdict string, bad_mean double").repartition(3)
    labels = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, host string")
    return url_filter(pages, labels, **more)


def same(rows, want):
    rows = sorted((tuple(r) for r in rows), key=str)
    want = sorted(want, key=str)
    assert [r[:6] for r in rows] == [w[:6] for w in want]
    for r, w in zip(rows, want):
        assert abs(r[6] - w[6]) < 2e-6 and abs(r[7] - w[7]) < 2e-6


#: Documents 0 to 999 are bad, others are good.
LABELS = [(i, 0, 0) for i in range(500)] + [(i, 1, 1) for i in range(500, 1000)] + [(i, 1, 0) for i in range(1000, 6000)] + [(7, 1, 0), (2000, None, None)]


def world():
    pages, page = [], 0

    def add(host, good, bad, unknown):
        nonlocal page
        docs = [*range(1000 + 37 * page % 3000, 1000 + 37 * page % 3000 + good), *range(bad), *range(90000, 90000 + unknown)]
        for doc in docs:
            pages.append((page, f"https://{host}/de/{doc}.html?x=1#y"))
            page += 1

    for i in range(40):
        add(f"site{i}.org", 20, i % 3, 1)
    for i in range(6):
        add(f"www{i}.spam-farm.org", 1, 20, 1)  # a bad domain
        add(f"shop{i}.co.uk", 12, 1, 1)  # a fair suffix of two names
        add(f"p{i}.github.io", 0, 25, 2)  # a bad suffix: other owners, same kind
    add("new.spam-farm.org", 0, 0, 3)
    add("new.github.io", 0, 0, 3)
    add("fresh.co.uk", 0, 0, 3)
    add("one.bad.org:8080", 0, 40, 1)
    add("user@one.fine.org.", 30, 0, 1)
    add("10.0.0.1", 5, 30, 0)
    add("[2001:db8::1]:443", 9, 0, 0)
    odd = [None, "", "no scheme", "http://", "http:///x/1005", "HTTP://EXAMPLE.COM/en/1", "http://WWW.Example.com/en/2", "http://a.net/es/3", "http://a.net?/es/3", "http://net/fr/#4", "ftp://x.org/9999999999999999999999"]
    odd += ["https://long.org/" + "a/" * 100000 + "12?q", "https://" + "l." * 20000 + "org/de/3"]
    pages += [(100000 + i, u) for i, u in enumerate(odd)]
    return pages + pages[:5] + [(None, pages[0][1])]


def test_each_level_decides(spark):
    pages = world()
    rows = judged(spark, pages, LABELS).collect()
    same(rows, plain(pages, LABELS))
    verdict = {r.host: r.verdict for r in rows if r.rule is None}
    for host in ("www0.spam-farm.org", "p0.github.io", "one.bad.org:8080", "10.0.0.1"):
        assert verdict[host] == "block", host
    # Hosts without a labelled page go by their domain, or their suffix.
    assert verdict["new.spam-farm.org"] == "block" and verdict["new.github.io"] == "block"
    for host in ("site2.org", "fresh.co.uk", "shop1.co.uk", "user@one.fine.org.", "[2001:db8::1]:443", ""):
        assert verdict[host] == "allow", host


def test_suffixes_matter(spark):
    hosts = ["a.b.co.uk", "co.uk", "uk", "x.y.z.example.org", "127.0.0.1:80", "u@h.github.io:1", "", "a..org", "end.org."]
    row = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = [(r.domain, r.suffix) for r in row.select(*(c.alias(k) for k, c in levels(row.host).items())).collect()]
    assert got == [domain_of(h) for h in hosts]
    assert got[0] == ("b.co.uk", "co.uk") and got[5] == ("h.github.io", "github.io")
    got = row.where("host = 'a.b.co.uk'").select(levels(row.host, ())["domain"]).first()[0]
    assert got == "co.uk"


@pytest.mark.parametrize("pages, labels", [([], []), ([], LABELS[:3]), ([(1, "http://a.org/1"), (2, None)], []), ([(1, "http://a.org/1")] * 3, [(1, 0, 0)])])
def test_small(spark, pages, labels):
    same(judged(spark, pages, labels).collect(), plain(pages, labels))
