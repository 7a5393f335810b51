"""Repeated runs of lines against a plain version."""

import random

from timberline.llm.line_runs import drop_repeated_lines, line_dedup


def plain(rows, min_words):
    """{(doc_id, text): removed line numbers}: maximal runs that occur earlier, by comparing all places."""
    docs = sorted({(-1 if d is None else d, t or "") for d, t in rows}, key=lambda x: x[0])
    seqs = [[(i, w) for i, line in enumerate(t.split("\n")) if (w := line.strip(" \t\n\x0b\f\r"))] for _, t in docs]
    out = {}
    for a, seq in enumerate(seqs):
        gone = set()
        for p in range(len(seq)):
            best = 0
            for b in range(a + 1):
                other = seqs[b]
                for q in range(len(other) if b < a else p):
                    n = 0
                    while p + n < len(seq) and q + n < len(other) and seq[p + n][1] == other[q + n][1]:
                        n += 1
                    best = max(best, n)
            if sum(len(w.split()) for _, w in seq[p : p + best]) >= min_words:
                gone |= {i for i, _ in seq[p : p + best]}
        out[docs[a]] = gone
    return out


def corpus(seed):
    rnd = random.Random(seed)
    lines = [" ".join(rnd.choices(["a", "b", "c", "dd", "é"], k=rnd.choice([1, 1, 2, 3, 8]))) for _ in range(12)]
    passage = [f"passage {i} of some words" for i in range(6)]
    rows = []
    for d in range(40):
        text = []
        for _ in range(rnd.randrange(0, 6)):
            text += rnd.choice([passage, passage[2:5], rnd.choices(lines, k=3), [f"only here {rnd.random()}"], ["", "  "]])
        rows.append((d * 3, "\n".join(text)))
    return rows


def test_runs(spark):
    for seed, min_words in ((1, 10), (2, 4), (3, 25)):
        rows = corpus(seed)
        rows += [rows[5], rows[5], (None, rows[7][1]), (9000, None), (9001, ""), (9002, "\n\n"), (9003, "same line\n" * 40)]
        docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, i int").repartition(3)
        want = plain(rows, min_words)
        got = line_dedup(docs, min_words).collect()
        assert len(got) == len(rows)
        texts = {d: t for d, t in rows}
        for r in got:
            key = (-1 if r.doc_id is None else r.doc_id, texts[r.doc_id] or "")
            assert r.removed == ",".join(map(str, sorted(want[key]))), (seed, r)
            assert r.n_removed == len(want[key])
        left = drop_repeated_lines(docs, min_words)
        assert left.columns == docs.columns
        after = {r.doc_id: r.text for r in left.collect()}
        for d, t in rows:
            gone = want[-1 if d is None else d, t or ""]
            kept = "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone)
            if gone and not kept.strip():
                assert d not in after
            else:
                assert after[d] == (t if not gone else kept)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup(none).count() == 0 and drop_repeated_lines(none).count() == 0
