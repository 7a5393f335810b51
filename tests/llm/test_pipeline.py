"""The pipeline against brute-force versions of its stages, on the smallest tables."""

import itertools

from compare import duck
from test_jaccard import components, plain_set
from test_line_runs import plain as plain_runs
from test_packing import check
from test_pii import plain as plain_pii

import corpus_pipeline
from timberline.llm.bpe import vocabulary
from timberline.llm.quality_sql import RULES_SQL

SF = "/root/testdata/sf0.001"


def masked(text):
    out, at = "", 0
    for start, _, end, kind in plain_pii(text):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    steps, frame = dict(corpus_pipeline.STAGES), docs

    def after(name):
        nonlocal frame
        steps[name](spark, frame, SF).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or frame.columns == docs.columns
        return frame

    kept = {r[0] for r in duck(SF).execute(f"SELECT doc_id FROM ({RULES_SQL}) WHERE kept").fetchall()}
    texts = {d: t for d, t in texts.items() if d in kept}
    assert {r.doc_id for r in after("quality").collect()} == kept and 0.5 * docs.count() < len(kept)

    gone = plain_runs(list(texts.items()), 50)
    for (d, t), lines in gone.items():
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in lines)
        texts[d] = left if lines else t
        if lines and not left.strip():
            del texts[d]
    assert {r.doc_id: r.text for r in after("line_dedup").collect()} == texts
    assert any(gone.values())

    sets = {d: plain_set(t) for d, t in texts.items()}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    texts = {d: texts[d] for d, c in components(list(texts.items()), linked).items() if c == d}
    assert {r.doc_id for r in after("near_duplicates").collect()} == set(texts)

    texts = {d: masked(t) for d, t in texts.items()}
    rows = after("pii").collect()
    assert {r.doc_id: r.text for r in rows} == texts and all(r.n_chars == len(r.text) for r in rows)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    check(after("packing").collect(), [(d, library.encode(t, add_special_tokens=False).ids + [1]) for d, t in texts.items()], 2048)


def test_run(spark):
    packed = corpus_pipeline.run(spark, SF)
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and packed.count() > 100
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_odd_documents(spark, tmp_path):
    """Nulls, empty and repeated rows, an empty table and columns that operators use themselves."""
    text = "one two three four five six seven eight nine ten eleven x@y.zz"
    rows = [(1, text, "a", 5, "c"), (1, text, "a", 5, "c"), (2, None, None, 0, None), (3, "", "a", 0, "c"), (None, text + " more", "b", 1, "c")]
    schema = "doc_id long, text string, source string, n_chars long, candidates string"
    for name, data in (("some", rows), ("none", [])):
        docs = spark.createDataFrame(data, schema)
        for step, f in corpus_pipeline.STAGES:
            f(spark, docs, SF).write.parquet(f"{tmp_path}/{name}-{step}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{step}")
        assert (docs.count() > 0) == bool(data)


GOOD = "A calm morning by the river, with boats and birds and a long quiet walk home again. Number {}."


def test_rows_are_judged_by_themselves(spark):
    """Rejected rows take no others with them, by a shared id or by none."""
    rows = [(1, GOOD.format(1)), (1, "bad"), (None, GOOD.format(2)), (None, "bad"), (5, GOOD.format(3))]
    docs = spark.createDataFrame([(d, t, "s", len(t)) for d, t in rows], "doc_id long, text string, source string, n_chars long")
    left = corpus_pipeline.quality(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted((str(d), t) for d, t in rows if t != "bad")


def test_one_copy_stays(spark):
    text = GOOD.format(1)
    rows = [(d, text, "s") for d in (2, 1, 1, None, None)] + [(None, GOOD.format("two, but with quite another end to it than the first one had"), "s")]
    rows += [(7, "", "s"), (7, "", "s"), (8, None, "s"), (9, " \n", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    left = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in left) == sorted([("1", text), ("None", rows[5][1]), ("7", ""), ("7", ""), ("8", ""), ("9", " \n")])


def test_columns_with_the_names_of_helpers(spark, tmp_path):
    names = ["_doc", "_digest", "_removed", "_words", "_row", "_gone", "row", "k1", "k2", "_ROWS", "spans", "Candidates", "n_shingles", "kept"]
    rows = [(i, GOOD.format(i), "s", 80, *range(len(names))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for step, f in corpus_pipeline.STAGES[:-1]:
        f(spark, docs, SF).write.parquet(f"{tmp_path}/{step}")
        after = spark.read.parquet(f"{tmp_path}/{step}")
        assert after.columns == docs.columns and after.count() > 0
        docs = after
