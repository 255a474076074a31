"""Each stage of the pipeline on its own input, against brute force."""

import re
import sys

import corpus_pipeline as C
from arealis.llm.batches import stored

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_texts import expect_hits, expect_links, expect_pieces_ok, expect_repeats  # noqa: E402


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (900001, "", "en", "s", 0), (900002, "...", None, "s", 3), (900003, "one", "en", None, 3)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.where("doc_id = 3"))
    before = rows(docs)
    kept = dict(C.STAGES)

    first = stored(kept["language"](spark, docs, small), "t")
    assert first.columns == C.COLUMNS
    letters = [(i, t) for i, t in before if re.search(r"[^\W\d_]", t or "")]
    assert sorted(map(repr, rows(first))) == sorted(map(repr, letters))

    second = stored(kept["near_duplicates"](spark, first, small), "t")
    assert second.columns == C.COLUMNS
    want = {i for i, _, c in expect_links(rows(first)) if i == c}
    assert sorted(r[0] for r in rows(second)) == sorted(want)

    third = stored(kept["repeated_passages"](spark, second, small), "t")
    assert third.columns == C.COLUMNS
    source = dict(rows(second))
    want = {i: (k if g else source[i]) for i, _, g, k in expect_repeats(list(source.items()))}
    assert dict(rows(third)) == {i: t for i, t in want.items() if t}
    assert all(r.n_chars == len(r.text) for r in third.collect() if want[r.doc_id] != source[r.doc_id])

    fourth = stored(kept["decontaminated"](spark, third, small), "t")
    assert fourth.columns == C.COLUMNS
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(r[0] for r in rows(fourth)) == sorted(x[0] for x in expect_hits(rows(third), items) if not x[5])


def test_last_stage_and_run(spark, small):
    from arealis.llm import packing, queries

    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    assert C.packed(spark, docs, small).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    expect_pieces_ok(rows(docs), packing.pack(docs, queries.tokenizer()).collect())
    assert C.run(spark, small).count() > 0
    empty = docs.limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, small).count() == 0


def test_texts_under_one_id(spark, small):
    """Another text under the same id is no copy; a repeated row is."""
    one, other = "a b c d e f g h i j", "quite other words that stand here all alone now"
    docs = spark.createDataFrame([(1, one, "en", "s", 1), (1, other, "en", "s", 1), (1, one, "de", "t", 2), (2, one, "en", "s", 1), (None, one, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = C.near_duplicates(spark, docs, small).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, one), (1, other), (0, one)])
