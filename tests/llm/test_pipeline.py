"""The pipeline against a plain version of its stages, on a small table."""

import hashlib

import corpus_pipeline
from ledgerwatch.llm import bpe
from tests.llm.test_operators import brute_groups


def test_stages(spark):
    from tokenizers import Tokenizer

    sf_dir, lib = "/root/testdata/sf0.001", Tokenizer.from_file(bpe.default_tokenizer_path())
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "12 !!", "en", None, 5), (10**6 + 2, "", "en", "src1", 0)], table.schema)
    docs = table.unionByName(extra)
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    assert names == ("language", "near_duplicates", "mixture", "tokens")
    first = stages[0](spark, docs, sf_dir)
    assert first.columns == table.columns
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in table.collect()}  # clean documents stay, the rest goes
    second = stages[1](spark, first, sf_dir)
    texts = {r.doc_id: r.text for r in table.collect()}
    assert {r.doc_id for r in second.collect()} == {c for _, c in brute_groups(list(texts.items())).values()}
    third = stages[2](spark, second, sf_dir)
    taken = [r.doc_id for r in third.collect()]
    assert set(taken) <= {r.doc_id for r in second.collect()} and max(taken.count(i) for i in taken) <= 2
    words = lambda ids: sum(len(texts[i].split()) for i in ids)
    assert abs(words(taken) - 1.5 * words([r.doc_id for r in second.collect()])) < 20 * 25
    for r in stages[3](spark, third, sf_dir).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_run_and_empty_table(spark, tmp_path):
    empty = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_odd_rows(spark):
    """Nulls, repeated rows and doc_ids, an unlearned script, ties, a long text, clashing names: each stage on its own."""
    english, german = "the and of to in it that was for on " * 9, "der die und ich nicht auf ein das ist mit " * 9
    rows = [(1, english, "en", "a"), (2, german, "de", "a"), (3, english + "more words here", "en", "b"), (3, german + "anders", "de", "b"), (4, "привет как дела друзья мои", None, "a"), (5, None, "en", None), (6, "", None, None), (None, english * 2000, "en", None), (7, "12 34", "en", "a"), (1, english, "en", "a")]
    docs = spark.createDataFrame([(*r, None, "x", 1.0, 9, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, score double, size long, h int")
    language, near, mixture, tokens = (f for _, f in corpus_pipeline.STAGES)
    first = language(spark, docs, "")
    assert first.columns == docs.columns
    assert sorted((r.doc_id or 0, len(r.text)) for r in first.collect()) == sorted((r[0] or 0, len(r[1])) for r in rows if r[1] and "the" in r[1] or r[1] and "der" in r[1])
    second = near(spark, docs, "")
    assert second.columns == docs.columns
    kept = sorted((str(r.doc_id), (r.text or "")[:6]) for r in second.collect())
    assert kept == sorted([("1", "the an"), ("2", "der di"), ("3", "the an"), ("4", "привет"), ("5", ""), ("6", ""), ("7", "12 34")])
    third = mixture(spark, docs, "")
    assert third.columns == docs.columns and {r.text for r in third.collect()} <= {r[1] for r in rows if r[1]}
    assert sorted(r.doc_id or 0 for r in tokens(spark, docs, "").collect()) == sorted(r[0] or 0 for r in rows)
