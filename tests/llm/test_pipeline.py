"""The pipeline's stages against what their operators say, and against brute force."""

import re

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from bindloom.llm import langid, quality, queries


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.cache())
    return [spark.read.parquet(f"{sf_dir}/documents.parquet").cache(), *out]


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_keep_columns_and_only_drop(steps):
    for before, after in zip(steps, steps[1:-1], strict=False):
        assert after.columns == before.columns and set(ids(after)) <= set(ids(before))
    assert ids(steps[-1]) == ids(steps[-2]) and len(ids(steps[-1])) == len(set(ids(steps[-1]))) > 0


def test_language_and_quality_keep_what_they_accept(steps, spark, sf_dir):
    model = queries.language_model(steps[0])
    assert ids(steps[1]) == ids(langid.predict(steps[0], model).where("lang_pred <> 'und' and not ambiguous"))
    model = queries.quality_model(steps[1], queries.table(spark, sf_dir, "labels"))
    assert ids(steps[2]) == ids(quality.score(steps[1], model).where(f"score >= {queries.GOOD}"))


def test_no_near_copies_are_left(steps):
    from test_scans import all_pairs_classes

    left = [(r["doc_id"], r["text"]) for r in steps[3].collect()]
    assert all(len(g) == 1 for g in all_pairs_classes(left))
    groups = all_pairs_classes([(r["doc_id"], r["text"]) for r in steps[2].collect()])
    assert len(groups) == len(left)


def test_no_contaminated_document_is_left(steps, spark, sf_dir):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def windows(w):
        k = min(8, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    items = [windows(words(r["text"])) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    before = {r["doc_id"]: windows(words(r["text"])) for r in steps[3].collect()}
    clean = sorted(i for i, w in before.items() if not any(w & x for x in items))
    assert ids(steps[4]) == clean


def test_the_end_is_the_librarys_encoding(steps, byte_bpe):
    t = Tokenizer.from_file(byte_bpe)
    texts = {r["doc_id"]: r["text"] for r in steps[4].collect()}
    assert all(r["n_tokens"] == len(t.encode(texts[r["doc_id"]], add_special_tokens=False).ids) for r in steps[5].collect())


def test_run_is_all_stages(steps, spark, sf_dir):
    assert sorted(map(repr, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(repr, steps[5].collect()))


def test_other_columns_and_repeated_rows(spark, sf_dir, messy):
    docs = messy.where("doc_id is not null")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = out


def test_a_document_with_one_planted_passage_goes(spark, tmp_path):
    item = [f"item{i}" for i in range(30)]
    spark.createDataFrame([(1, " ".join(item)), (2, " ".join(f"other{i}" for i in range(30)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [" ".join(["before", *item, "after"]), " ".join(["one", "window", *item[4:12], "only"]), " ".join(["seven", "words", *item[4:11], "only"]), "nothing of it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert ids(corpus_pipeline.clean(spark, docs, str(tmp_path))) == [2, 3]


def test_null_ids_and_an_empty_table(spark, sf_dir, messy, nothing):
    docs = messy.where("doc_id is null or doc_id < 6")
    for name, stage in corpus_pipeline.STAGES[2:4]:  # stages that learn nothing from the rows
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == messy.columns, name
    assert docs.where("doc_id is null").count() == 1
    for _, stage in corpus_pipeline.STAGES[2:]:
        assert stage(spark, nothing, sf_dir).count() == 0
