"""The pipeline's stages, one after another, on a small table."""

import hashlib
import os

import pytest

pytestmark = pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="the public vocabularies aren't here")


def test_stages(spark, corpus, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(d, t, lang, source, len(t)) for d, t, source, lang in corpus] + [(7000, "123 456", "en", "src1", 7), (7001, None, None, None, None), (None, "nobody has this text at all", "en", "src0", 27)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert made.columns == docs.columns and made.dtypes == docs.dtypes, name
        made.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
    ids = [{r["doc_id"] for r in rows} for rows in kept]
    assert 7000 not in ids[0] and 7001 not in ids[0] and None in ids[0] and len(kept[0]) == len(corpus) + 1
    assert ids[1] == ids[0] and all(r["n_chars"] == len(r["text"]) for r in kept[1])
    assert sum(len(r["text"]) for r in kept[1]) < sum(len(r["text"]) for r in kept[0])
    from tests.llm.test_text_operators import groups_brute

    groups = groups_brute([(r["doc_id"], r["text"]) for r in kept[1] if r["doc_id"] is not None], 5, 80)
    assert ids[2] == {d for d, n, g in groups if d == g} | {None} and len(kept[2]) == len(ids[2])
    assert ids[3] <= ids[2] and len(kept[4]) == len(kept[3])
    texts = {r["doc_id"]: r["text"] for r in kept[3]}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) for r in kept[4])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, kept[4]))


def test_odd_texts_and_an_empty_table(spark, odd_texts, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for name, texts in (("odd", odd_texts), ("empty", [])):
        rows = [(k, t, "en" if k % 2 else "de", None if k % 3 else "s", len(t or "")) for k, t in enumerate(texts)]
        rows += rows[3:4] + [(None, "text of no one", "en", "s", 14)] * bool(rows)
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        made = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        whole = {hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in rows}
        assert {r["decoded_sha256"] for r in made} <= whole and bool(made) == bool(rows)
        if rows:  # the long ones go through whole
            assert {r["n_tokens"] for r in made if r["doc_id"] == 3} and max(r["n_tokens"] for r in made) > 60_000


def test_what_stages_have_read_is_deleted(spark, corpus, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(d, t, lang, source, len(t)) for d, t, source, lang in corpus[:30]]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    from tidewater.llm.cluster import checkpoint_folder

    folder = checkpoint_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, str(tmp_path)).count()
    (made,) = [x for x in set(os.listdir(folder)) - before if x.startswith("pipeline-")]
    assert os.listdir(f"{folder}/{made}") == ["3"]


def test_queries_and_sql_agree_in_name():
    from tidewater.llm.queries import ORACLE_SQL, QUERIES

    assert set(ORACLE_SQL) <= set(QUERIES) and sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
