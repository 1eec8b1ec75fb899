from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as C
from kindred.llm import quality
from kindred.shared import materialize

from .conftest import odd_rows
from .test_dedup import brute_components, brute_exact
from .test_tokens import check_pieces, reference_ids


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_on_the_small_tables(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in C.STAGES:
        before = rows_of(docs)
        out = materialize(stage(spark, docs, sf_dir), name)
        if name == "packing":
            check_pieces(out.collect(), before, reference_ids(tokenizer, before))
            break
        assert out.columns == columns
        after = Counter(rows_of(out))
        if name == "quality":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
            p = quality.classify(docs, labels).where("predicted = 1").select("doc_id").collect()
            assert sorted(i for i, _ in after.elements()) == sorted(r.doc_id for r in p)
        elif name == "exact_dedup":
            assert sorted(i for i, _ in after.elements()) == sorted(r[0] for r in brute_exact(before) if r[3])
        elif name == "near_dedup":
            assert sorted(i for i, _ in after.elements()) == sorted(i for i, _, c in brute_components(before) if i == c)
        else:
            assert set(after) == set(before) and max(after.values()) <= 2
        docs = out
    got = C.run(spark, sf_dir)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in out.collect())


def test_stages_on_odd_rows(spark, odd, none, sf_dir, tmp_path):
    spark.createDataFrame([(i, 1, 0) for i, _ in odd_rows() if i], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd
    for name, stage in C.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == odd.columns
    assert None in {i for i, _ in rows_of(docs)}
    assert C.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()
    for _, stage in C.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_no_text_of_a_repeated_doc_id_is_lost(spark):
    """Rows are dropped by doc_id and text: what only document 2 has stays, though another text of its doc_id goes."""
    rows = [(1, "alpha"), (2, "alpha"), (2, "another text"), (3, "another  text"), (None, "alpha"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_d", F.lit(1)).withColumn("_v", F.lit(2))
    out = C.exact_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(rows_of(out), key=str) == sorted([(1, "alpha"), (2, "another text"), (None, "alpha"), (4, None)], key=str)
    words = " ".join(f"w{i}" for i in range(60))
    near = [(1, words), (2, words + " end"), (2, "quite another text of its own"), (3, "quite another text of its own!")]
    out = C.near_stage(spark, spark.createDataFrame(near, "doc_id long, text string"), "")
    assert sorted(rows_of(out)) == [(1, words), (2, "quite another text of its own"), (3, "quite another text of its own!")]
