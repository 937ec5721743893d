"""The pipeline's stages take effect, each on what the one before kept, whatever the table holds."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import mixing, neardup, secrets, toxicity
from tests.llm.conftest import awkward_rows
from tests.llm.test_groups import groups, toxic_corpus

SF = "/root/testdata/sf0.001"
#: Names that operators might use for themselves.
CLASHES = "_score _row _own _n _uid _sig _id _copy copies uid set row own id times copy score gap part parts key class n node root digest"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder with documents (toxic ones, near and exact copies, secrets, awkward texts, clashing columns) and labels."""
    path = tmp_path_factory.mktemp("planted")
    rows = [(i, t, y) for i, t, y in toxic_corpus(600)]
    base = " ".join(f"word{i}" for i in range(100))
    rows += [(1000 + i, base.replace(f"word{i} ", "changed "), 0) for i in range(5)] + [(1010, base, 0), (1011, base, 0)]
    rows += [(1020, "password=livevalue987xyz for one owner", 0), (1030, None, 0), (1031, "", 0), (None, "no id here", 0), (None, None, 0), (1032, "x " * 5000, 0)]
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 4}", len(t or "")) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHES.split():
        docs = docs.withColumn(c, F.lit(f"mine {c}"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_stages_on_planted_cases(spark, planted):
    path, rows = planted
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = stage(spark, docs, path).cache()
        after = kept[name] = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            assert all(r[c] == f"mine {c}" for r in after for c in CLASHES.split()), name
        ids = lambda rs: [r.doc_id for r in rs]
        if name == "toxicity":
            truth = {i: y for i, _, y in rows}
            gone = [i for i in truth if i not in set(ids(after))]
            assert sum(truth.values()) * 0.9 <= sum(truth[i] for i in gone) and sum(1 - truth[i] for i in gone) <= 5
        if name == "near_dedup":  # brute force over what came in
            texts = [(k, r.text) for k, r in enumerate(before)]  # row numbers stand for ids, so null and repeated ones are told apart
            want, _ = groups(texts, words=5)
            least = {}
            for k, c in enumerate(want):
                least.setdefault(c, []).append((before[k].doc_id is None, before[k].doc_id))
            assert sorted(map(repr, (min(v) for v in least.values()))) == sorted(repr((r.doc_id is None, r.doc_id)) for r in after)
            assert {1010, 1011} & set(ids(after)) <= {1010} and 1000 in ids(after)
        if name == "secrets":
            changed = {r.doc_id: r.text for r in after}
            assert changed[1020] == "password=[secret] for one owner"
            assert sorted((r.doc_id or -1, re.sub("livevalue987xyz", "[secret]", r.text or "")) for r in before) == sorted((r.doc_id or -1, r.text or "") for r in after)
        if name == "mixing":
            assert set(ids(after)) <= set(ids(before)) and {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
        if name == "packing":
            assert sum(len(r.text) for r in after) == sum(len(r.text or "") for r in before) and set(ids(after)) == set(ids(before))


@pytest.mark.parametrize("which", ["awkward", "none_at_all"])
def test_stages_pass_awkward_and_empty_tables(spark, which, request):
    docs = request.getfixturevalue(which)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        n = out.count()
        assert n == 0 if which == "none_at_all" else 0 < n, name
        if name != "packing":
            assert out.columns == docs.columns, name


def test_helper_columns_take_free_names(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t, *_ in awkward_rows()], "doc_id long, body string, source string").withColumn("lang", F.lit("en"))
    for c in CLASHES.split():
        df = df.withColumn(c, F.lit(c))
    got = secrets.masked(df, text_col="body")
    assert got.columns == df.columns and got.count() == df.count()
    got = neardup.deduplicated(df, text_col="body")
    assert got.columns == df.columns and got.where("copies = 'copies' and uid = 'uid'").count() == got.count()
    docs = df.withColumnRenamed("body", "text")
    rates = docs.select("doc_id").distinct().withColumn("copies", F.lit(2).cast("long"))
    got = mixing.mixed(docs, rates)
    assert got.columns == docs.columns and got.count() == 2 * docs.count() and got.where("copies = 'copies' and id = 'id'").count() == got.count()
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    got = toxicity.not_toxic(docs, labels)
    assert got.columns == docs.columns and got.where("score = 'score' and _score = '_score'").count() == docs.count()
