"""The pipeline: contracts of the stages, and its rows against the stages run one by one."""

import __spark_entry__ as entry
import corpus_pipeline
from serieslake.llm import queries
from serieslake.llm.common import mark, settle, sweep
from tables import awkward, documents, prose

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_survive_awkward_rows(spark):
    docs = documents(spark, awkward(), extra=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == len(awkward())


def test_the_classifier_gets_each_text_once(spark):
    plan = corpus_pipeline.keep_good(spark, documents(spark, awkward(), extra=True), FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("MapInArrow", 1)[1]
    assert "struct(" not in below and "__text" not in below.splitlines()[0]


def test_run_equals_the_stages_in_order(spark, tmp_path):
    want = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, want, FOLDER).write.parquet(f"{tmp_path}/{number}")
        want = spark.read.parquet(f"{tmp_path}/{number}")
        sizes.append(want.count())
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert 0 < sizes[-1] < 200 and sizes == sorted(sizes, reverse=True)


def test_near_copies_between_the_thresholds_go(spark):
    text = " ".join(prose(40, 300).split())
    cut = " ".join(text.split()[:246])  # 5-word Jaccard similarity 0.82
    got = corpus_pipeline.keep_one_of_each(spark, documents(spark, [(1, text), (2, cut), (3, prose(41, 300))]), FOLDER)
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3]


def test_a_leak_takes_no_other_text_of_its_id_along(spark, tmp_path):
    spark.createDataFrame([(1, prose(61, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean, leaking = prose(62, 40), prose(63, 20) + " " + prose(61, 20)
    docs = documents(spark, [(None, leaking), (None, clean), (None, None), (4, clean), (4, leaking), (4, leaking)], extra=True)
    got = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(None, clean), (None, None), (4, clean)], key=repr)


def test_a_sweep_leaves_what_was_settled_before_its_mark(spark):
    before = settle(spark.range(5), "before")
    since = mark()
    after = settle(spark.range(7), "after")
    assert after.count() == 7
    sweep(spark, since)
    assert before.count() == 5 and mark() == since


def test_an_unread_result_outlasts_a_run(spark):
    unread = queries.op8_token_files(spark, FOLDER)
    corpus_pipeline.run(spark, FOLDER)
    assert unread.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_registration():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and len(set(names)) == 5
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
