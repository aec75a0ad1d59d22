"""The corpus pipeline, stage by stage, against plain versions of what each stage decides, on the smallest tables and odd rows."""

import re

import pytest

import corpus_pipeline
from ledgerloom.llm import mixing, simhash
from ledgerloom.llm.common import Workspace, table

SF = "/root/testdata/sf0.001"


def through(spark, docs, sf_dir):
    """Output of each stage, written and read again."""
    space, out = Workspace(spark, "pipeline-test"), [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(space.save(stage(spark, out[-1], sf_dir), str(k)))
    return out


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF, "documents")
    one = docs.orderBy("doc_id").limit(40)
    extra = one.selectExpr("doc_id + 100000 AS doc_id", "concat(text, ' \n') AS text", "lang", "CAST(NULL AS STRING) AS source", "n_chars").unionByName(one)
    odd = spark.createDataFrame([(900_000, None, None, None, None), (900_001, "", "en", "x", 0), (None, None, None, None, None)], docs.schema)
    return through(spark, Workspace(spark, "pipeline-in").save(docs.unionByName(extra).unionByName(odd), "docs"), SF)


def test_columns_and_rows(stages):
    assert [s.columns for s in stages[:-1]] == [stages[0].columns] * 5
    sizes = [s.count() for s in stages]
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4] == sizes[5] > 0


def test_quality_rejects_short_and_empty(stages):
    for r in stages[1].collect():
        assert len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) >= 50


def test_one_of_equal_texts_stays(stages):
    groups = {}
    for r in stages[1].collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"]), []).append((-len(r["text"]), r["doc_id"]))
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(min(g)[1] for g in groups.values())


def test_one_of_each_near_group_stays(stages):
    of = {r["id"]: r["component_id"] for r in simhash.groups(stages[2]).collect()}
    left = [of[r["doc_id"]] for r in stages[3].collect()]
    assert len(left) == len(set(left)) and set(left) == set(of.values())


def test_result_has_the_order_of_the_mix(stages):
    rows = stages[3].selectExpr("doc_id AS id", "source")
    want = [r["id"] for r in mixing.mix(rows, [], ties=[]).orderBy("slot", "place").collect()]
    got = [r["doc_id"] for r in stages[5].orderBy("mix_part", "mix_row").collect()]
    assert got == want and len(got) > 20


def test_run_and_an_empty_table(spark, stages, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    for name in ("documents", "labels"):
        table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
