"""The pipeline stage by stage against plain Python, odd rows, and the rest of the library without it."""

import os
import shutil
import subprocess
import sys

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lectern.llm.common import saved

from .test_pairs import brute_substrings

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("mine"))
    odd = spark.createDataFrame([(90001, None, "en", None, 0, "mine"), (90002, "", None, "s", None, "mine"), (90003, "�" * 500, "en", "s", 500, "mine")], docs.schema)
    out = [docs.unionByName(odd)]
    for name, stage in corpus_pipeline.STAGES:
        out.append(saved(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_all_but_the_last_stage_keep_the_columns(outputs):
    for out in outputs[1:-1]:
        assert out.columns == outputs[0].columns and out.where("score <> 'mine'").isEmpty()
    ids = [{r.doc_id for r in o.select("doc_id").collect()} for o in outputs]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] and ids[3] == ids[4] == ids[5] and len(ids[3]) > 100


def test_rejections_follow_the_labels(spark, outputs):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = [{r.doc_id for r in o.select("doc_id").collect()} for o in outputs[:3]]
    good = [i for i in ids[0] if i in labels and labels[i].quality == 1]
    assert sum(i in ids[1] for i in good) >= 0.97 * len(good)
    clean = [i for i in ids[1] if i in labels and labels[i].toxic == 0]
    assert sum(i in ids[2] for i in clean) >= 0.95 * len(clean)


def test_near_duplicates_leave_one_of_each_group(outputs):
    rows = {r.doc_id: r.text or "" for r in outputs[2].select("doc_id", "text").collect()}
    sets, root = {}, {i: i for i in rows}
    for i, t in rows.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in rows:
        for b in rows:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id for r in outputs[3].select("doc_id").collect()} == {i for i in rows if find(i) == i}


def test_substrings_are_removed_from_texts(outputs):
    before = {r.doc_id: r.text for r in outputs[3].collect()}
    after = {r.doc_id: r for r in outputs[4].collect()}
    ids = sorted(before)
    for i, (_, removed, _, left) in zip(ids, brute_substrings([(before[i] or "").encode() for i in ids])):
        assert after[i].text == (left.decode("utf-8", "ignore") if removed else before[i])
        assert not removed or after[i].n_chars == len(after[i].text)


def test_packing_covers_what_is_left(outputs):
    assert outputs[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
    assert outputs[5].where("piece = 0").count() == outputs[4].count()


def test_the_rest_works_without_these_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not [x for x in q if x[:2] == 'op' or x == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=60)
