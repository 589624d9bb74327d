"""Every registered query against its SQL, and the shape of the plans."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from check_oracle import connect, same
from workloads.oracle import ORACLE_SQL
from workloads.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_registry():
    assert set(ORACLE_SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    assert same(QUERIES[key](spark, SF), con, ORACLE_SQL[key]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("blocked", ["tamhis.llm", "corpus_pipeline", "tokenizers", "xxhash", "public_tokenizers", "duckdb"])
def test_the_other_queries_survive_a_missing_optional_package(blocked):
    code = f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(entry.__file__), capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and out.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL))], out.stderr


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_curation_is_one_scan_one_shuffle_and_no_python(spark):
    text = plan(entry.queries()["curate_qa"](spark, SF))
    assert text.count("FileScan") == 1 and text.count(" Exchange ") == 1
    assert text.count("WindowGroupLimit") == 2
    assert "EvalPython" not in text and "InPandas" not in text


@pytest.mark.parametrize("key", [
    "describe_numeric", "length_histogram", "boxplot_overall", "length_kde", "violin_summary", "length_ecdf",
    "pair_diagonal", "column_profile"])
def test_summaries_read_the_texts_once(spark, key):
    assert plan(entry.queries()[key](spark, SF)).count("FileScan") == 1


@pytest.mark.parametrize("key", sorted(k for k in QUERIES if not k.startswith("stream_")))
def test_no_cross_joins(spark, key):
    text = entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
