import pytest
from pyspark.sql import functions as F

from tamhis.plans.profile import ProfileStore, profile
from tamhis.workspace import shared_dir, written
from workloads import adapters as A
from workloads.queries import QUERIES


#: Entry of the profile -> registered query with the same rows.
KEYS = {
    "column_profile": "column_profile", "duplicate_rows": "duplicate_rows", "describe": "describe_lengths",
    "describe_counts": "describe_numeric", "histogram": "length_histogram", "ecdf": "length_ecdf",
    "boxplot": "boxplot_overall", "violin": "violin_summary", "scatter": "scatter_bins", "pair_matrix": "pair_matrix",
    "pair_diagonal": "pair_diagonal", "category_counts": "category_counts", "category_share": "category_share",
    "top_category_boxplot": "top_category_boxplot", "top_category_mean": "top_category_mean_ci",
    "correlations": "corr_matrix", "top_words_questions": "top_words_questions", "top_words_answers": "top_words_answers",
}
CURVES = {"kde": "overlap", "histogram_curve": "histogram"}


def rows(df):
    """Rows in order, numbers apart: the queries round theirs."""
    names = sorted(df.columns)
    found = [[r[c] for c in names] for r in df.collect()]
    found.sort(key=lambda r: ([str(v) for v in r if not isinstance(v, float)], [v for v in r if isinstance(v, float)]))
    return ([[v for v in r if not isinstance(v, float)] for r in found],
            [v for r in found for v in r if isinstance(v, float)])


def same_rows(left, right):
    (a, x), (b, y) = rows(left), rows(right)
    return a == b and y == pytest.approx(x, rel=1e-5, abs=1e-5)


def test_every_entry_of_the_profile_equals_its_query(spark):
    sf = "/root/testdata/sf0.001"
    got = profile(A.raw_qa(spark, sf))
    assert set(got) == {*KEYS, *CURVES}
    for entry, key in KEYS.items():
        want = QUERIES[key](spark, sf)
        assert same_rows(got[entry].select(want.columns), want), entry
    curves = QUERIES["length_kde"](spark, sf)
    for entry, curve in CURVES.items():
        assert same_rows(got[entry], curves.filter(f"curve = '{curve}'").drop("curve")), entry


def test_profile_has_every_summary(spark):
    got = profile(A.raw_qa(spark, "/root/testdata/sf0.001"))
    assert [name for name, df in got.items() if df.count() == 0] == []
    assert got["kde"].filter("density < 0").count() == 0
    assert {r.series for r in got["describe"].collect()} == {"Q Len", "A Len", "Q Words", "A Words"}


class _Session:
    """Stands in for a session on a cluster without a shared folder."""

    def __init__(self, master, configured=None):
        self.sparkContext = self
        self.master, self.configured = master, configured

    def getConf(self):
        return {"spark.checkpoint.dir": self.configured}

    def getCheckpointDir(self):
        return None


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(_Session(master))
    assert shared_dir(_Session("yarn", "hdfs:///shared")) == "hdfs:///shared"


def test_a_profile_kept_by_batches_equals_that_of_all_rows(spark, tmp_path):
    raw = written(A.raw_qa(spark, "/root/testdata/sf0.001"), "raw")
    store = ProfileStore(spark, str(tmp_path / "profile"))
    assert store.profile()["duplicate_rows"].first() == (0, 0, 0)
    for batch, (low, high) in enumerate([(0, 50), (50, 60), (60, 10 ** 9)]):
        part = raw.filter((F.col("row_id") >= low) & (F.col("row_id") < high))
        store.add(part, batch)
        if batch == 1:
            store.add(part, batch)  # runs again and takes effect once
    got, want = store.profile(), profile(raw)
    assert set(got) == set(want)
    for entry in want:
        assert same_rows(got[entry].select(want[entry].columns), want[entry]), entry
    # no texts are stored but the words
    assert not {"question", "reply", "q_body", "a_body"} & {c for t in (store.measures, store.columns, store.digests, store.words) for c in t.schema.names}
