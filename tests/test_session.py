import pytest

from vecloom import session as S


class FakeSession:
    def __init__(self, master, folder=None):
        self.sparkContext = type("C", (), {"master": master, "applicationId": f"app-{master}"})()
        self.conf = type("F", (), {"get": staticmethod(lambda name, default=None: folder)})()


def test_shared_folder_is_the_one_the_cluster_names():
    assert S.shared_dir(FakeSession("yarn", "hdfs:///shared")) == "hdfs:///shared"
    assert S.new_path(FakeSession("yarn", "hdfs:///shared/"), "t").startswith("hdfs:///shared/t-")


def test_a_cluster_without_shared_folder_is_refused():
    with pytest.raises(RuntimeError):
        S.shared_dir(FakeSession("yarn"))


def test_local_mode_has_its_own_folder():
    one = S.shared_dir(FakeSession("local[2]"))
    assert one == S.shared_dir(FakeSession("local[2]"))


def test_cut_lineage_reads_what_it_wrote(spark):
    df = spark.range(10)
    cut = S.cut_lineage(df)
    assert cut.dtypes == df.dtypes and cut.count() == 10
    assert "FileScan parquet" in cut._jdf.queryExecution().executedPlan().toString()
