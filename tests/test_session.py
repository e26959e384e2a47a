import pytest

from furrow import session as S


class FakeContext:
    applicationId = "app-1"

    def __init__(self, master):
        self.master = master


class FakeSession:
    """Only what the choice of the folder looks at."""

    def __init__(self, master, configured=None):
        self.sparkContext = FakeContext(master)
        self.conf = {S.CHECKPOINT_KEY: configured} if configured else {}


def test_the_shared_folder_comes_from_the_session():
    assert S.shared_dir(FakeSession("yarn", "hdfs://c/shared/")) == "hdfs://c/shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.shared_dir(FakeSession("yarn"))
    local = S.shared_dir(FakeSession("local[2]"))
    assert S.shared_dir(FakeSession("local[2]")) == local


def test_small_tables_keep_types_and_nulls(spark):
    rows = [(1, "a|,\"", ["x", "y"], None), (2, None, [], 1.5)]
    df = S.small_table(spark, rows, "n int, t string, l array<string>, d double")
    assert sorted(map(tuple, df.collect())) == rows
    assert [t for _, t in df.dtypes] == ["int", "string", "array<string>", "double"]
