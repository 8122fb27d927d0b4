import pytest

from auditlake import storage


class _Context:
    def __init__(self, master, held=None):
        self.master, self.held, self._jsc = master, held, self

    def sc(self):
        return self

    def getCheckpointDir(self):  # noqa: N802
        return self

    def isDefined(self):  # noqa: N802
        return self.held is not None

    def get(self, *_):
        return self.held

    def setCheckpointDir(self, path):  # noqa: N802
        self.held = path


class _Session:
    def __init__(self, master, conf=None, held=None):
        self.sparkContext, self.conf = _Context(master, held), self
        self.setting = conf

    def get(self, *_):
        return self.setting


def test_shared_folder_is_the_session_s():
    assert storage.shared_dir(_Session("spark://x", "hdfs://shared/")) == "hdfs://shared"
    assert storage.shared_dir(_Session("spark://x", None, "hdfs://held/")) == "hdfs://held"


def test_no_folder_of_one_machine_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(_Session("local-cluster[3,2,1024]"))
    session = _Session("local[2]")
    assert storage.shared_dir(session) == storage.shared_dir(session)


def test_staged_reads_back_what_it_wrote(spark):
    assert storage.staged(spark.range(5), "test").count() == 5
