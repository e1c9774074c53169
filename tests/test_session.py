"""The shared folder of a session: what the cluster names is used as it is."""

from types import SimpleNamespace

import pytest

from ratecraft.session import checkpoint_root, scratch_path


class _Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def _session(master, folder=None, conf=None):
    return SimpleNamespace(sparkContext=_Context(master, folder), conf=conf or {})


@pytest.mark.parametrize("folder", ["file:///mnt/shared/checkpoints", "/mnt/shared/checkpoints", "hdfs://a/b"])
@pytest.mark.parametrize("set_on_context", [True, False])
def test_cluster_uses_the_folder_it_names(folder, set_on_context):
    spark = _session("spark://host:7077", folder) if set_on_context else \
        _session("spark://host:7077", conf={"spark.checkpoint.dir": folder})
    assert checkpoint_root(spark) == folder
    assert scratch_path(spark, "x").startswith(f"{folder}/ratecraft/x-")


def test_cluster_without_a_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(_session("spark://host:7077"))


def test_local_session_gets_a_folder():
    assert checkpoint_root(_session("local[2]"))
