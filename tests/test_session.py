import types

import pytest

from gleanspark import session


def fake(master, where=None):
    sc = types.SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda p: None)
    return types.SimpleNamespace(sparkContext=sc, conf=types.SimpleNamespace(get=lambda k, d=None: where))


def test_no_folder_of_one_machine_on_a_cluster():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]", "k8s://x"):
        with pytest.raises(RuntimeError, match="share"):
            session.ensure_checkpoint_dir(fake(master))
        assert session.ensure_checkpoint_dir(fake(master, "hdfs://shared/x")) == "hdfs://shared/x"
    assert session.ensure_checkpoint_dir(fake("local[4]")) and session.ensure_checkpoint_dir(fake("local"))
