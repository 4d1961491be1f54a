"""The shared folder: given, made for local sessions, refused elsewhere."""

from types import SimpleNamespace

import pytest

from quirefold.plans.session import CHECKPOINT_DIR, shared_dir


def session(master, folder=None):
    kept = {CHECKPOINT_DIR: folder} if folder else {}
    conf = SimpleNamespace(get=kept.get, set=kept.__setitem__)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["local", "local[4]"])
def test_local_folder_is_made_once(master):
    s = session(master)
    assert shared_dir(s) == shared_dir(s) != ""


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_cluster_needs_a_folder(master):
    with pytest.raises(RuntimeError, match=CHECKPOINT_DIR):
        shared_dir(session(master))
    assert shared_dir(session(master, "hdfs://x/y/")) == "hdfs://x/y"
