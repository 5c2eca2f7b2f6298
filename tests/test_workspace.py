"""Where tables that queries build go."""

from types import SimpleNamespace

import pytest

from stratalake.plans.workspace import new_folder


def session(master, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, getConf=dict)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder or default), sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    assert new_folder(session("spark://a:7077", "s3a://b/shared/"), "x").startswith("s3a://b/shared/x-")
    assert new_folder(session("local[2]"), "x").startswith("file:///")
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        new_folder(session("spark://a:7077"), "x")
