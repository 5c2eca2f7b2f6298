"""The shared folder of the operators."""

from types import SimpleNamespace

import pytest

from stratalake.llm.shared import shared_folder


def session(master, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder, getConf=dict, setCheckpointDir=lambda path: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder or default), sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    assert shared_folder(session("spark://a:7077", "s3a://b/shared")) == "s3a://b/shared"
    assert shared_folder(session("local[2]")).startswith("file:///")
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_folder(session("spark://a:7077"))
