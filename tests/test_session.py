"""Where intermediate tables go, and that they go away."""

import os
from types import SimpleNamespace

import pytest

from saidso.session import materialize, private_folder, run_folder


def test_a_cluster_without_a_shared_folder_is_refused():
    for master in ("spark://host:7077", "yarn", "k8s://https://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            private_folder(SimpleNamespace(master=master))


def test_a_run_leaves_no_files(spark):
    with run_folder(spark) as folder:
        assert materialize(spark.range(10)).count() == 10
        path = folder.removeprefix("file:")
        assert os.listdir(path)
    assert not os.path.exists(path)
