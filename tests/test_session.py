"""The shared folder, with and without its setting, and settings that come back."""

import os
from types import SimpleNamespace

import pytest

from millrace import session


def fake(master, root=None, app="app-1"):
    held = {"spark.checkpoint.dir": root} if root else {}
    context = SimpleNamespace(master=master, applicationId=app, getConf=lambda: held)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: held.get(name, default)), sparkContext=context)


def test_the_setting_counts():
    assert session.shared_root(fake("spark://x", "s3://bucket/shared/")) == "s3://bucket/shared"


def test_local_sessions_without_it_keep_one_temporary_folder():
    one, other = fake("local[2]", app="test-a"), fake("local[2]", app="test-b")
    root = session.shared_root(one)
    assert os.path.isdir(root) and session.shared_root(one) == root != session.shared_root(other)


@pytest.mark.parametrize("master", ["yarn", "spark://x:1", "local-cluster[3,2,1024]"])
def test_clusters_without_it_are_an_error(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_root(fake(master))


def test_settings_come_back(spark):
    name, new = "spark.sql.shuffle.partitions", "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name), spark.conf.get(new, None)
    with pytest.raises(KeyError), session.settings(spark, {name: "3", new: "false"}):
        assert spark.conf.get(name) == "3" and spark.conf.get(new) == "false"
        raise KeyError
    assert (spark.conf.get(name), spark.conf.get(new, None)) == before
