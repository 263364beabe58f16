"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from evenhand.workspace import settle, shared_dir


def session(**conf):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)),
        sparkContext=SimpleNamespace(applicationId="app-1"))


def test_cluster_setting_is_used():
    assert shared_dir(session(**{"spark.checkpoint.dir": "hdfs://x/y/", "spark.master": "yarn"})) == "hdfs://x/y"


def test_local_session_gets_one_folder():
    local = session(**{"spark.master": "local[2]"})
    assert shared_dir(local) == shared_dir(local)


def test_cluster_without_setting_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session(**{"spark.master": "spark://host:7077"}))


def test_settled_table_is_not_written_again(spark):
    table = settle(spark.range(3))
    assert settle(table) is table
    assert sorted(r.id for r in table.collect()) == [0, 1, 2]
