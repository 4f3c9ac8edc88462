"""Where intermediate tables go."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from ledger_spark.staging import new_path, release, shared_folder


def session(master, folder=None, app="app-1"):
    """Just the parts of a session that name the folder."""
    conf = SimpleNamespace(get=lambda name, default=None: folder or default)
    context = SimpleNamespace(master=master, applicationId=app, getConf=lambda: conf)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_configured_folder_is_used_everywhere():
    for master in ("local[8]", "yarn"):
        assert shared_folder(session(master, "hdfs:///shared")) == "hdfs:///shared"
    assert new_path(session("yarn", "s3://bucket/x/"), "a").startswith("s3://bucket/x/ledger_spark/app-1/a-")


def test_local_session_gets_one_folder_of_its_own():
    first = shared_folder(session("local[8]"))
    assert shared_folder(session("local[8]")) == first
    assert shared_folder(session("local[8]", app="app-2")) != first


def test_cluster_without_a_folder_is_refused():
    with pytest.raises(ValueError):
        shared_folder(session("yarn"))


def test_release_deletes_what_was_staged(tmp_path):
    app = session("yarn", str(tmp_path), "app-9")
    folder = tmp_path / "ledger_spark" / "app-9" / "x"
    folder.mkdir(parents=True)
    release(app)
    assert not folder.parent.exists() and tmp_path.exists()
    release(app)
