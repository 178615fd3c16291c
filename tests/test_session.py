"""The shared folder, with and without the setting, and writes at the same time."""

import subprocess
import sys
import threading
from pathlib import Path

import pytest

from wharfline import session as S

ROOT = Path(__file__).resolve().parent.parent


def test_an_unset_folder_in_a_local_session(tmp_path):
    """Another process, as the setting belongs to the application; its configuration folder is empty."""
    code = """
from wharfline.session import session, shared_dir, store
s = session("local[1]", spark__ui__enabled="false")
assert s.conf.get("spark.checkpoint.dir", None) is None
assert store(s.range(5)).count() == 5 and shared_dir(s) == shared_dir(s)
s.stop()
"""
    env = {"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ":".join([str(ROOT), *sys.path])}
    done = subprocess.run([sys.executable, "-c", code], env=env | {k: v for k, v in __import__("os").environ.items() if k in ("JAVA_HOME", "SPARK_HOME", "PATH")}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_an_unset_folder_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "a"

    class Spark:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.shared_dir(Spark())


def test_writes_at_once_leave_the_setting_alone(spark):
    before = spark.conf.get(S.SHUFFLE_CLEANUP, None)
    out = []
    threads = [threading.Thread(target=lambda k=k: out.append(S.store(spark.range(100).repartition(3)).count())) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert out == [100] * 4 and spark.conf.get(S.SHUFFLE_CLEANUP, None) == before
