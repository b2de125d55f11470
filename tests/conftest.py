import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lakewright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        master="local[8]",
        spark_sql_shuffle_partitions=8,
        spark_ui_enabled="false",
        spark_driver_memory="8g",
        spark_checkpoint_dir=f"file://{tmp_path_factory.mktemp('shared')}",
        spark_cleaner_referenceTracking_cleanCheckpoints="true",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def settings(spark):
    """Sets session configuration for one test."""
    old = {}

    def apply(values):
        for key, value in values.items():
            old[key] = spark.conf.get(key, None)
            spark.conf.set(key, value)

    yield apply
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
