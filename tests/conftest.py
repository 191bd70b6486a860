import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from masklake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", spark_sql_shuffle_partitions="4", spark_driver_memory="4g",
                            spark_checkpoint_dir=str(tmp_path_factory.mktemp("checkpoint")))
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
