import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from surveyloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8, **{"spark.ui.showConsoleProgress": "false"})
    yield session
    session.stop()


@pytest.fixture
def partitions(spark):
    """Set shuffle partitions for one test."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)
