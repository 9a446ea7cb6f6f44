import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, 4, "tests")
    yield s
    s.stop()


@pytest.fixture
def small_blocks(spark):
    """Cut every key of more than 40 rows into blocks, so the split plans are exercised."""
    spark.conf.set("spark.barline.blockRows", "40")
    spark.conf.set("spark.barline.measureBytes", "0")
    yield
    spark.conf.unset("spark.barline.blockRows")
    spark.conf.unset("spark.barline.measureBytes")
