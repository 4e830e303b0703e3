import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidewright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="8g",
                            spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
                            spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny(spark):
    """15-minute steps with one missing, one not-a-number and one negative value."""
    nan = float("nan")
    rows = [(f"2016-01-01 {i // 4:02d}:{15 * (i % 4):02d}:00", v, float(i))
            for i, v in enumerate([1.0, None, 3.0, nan, -5.0, 6.0, 7.0, 8.0])]
    return spark.createDataFrame(rows, "t string, v double, w double") \
        .selectExpr("cast(t as timestamp_ntz) as ts", "v", "w")
