import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cytoquilt.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def frame(spark):
    """rows + DDL -> DataFrame spread over a few partitions."""

    def make(rows, ddl, parts=3):
        return spark.createDataFrame(rows, ddl).repartition(parts)

    return make


def one(df, c):
    return [r[0] for r in df.select(c.alias("v")).collect()]
