import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quillspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"},
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column over one row of named text values."""
    from pyspark.sql import functions as F

    def run(build, **values):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
        return row.select(build(*[F.col(k) for k in values]).alias("r")).first()["r"]

    return run
