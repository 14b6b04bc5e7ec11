import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fleetsig.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "2",
            "spark.sql.codegen.wholeStage": "false",
            "spark.sql.adaptive.enabled": "false",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sliced(spark):
    """Run an operator under several slice widths (seconds)."""
    def widths(*seconds):
        for s in seconds:
            spark.conf.set("spark.fleetsig.slice.seconds", str(s))
            yield s
        spark.conf.unset("spark.fleetsig.slice.seconds")

    yield widths
    spark.conf.unset("spark.fleetsig.slice.seconds")
