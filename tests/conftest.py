import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from coreloom.session import build_session

    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def vectors(spark):
    """Three well separated groups of 40 rows in four dimensions; the last feature is constant."""
    import random

    rng = random.Random(7)
    rows = []
    for i in range(120):
        label = i % 3
        x = [10.0 * label + rng.gauss(0, 1), rng.gauss(0, 1), 5.0 * (label == 1) + rng.gauss(0, 1), 3.0]
        rows.append((i, label, x))
    return spark.createDataFrame(rows, "row_id bigint, label int, features array<double>")
