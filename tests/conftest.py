import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from barloom.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "barloom-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_bars(spark):
    """Bars from (open, high, low, close) rows, one per minute from the start of 2024."""
    import datetime as dt

    def make(rows, symbol="s", volume=1.0, start=dt.datetime(2024, 1, 1)):
        data = [
            (symbol, (start + dt.timedelta(minutes=i)).year, start + dt.timedelta(minutes=i), *map(float, r), volume)
            for i, r in enumerate(rows)
        ]
        schema = (
            "symbol string, year int, ts timestamp_ntz, open double, high double, low double, close double, volume double"
        )
        return spark.createDataFrame(data, schema).coalesce(1)

    return make


@pytest.fixture(scope="session")
def walk():
    """A reproducible random walk as bar rows in cents."""
    import numpy as np

    def make(n, seed=0, step=0.5):
        rng = np.random.default_rng(seed)
        close = np.round(100 + np.cumsum(rng.normal(0, step, n)), 2)
        open_ = np.round(np.concatenate([[100.0], close[:-1]]) + rng.normal(0, step / 4, n), 2)
        high = np.round(np.maximum(open_, close) + np.abs(rng.normal(0, step / 2, n)), 2)
        low = np.round(np.minimum(open_, close) - np.abs(rng.normal(0, step / 2, n)), 2)
        return list(zip(open_.tolist(), high.tolist(), low.tolist(), close.tolist()))

    return make
