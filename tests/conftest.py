import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from barloom.session import local_session

    s = local_session(8, "barloom-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def panel(spark):
    """Random-walk bars of six symbols, 300 sessions."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    parts = []
    for k in range(6):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 300)))
        o = np.r_[c[0], c[:-1]] * (1 + rng.normal(0, 0.004, 300))
        parts.append(pd.DataFrame({
            "symbol": f"S{k}", "date": pd.bdate_range("2020-01-01", periods=300).date, "open": o,
            "high": np.maximum(o, c) * 1.01, "low": np.minimum(o, c) * 0.99, "close": c,
            "volume": rng.integers(100, 1000, 300).astype(float), "sector": "A" if k < 3 else "B"}))
    return pd.concat(parts, ignore_index=True)
