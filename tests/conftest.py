import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from counterpane.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session(cpus=4, partitions=2, name="tests")


def panel_of(spark, arrays, first_id=0, **columns):
    """A panel from a list of (T, C) arrays; extra columns are lists."""
    rows = [(first_id + i, int(a.shape[0]), int(a.shape[1]), [float(v) for v in a.ravel()],
             *[values[i] for values in columns.values()]) for i, a in enumerate(arrays)]
    kinds = "".join(f", {name} {'double' if isinstance(v[0], float) else 'int' if isinstance(v[0], int) else 'array<double>'}"
                    for name, v in columns.items())
    return spark.createDataFrame(rows, "series_id bigint, t_len int, n_ch int, x array<double>" + kinds)


@pytest.fixture
def rng():
    return np.random.default_rng(7)
