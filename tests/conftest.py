import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from compare import make_session
    return make_session()


@pytest.fixture
def apply(spark):
    from tablewright import apply_steps

    def run(rows, schema, *steps, order_by=None):
        df = spark.createDataFrame(rows, schema)
        return apply_steps(df, [{"type": t, "params": p} for t, p in steps], order_by)
    return run


def values(df, name=None):
    return [r[name or df.columns[0]] for r in df.collect()]
