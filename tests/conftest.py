from __future__ import annotations

import sys
from contextlib import contextmanager
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lakeward.cases.support import namespace as new_namespace  # noqa: E402
from lakeward.operators.maintenance import drop_namespace  # noqa: E402
from lakeward.plans.fixtures import Tables  # noqa: E402
from lakeward.session import local_session, release  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="6g", app="lakeward-tests")
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    return Tables(spark, SMALL)


@pytest.fixture(scope="session")
def built(spark):
    """Registered queries as frames on the smallest scale, each built once."""
    import __spark_entry__ as entry

    runs, frames = entry.queries(), {}

    def build(name):
        if name not in frames:
            frames[name] = runs[name](spark, SMALL)
        return frames[name]

    return build


@pytest.fixture(scope="session")
def plan_of(built):
    return lambda name: built(name)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def namespace(spark):
    name = new_namespace(spark)
    yield name
    drop_namespace(spark, name)


@contextmanager
def settings(spark, **values):
    """Set SQL settings (dots as double underscores) for a block."""
    names = {key.replace("__", "."): value for key, value in values.items()}
    before = {key: spark.conf.get(key, None) for key in names}
    try:
        for key, value in names.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@pytest.fixture
def many_ranges(spark):
    """Keep small shuffles in several partitions, as large ones would be."""
    with settings(
        spark,
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__shuffle__partitions="5",
    ):
        yield


def rows(df, *columns):
    """Rows of a frame as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
