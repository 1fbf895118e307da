import pytest

from cartlens.session import build_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions=4,
        spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=tmp_path_factory.mktemp("shared"),
        spark__sql__warehouse__dir=tmp_path_factory.mktemp("warehouse"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_warehouse(spark):
    from __spark_entry__ import warehouse

    return warehouse(spark, SMALL)
