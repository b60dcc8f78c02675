import pytest

from tessera.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, driver_memory="4g")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    return session


@pytest.fixture()
def make(spark):
    """Rows to a DataFrame."""

    def of(rows, schema):
        return spark.createDataFrame(rows, schema)

    return of
