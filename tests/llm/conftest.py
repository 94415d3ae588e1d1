import pytest


@pytest.fixture(scope="session")
def spark(spark_session):
    return spark_session
