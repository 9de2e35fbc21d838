import pytest
from llm_fixtures import ODD_ROWS, documents


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, ODD_ROWS)


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, [])
