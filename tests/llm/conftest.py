import pytest


@pytest.fixture(scope="session")
def llm(spark):
    from strandgraph.llm.common import prepare

    return prepare(spark)
