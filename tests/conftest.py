import pytest

from meridex.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", **{"spark.driver.memory": "3g", "spark.sql.shuffle.partitions": "4"})
