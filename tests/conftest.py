import pytest
from hypothesis import settings

from siltstone.session import build_session


settings.register_profile("fixed", derandomize=True, deadline=None)
settings.load_profile("fixed")


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield session
    session.stop()
