import pytest

from paddock.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        8, 4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    )
    yield session
    session.stop()


@pytest.fixture
def small_chunks(spark):
    """Five range chunks, so that groups are split even in small tests."""
    spark.conf.set("paddock.rangeChunks", "5")
    yield
    spark.conf.unset("paddock.rangeChunks")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
