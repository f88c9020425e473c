import pathlib
import sys
import tempfile

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cloakwork.session import local_session

    root = tempfile.mkdtemp(prefix="cloakwork-test-")
    session = local_session(8, 4, spark_sql_warehouse_dir=f"{root}/warehouse")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="cloakwork-test-")


@pytest.fixture(scope="session")
def small():
    return SMALL
