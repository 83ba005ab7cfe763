import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from seqloom.session import build_session, default_shared_folder

    session = build_session("tests", cores=8, memory="8g", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    default_shared_folder(session)
    yield session
    session.stop()
