from pathlib import Path

import pytest

TESTDATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    if not TESTDATA.exists():
        pytest.skip("no driver tables here")
    return str(TESTDATA)
