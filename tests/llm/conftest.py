import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def awkward(spark):
    from cases import clashing, documents

    return clashing(documents(spark))


@pytest.fixture(scope="session")
def nothing(spark):
    from cases import clashing, documents

    return clashing(documents(spark, []))
