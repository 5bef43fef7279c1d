import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tallygrain.session import get_session

    return get_session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4"})
