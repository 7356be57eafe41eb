import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tabsieve.session import ensure_checkpoint_dir, local_session

    s = local_session("tests", memory="8g")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()
