import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from orefield.session import ensure_checkpoint_dir, get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", "local[4]", 4, **{"spark__driver__memory": "4g"})
    ensure_checkpoint_dir(session)
    yield session
    session.stop()
