import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from foliant.session import build_session, ship

    s = build_session("local[4]", "tests", 4, **{"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
