import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from seqlattice.session import session

    s = session(4, 4, spark__ui__showConsoleProgress="false", spark__driver__memory="4g", spark__sql__ansi__enabled="true")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
