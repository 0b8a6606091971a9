import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from millwright.functions.session import importable, session

    home = tmp_path_factory.mktemp("spark")
    found = session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__warehouse__dir=str(home / "warehouse"), spark__checkpoint__dir=str(home / "checkpoints")
    )
    found.sparkContext.setLogLevel("ERROR")
    return importable(found)
