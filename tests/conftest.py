from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from marketloom.session import session

    made = session(
        "local[4]",
        shuffle_partitions=4,
        spark__ui__enabled="false",
        spark__driver__memory="3g",
        spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}",
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
