import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from siteloom.operators.parse import parse_pages  # noqa: E402
from siteloom.session import build_session, keep  # noqa: E402

PAGE = "page_id long, url string, html string"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(*pages):
        rows = [(i, *p) if isinstance(p, tuple) else (i, f"https://h.com/{i}", p) for i, p in enumerate(pages)]
        return keep(parse_pages(spark.createDataFrame(rows, PAGE)))

    return make
