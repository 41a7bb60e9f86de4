import os

import pytest


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_core_does_not_import_the_subpackage():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "kgloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"kgloom[.]llm|from [.]llm", p.read_text()), p
