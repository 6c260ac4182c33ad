"""The driver contract."""

import __spark_entry__ as contract
from siltstone import catalogue


def test_entry(spark):
    assert contract.entry(spark).count() == 4


def test_every_sql_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(catalogue.QUERIES) <= set(contract.queries())


def test_no_library_module_needs_the_optional_part():
    import pathlib

    root = pathlib.Path(catalogue.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text()
