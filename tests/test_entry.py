import __spark_entry__ as entry


def test_registry(spark):
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and len(known) > 60
    assert entry.entry(spark).count() > 0


def test_core_does_not_need_the_optional_part():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "strandloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"strandloom\.llm|from \.+llm", path.read_text()), path
