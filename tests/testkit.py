"""Helpers shared by the test files (not in conftest.py: a second conftest module would hide this one)."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def rows(df, *cols):
    """Rows as plain tuples, sorted."""
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())
