"""How rows of two engines are compared."""

from __future__ import annotations

import pandas as pd


def plain(value):
    """A value that can be compared and sorted whichever engine it came from."""
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return ""
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() else f"{value:.6g}"
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist"):
        return str([plain(v) for v in value])
    return str(value)


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    """Rows in order, columns by name."""
    return sorted(tuple(plain(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))
