"""Writers. Tables for people (Markdown, LaTeX, fixed width) take reports of a few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def nest_models(evaluated: DataFrame, key: list[str], model: str = "model", value: str = "evaluation") -> DataFrame:
    """One row per key with a map from model to its evaluation struct."""
    return evaluated.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(model, value))).alias("models"))


def _rows(df: DataFrame, most: int) -> list:
    """All rows of a report; more than ``most`` are an error, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table for people takes at most {most} rows; write a file instead, or raise the bound")
    return rows


def plain(value) -> str:
    return "-" if value is None else f"{value:.4g}" if isinstance(value, float) else str(value)


def places(n: int, missing: str = "--"):
    """A format with ``n`` decimal places; null and NaN are ``missing``."""
    return lambda v: missing if v is None or v != v else f"{v:.{n}f}"


def percent(n: int = 1, missing: str = "--", sign: str = "%"):
    """A format of shares as percentages; null and NaN (nothing to divide by) are ``missing``."""
    return lambda v: missing if v is None or v != v else f"{100 * v:.{n}f}{sign}"


def _cells(rows: list, formats: dict | None = None) -> list[list[str]]:
    return [[(formats or {}).get(name, plain)(r[name]) for name in r.__fields__] for r in rows]


def markdown(df: DataFrame, align: dict[str, str] | None = None, most: int = 1000, formats: dict | None = None) -> str:
    """Markdown table of a report; ``align`` has l, r or c by column, ``formats`` a
    function from values to text."""
    marks = {"l": ":--", "r": "--:", "c": ":-:"}
    head = "| " + " | ".join(df.columns) + " |"
    rule = "| " + " | ".join(marks[(align or {}).get(c, "l")] for c in df.columns) + " |"
    return "\n".join([head, rule, *("| " + " | ".join(c.replace("|", "\\|") for c in row) + " |" for row in _cells(_rows(df, most), formats))])


def fixed_width(df: DataFrame, most: int = 1000, formats: dict | None = None) -> str:
    rows = [df.columns, *_cells(_rows(df, most), formats)]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in rows)


def latex(df: DataFrame, best: dict[str, set] | None = None, label: str = "model", most: int = 1000, formats: dict | None = None) -> str:
    """Rows of a LaTeX table; cells of ``best[column]`` (labels) are bold."""
    rows, out = _rows(df, most), []
    for row, cells in zip(rows, _cells(rows, formats), strict=True):
        shown = [f"\\textbf{{{c}}}" if row[label] in (best or {}).get(name, ()) else c.replace("_", "\\_") for name, c in zip(df.columns, cells, strict=True)]
        out.append(" & ".join(shown) + r" \\")
    return "\n".join(out)
