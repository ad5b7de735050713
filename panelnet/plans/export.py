"""Sinks: Parquet by rule and k, CSV, Markdown reports, a self-contained HTML page."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 100_000
MARK = "/*DATA*/null"
PAGE = """<!doctype html><html lang="en"><meta charset="utf-8"><title>Types</title><body><h1 id="t"></h1><pre id="d"></pre>
<script>const data = /*DATA*/null; t.textContent = data.title; d.textContent = JSON.stringify(data.types, null, 1)</script></body></html>
"""


def write_edges(edges: DataFrame, path: str) -> None:
    """One table for all rules and numbers of neighbours, in folders by both."""
    edges.write.mode("overwrite").partitionBy("rule", "k").parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def small(df: DataFrame) -> list:
    """The rows of a report table; one of more than MOST_ROWS rows is no report and fails."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows do not belong in a report")
    return rows


def export_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """A small table as one CSV file on the driver, with a byte order mark for spreadsheets."""
    import csv

    rows = small(df)
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as file:
        out = csv.writer(file)
        out.writerow(df.columns)
        out.writerows([["" if x is None else x for x in r] for r in rows])


def markdown(df: DataFrame, digits: int = 3) -> str:
    """A small table in Markdown, numbers rounded."""
    show = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(show(x).replace("|", "\\|") for x in r) + " |" for r in small(df)]
    return "\n".join(lines)


def report(title: str, sections: list[tuple[str, DataFrame | str]]) -> str:
    parts = [f"# {title}"]
    for name, body in sections:
        parts += [f"## {name}", body if isinstance(body, str) else markdown(body)]
    return "\n\n".join(parts) + "\n"


def html(document: DataFrame, template: str = PAGE) -> str:
    """The template with its mark replaced by the JSON of the one-row, one-column document."""
    text = document.select(F.col(document.columns[0])).first()[0]
    json.loads(text)
    if MARK not in template:
        raise ValueError(f"the template lacks {MARK}")
    return template.replace(MARK, text.replace("</", "<\\/"))
