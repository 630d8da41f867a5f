"""Evaluation reports of small summary tables, as Markdown and JSON."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame

#: Rows of a table that a report shows at most; a note says how many more there are.
MOST_ROWS = 1000
NO_FAILURES = "Every answerable question found a relevant document."


def _cell(v: object) -> str:
    return f"{v:.3f}" if isinstance(v, float) else ", ".join(map(_cell, v)) if isinstance(v, list) else "" if v is None else str(v).replace("|", "\\|")


def _rows(df: DataFrame) -> list:
    """The first MOST_ROWS rows and one that tells whether there are more."""
    return df.limit(MOST_ROWS + 1).collect()


def _table(df: DataFrame) -> list[str]:
    rows = _rows(df)
    out = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    out += ["| " + " | ".join(map(_cell, r)) + " |" for r in rows[:MOST_ROWS]]
    if len(rows) > MOST_ROWS:
        out += ["", f"The first {MOST_ROWS} rows of {df.count()}."]
    return out if rows else []


def markdown(sections: Mapping[str, DataFrame], facts: Mapping[str, object] | None = None) -> str:
    """A table for each summary that has rows; figures with three decimals. facts: lines to begin with, such as the index's size.

    A summary named Failures without rows is told as good news; other empty ones, and ones that weren't asked for, are left out.
    """
    out = ["# Evaluation"]
    if facts:
        out += ["", *(f"- {name}: **{_cell(value)}**" for name, value in facts.items())]
    for name, df in sections.items():
        rows = _table(df)
        if rows or name == "Failures":
            out += ["", f"## {name}", "", *(rows or [NO_FAILURES])]
    return "\n".join(out) + "\n"


def as_json(sections: Mapping[str, DataFrame], facts: Mapping[str, object] | None = None) -> str:
    """The same as JSON; `complete` tells whether a table's rows are all there."""
    tables = {name: _rows(df) for name, df in sections.items()}
    told = {name: [r.asDict(True) for r in rows[:MOST_ROWS]] for name, rows in tables.items()}
    return json.dumps(dict(facts or {}) | told | {"complete": {name: len(rows) <= MOST_ROWS for name, rows in tables.items()}}, indent=2)
