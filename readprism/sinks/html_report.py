"""A self-contained HTML page of a run."""

from __future__ import annotations

from datetime import UTC, datetime
from html import escape

from readprism.plans.report import Report
from readprism.sinks.figures import figure
from readprism.sinks.text_report import TITLES, module_lines

_MARK = {"PASS": "#2e7d32", "WARN": "#e69100", "FAIL": "#c62828"}
_TABLES = ("basic_stats", "overrepresented", "kmer_content")
_STYLE = "body{font-family:sans-serif;margin:0;display:flex}nav{width:260px;padding:16px;background:#f4f4f4;position:sticky;top:0;height:100vh;overflow:auto}main{padding:16px;max-width:860px}a{color:inherit}table{border-collapse:collapse;font-size:13px}td,th{border:1px solid #ccc;padding:2px 8px;text-align:left}"


def _table(lines: list[str]) -> str:
    head, *body = [line.lstrip("#").split("\t") for line in lines]
    cells = lambda tag, row: "<tr>" + "".join(f"<{tag}>{escape(c)}</{tag}>" for c in row) + "</tr>"
    return "<table>" + cells("th", head) + "".join(cells("td", r) for r in body) + "</table>"


def html_text(report: Report, *, made: datetime | None = None) -> str:
    """The page; ``made`` is the time it states (now, unless given)."""
    made = made or datetime.now(UTC)
    links, sections = [], []
    for module in report.context.modules:
        status = report.statuses[module]
        badge = f'<b style="color:{_MARK[status]}">{status}</b>'
        links.append(f'<li>{badge} <a href="#{module}">{TITLES[module]}</a></li>')
        table = _table(module_lines(report, module))
        shown = table if module in _TABLES else f"<details><summary>Table</summary>{table}</details>"
        sections.append(f'<section id="{module}"><h2>{TITLES[module]} {badge}</h2>{figure(report, module) or ""}{shown}</section>')
    name = escape(report.context.file_name)
    return (
        f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{name}: read quality</title><style>{_STYLE}</style></head><body>'
        f"<nav><h1>{escape(report.context.sample)}</h1><p>{name}<br>{made:%Y-%m-%d %H:%M:%S} UTC</p><ul>{''.join(links)}</ul></nav><main>{''.join(sections)}</main></body></html>\n"
    )
