"""Writing a run's files: text, summary, page, and a reproducible zip of the three."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Mapping
from datetime import datetime
from pathlib import Path

from readprism.plans.report import Report
from readprism.sinks.html_report import html_text
from readprism.sinks.text_report import data_text, summary_text

_EPOCH = (1980, 1, 1, 0, 0, 0)


def zip_bytes(files: Mapping[str, str | bytes]) -> bytes:
    """A deflated zip with fixed times, so that equal content gives equal bytes."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, _EPOCH), text.encode() if isinstance(text, str) else text, zipfile.ZIP_DEFLATED)
    return buffer.getvalue()


def write_report(report: Report, out: Path, *, zipped: bool = True, made: datetime | None = None) -> Path:
    """Write ``<out>/<sample>_fastqc/`` and, if asked, ``<sample>_fastqc.zip`` next to it; returns the folder."""
    name = f"{report.context.sample}_fastqc"
    folder = out / name
    folder.mkdir(parents=True, exist_ok=True)
    files = {"fastqc_data.txt": data_text(report), "summary.txt": summary_text(report), "fastqc_report.html": html_text(report, made=made)}
    for file, text in files.items():
        (folder / file).write_text(text, encoding="utf-8")
    if zipped:
        part = out / f".{name}.zip.tmp"
        part.write_bytes(zip_bytes({f"{name}/{f}": t for f, t in files.items()}))
        os.replace(part, out / f"{name}.zip")
    return folder
