"""LaTeX export: figures as SVG and, where a converter is at hand, PDF; a table, a document that includes them, a README, and a zip of all."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable
from pathlib import Path

from readprism.plans.report import Report
from readprism.sinks.bundle import zip_bytes
from readprism.sinks.figures import figure
from readprism.sinks.text_report import TITLES, basic_pairs

_SPECIAL = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
_SUMMARY = {"short": ("per_base_quality", "per_seq_quality", "duplication_levels"), "long": ("length_dist", "per_seq_quality")}


def tex(text: str) -> str:
    """Escape text for LaTeX."""
    return "".join(_SPECIAL.get(c, c) for c in text)


def figure_set(report: Report, kind: str) -> list[str]:
    """Modules to draw: a few for ``summary`` (adapters only if they don't pass), all for ``supplement``."""
    if kind == "supplement":
        return [m for m in report.context.modules if m != "basic_stats"]
    extra = ("adapter_content",) if report.statuses["adapter_content"] != "PASS" else ()
    return [*_SUMMARY[report.context.mode], *extra]


#: Commands that make a PDF of an SVG file, by program.
CONVERTERS: dict[str, Callable[[str, str], list[str]]] = {
    "rsvg-convert": lambda svg, pdf: ["rsvg-convert", "-f", "pdf", "-o", pdf, svg],
    "inkscape": lambda svg, pdf: ["inkscape", svg, "--export-type=pdf", f"--export-filename={pdf}"],
    "cairosvg": lambda svg, pdf: ["cairosvg", svg, "-o", pdf],
}


def converter() -> str | None:
    """The first program of ``CONVERTERS`` that is installed."""
    return next((name for name in CONVERTERS if shutil.which(name)), None)


def to_pdf(svg: Path, program: str) -> bytes | None:
    """The PDF of a figure, written next to it; None if the program fails."""
    pdf = svg.with_suffix(".pdf")
    done = subprocess.run(CONVERTERS[program](str(svg), str(pdf)), capture_output=True, timeout=120, check=False)
    return pdf.read_bytes() if done.returncode == 0 and pdf.is_file() else None


def readme(report: Report, kind: str, modules: list[str], pdf: bool) -> str:
    """What the folder holds and how to compile it."""
    figures = "\n".join(f"- `figures/{m}.{'pdf' if pdf else 'svg'}`: {TITLES[m]} ({report.statuses[m]})" for m in modules)
    build = "pdflatex readprism.tex" if pdf else "pdflatex -shell-escape readprism.tex"
    note = "The figures are included as PDF; their SVG sources lie next to them." if pdf else "The figures are SVG files: the LaTeX package `svg` converts them with Inkscape as it compiles."
    return (
        f"# {report.context.sample}\n\nLaTeX export ({kind}, {report.context.mode} reads) of `{report.context.file_name}`.\n\n"
        f"- `readprism.tex`: a document with all that follows\n- `tables/basic_statistics.tex`: {TITLES['basic_stats']}\n{figures}\n\n"
        f"Compile with `{build}`. {note}\n"
    )


def export(report: Report, folder: Path, kind: str) -> None:
    """Write ``readprism.tex``, ``README.tex.md``, ``tables/``, ``figures/`` and ``readprism_latex.zip`` into ``folder``.

    If a program of ``CONVERTERS`` is installed and converts all figures, the document
    includes them as PDF, otherwise as SVG.
    """
    rows = " \\\\\n".join(f"{tex(k)} & {tex(v)}" for k, v in basic_pairs(report))
    files = {"tables/basic_statistics.tex": f"\\begin{{tabular}}{{ll}}\n{rows} \\\\\n\\end{{tabular}}\n"}
    modules = figure_set(report, kind)
    (folder / "figures").mkdir(parents=True, exist_ok=True)
    for module in modules:
        files[f"figures/{module}.svg"] = figure(report, module) or ""
        (folder / f"figures/{module}.svg").write_text(files[f"figures/{module}.svg"], encoding="utf-8")
    program = converter()
    made = {m: to_pdf(folder / f"figures/{m}.svg", program) for m in modules} if program else {}
    pdf = bool(made) and all(made.values())
    include = "includegraphics" if pdf else "includesvg"
    body = [f"\\begin{{figure}}[ht]\n\\centering\n\\{include}[width=\\linewidth]{{figures/{m}}}\n\\caption{{{tex(TITLES[m])} ({report.statuses[m]}).}}\n\\end{{figure}}" for m in modules]
    files["readprism.tex"] = (
        f"\\documentclass{{article}}\n\\usepackage{{{'graphicx' if pdf else 'svg'}}}\n\\begin{{document}}\n\\section*{{{tex(report.context.sample)}}}\n\\input{{tables/basic_statistics}}\n"
        + "\n".join(body) + "\n\\end{document}\n"
    )
    files["README.tex.md"] = readme(report, kind, modules, pdf)
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text, encoding="utf-8")
    content: dict[str, str | bytes] = dict(files)
    if pdf:
        content |= {f"figures/{m}.pdf": data for m, data in made.items() if data}
    (folder / "readprism_latex.zip").write_bytes(zip_bytes(content))
