"""The chart of each module of a report."""

from __future__ import annotations

from readprism.functions.bases import ADAPTERS
from readprism.plans.report import Report
from readprism.sinks import charts as C
from readprism.sinks.text_report import level_name

SHOWN = 6


def figure(report: Report, module: str) -> str | None:
    """The module's SVG, or None if it has none."""
    rows, long = report.rows, report.context.mode == "long"
    if module == "per_base_quality":
        return C.box_plot(rows["per_base_quality"], "Position")
    if module == "per_seq_quality":
        return _histogram(rows["per_seq_quality"], "mean_q", "Mean quality")
    if module == "per_base_content":
        return C.lines({x.upper(): [(r.base, r[x]) for r in rows["per_base_content"]] for x in "gatc"}, "Position", "Percent", padding=2)
    if module == "per_seq_gc":
        return _histogram(rows["per_seq_gc"], "gc", "GC percent", ((40, 60, C.GOOD),))
    if module == "per_base_n":
        return C.lines({"N": [(r.base, r.n_percent) for r in rows["per_base_n"]]}, "Position", "N percent", None, ((0, 5, C.GOOD), (5, 20, C.FAIR), (20, 100, C.POOR)))
    if module == "per_seq_n":
        return _histogram(rows["per_seq_n"], "n_percent", "N percent", ((0, 10, C.GOOD), (10, 20, C.FAIR), (20, 100, C.POOR)))
    if module == "length_dist":
        return C.bars([r.label for r in rows["length_bins"]], [r.cnt for r in rows["length_bins"]], "Length") if long else _histogram(rows["length_dist"], "length", "Length")
    if module == "duplication_levels":
        return C.bars([level_name(r.level) for r in rows["duplication_levels"]], [r.relative for r in rows["duplication_levels"]], "Duplication level", "Share of reads")
    if module == "adapter_content":
        if long:
            return C.bars([a[:12] for a in ADAPTERS], [rows["adapter_any"][0][f"a{i}"] for i in range(5)], "Adapter", "Percent")
        return C.lines({a[:12]: [(r.position, r[f"a{i}"]) for r in rows["adapter_by_position"]] for i, a in enumerate(ADAPTERS)}, "Position", "Percent")
    if module == "overrepresented":
        return C.text_panel([f"{r.cnt:>10,}  {r.percent:6.2f} %  {r.source:8}  {r.sequence[:60]}" for r in rows["overrepresented"][:SHOWN]] or ["No overrepresented sequences"])
    if module == "kmer_content":
        return C.text_panel([f"{r.kmer}  {r.cnt:>10,}  obs/exp {r.obs_exp:7.2f} at {r.max_pos} %" for r in rows["kmer_content"][:SHOWN]] or ["No enriched words"])
    return None


def _histogram(rows, key: str, title: str, bands=()) -> str:
    """Bars by value; bands are given in values and drawn over the bars they cover."""
    values = [r[key] for r in rows]
    spans = [(sum(v < lo for v in values), sum(v <= hi for v in values), fill) for lo, hi, fill in bands]
    return C.bars([str(v) for v in values], [r.cnt for r in rows], title, "Count", spans)
