"""The tab-delimited data file and the summary file of a run."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Row

from readprism.functions.bases import ADAPTERS
from readprism.plans.report import Report

#: Titles of the modules, and column heads below, as readers of these files expect them.
TITLES = {
    "basic_stats": "Basic Statistics",
    "per_base_quality": "Per base sequence quality",
    "per_seq_quality": "Per sequence quality scores",
    "per_base_content": "Per base sequence content",
    "per_seq_gc": "Per sequence GC content",
    "per_base_n": "Per base N content",
    "per_seq_n": "Per sequence N content",
    "length_dist": "Sequence Length Distribution",
    "duplication_levels": "Sequence Duplication Levels",
    "overrepresented": "Overrepresented sequences",
    "adapter_content": "Adapter Content",
    "kmer_content": "Kmer Content",
}
#: (table, header, format of a row); values are formatted on the driver, where halves round to even.
_TABLES: dict[str, tuple[str, str, Callable[[Row], Iterable[str]]]] = {
    "per_base_quality": ("per_base_quality", "Base\tMean\tMedian\tLower Quartile\tUpper Quartile\t10th Percentile\t90th Percentile", lambda r: (r.base, f"{r.mean:.1f}", r.median, r.q25, r.q75, r.p10, r.p90)),
    "per_seq_quality": ("per_seq_quality", "Quality\tCount", lambda r: (r.mean_q, r.cnt)),
    "per_base_content": ("per_base_content", "Base\tG\tA\tT\tC", lambda r: (r.base, *(f"{r[x]:.1f}" for x in "gatc"))),
    "per_seq_gc": ("per_seq_gc", "GC Content\tCount", lambda r: (r.gc, r.cnt)),
    "per_base_n": ("per_base_n", "Base\tN-Count", lambda r: (r.base, f"{r.n_percent:.1f}")),
    "per_seq_n": ("per_seq_n", "N%\tCount", lambda r: (r.n_percent, r.cnt)),
    "length_dist": ("length_dist", "Length\tCount", lambda r: (r.length, r.cnt)),
    "duplication_levels": ("duplication_levels", "Duplication Level\tRelative Count", lambda r: (level_name(r.level), f"{r.relative:.2f}")),
    "overrepresented": ("overrepresented", "Sequence\tCount\tPercentage\tPossible Source", lambda r: (r.sequence, r.cnt, f"{r.percent:.2f}", r.source)),
    "kmer_content": ("kmer_content", "Sequence\tCount\tPValue\tObs/Exp Max\tMax Obs/Exp Position", lambda r: (r.kmer, r.cnt, scientific(10.0**-r.neg_log10_p), f"{r.obs_exp:.2f}", r.max_pos)),
}


def level_name(level: int) -> str:
    return "7+" if level == 7 else str(level)


def scientific(value: float) -> str:
    """Two decimals and an exponent without padding."""
    mantissa, exponent = f"{value:.2e}".split("e")
    return f"{mantissa}e{int(exponent)}"


def length_range(stats: Row) -> str:
    return str(stats.min_len) if stats.min_len == stats.max_len else f"{stats.min_len}-{stats.max_len}"


def basic_pairs(report: Report) -> list[tuple[str, str]]:
    """Measures and values of the first module."""
    stats = report.rows["basic_stats"][0]
    return [
        ("Filename", report.context.file_name), ("File type", "Conventional base calls"), ("Encoding", report.context.encoding), ("Total Sequences", str(stats.total_sequences)),
        ("Filtered Sequences", "0"), ("Sequence length", length_range(stats)), ("%GC", str(stats.gc_percent)),
    ]


def module_lines(report: Report, module: str) -> list[str]:
    """Header and rows of a module, without its frame."""
    rows, long = report.rows, report.context.mode == "long"
    if module == "basic_stats":
        return ["#Measure\tValue", *("\t".join(p) for p in basic_pairs(report))]
    if module == "length_dist" and long:
        s = rows["length_summary"][0]
        pairs = [("Min", s.min_len), ("Max", s.max_len), ("Mean", f"{s['mean']:.1f}"), ("N50", s.n50), ("N90", s.n90)]
        return ["#Metric\tValue", *(f"{k}\t{v}" for k, v in pairs), "#Length\tCount", *(f"{r.label}\t{r.cnt}" for r in rows["length_bins"])]
    if module == "adapter_content":
        table, head, name = ("adapter_any", "#Adapter", lambda r: "Any") if long else ("adapter_by_position", "#Position", lambda r: str(r.position))
        return ["\t".join([head, *ADAPTERS]), *("\t".join([name(r), *(f"{r[f'a{i}']:.1f}" for i in range(len(ADAPTERS)))]) for r in rows[table])]
    table, header, shape = _TABLES[module]
    return ["#" + header, *("\t".join(map(str, shape(r))) for r in rows[table])]


def data_text(report: Report) -> str:
    """All modules of the mode in order, each between its title with its status and an end mark."""
    out: list[str] = []
    for module in report.context.modules:
        out += [f">>{TITLES[module]}\t{report.statuses[module].lower()}", *module_lines(report, module), ">>END_MODULE"]
    return "\n".join(out) + "\n"


def summary_text(report: Report) -> str:
    """One line for each module: status, title and file name."""
    return "".join(f"{report.statuses[m]}\t{TITLES[m]}\t{report.context.file_name}\n" for m in report.context.modules)
