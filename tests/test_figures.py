"""Figures against the tables they draw, and the LaTeX export."""

import stat
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import Row

from readprism.functions.bases import ADAPTERS
from readprism.plans.report import MODULES, Context, Report
from readprism.sinks import charts as C
from readprism.sinks import figures, latex

X0, X1, Y0, Y1 = C.LEFT, C.WIDTH - C.RIGHT, C.HEIGHT - C.BOTTOM, C.TOP


def report(mode="short", **over):
    positions = [Row(base=i, mean=30.0, median=m, q25=m - 3, q75=m + 3, p10=m - 6, p90=m + 6) for i, m in ((1, 35), (2, 28), (3, 24), (4, 20), (5, 12))]
    shares = {f"a{i}": float(i) for i in range(5)}
    rows = {
        "basic_stats": [Row(total_sequences=9, min_len=1, max_len=5, gc_percent=50)],
        "per_base_quality": positions,
        "per_seq_quality": [Row(mean_q=q, cnt=c) for q, c in ((10, 5), (20, 40), (38, 10))],
        "per_base_content": [Row(base=b, g=20.0 + b, a=30.0, t=25.0, c=25.0 - b) for b in range(1, 6)],
        "per_seq_gc": [Row(gc=g, cnt=g) for g in (10, 40, 50, 60, 90)],
        "per_base_n": [Row(base=b, n_percent=10.0 * b) for b in range(1, 6)],
        "per_seq_n": [Row(n_percent=n, cnt=9) for n in (0, 10, 15, 20, 60)],
        "length_dist": [Row(length=n, cnt=n) for n in range(1, 41)],
        "length_bins": [Row(bin=i, label=f"L{i}", cnt=i * i, mid=i) for i in range(8)],
        "duplication_levels": [Row(level=n, reads=n, relative=n / 28) for n in range(1, 8)],
        "adapter_by_position": [Row(position=p, **{k: v * p for k, v in shares.items()}) for p in range(1, 6)],
        "adapter_any": [Row(**shares)],
        "overrepresented": [Row(sequence=f"<A{i}>", cnt=1000 * i, percent=1.5, source="No Hit") for i in range(9, 0, -1)],
        "kmer_content": [Row(kmer="ACGTACG", cnt=1234, neg_log10_p=2.0, obs_exp=4.5, max_pos=15)],
    }
    return Report(Context("f_1.fq", "s&1", mode), rows | over, dict.fromkeys(MODULES[mode], "PASS"))


def drawn(module, mode="short", **over):
    """(rectangles, polylines as points, texts) of a module's figure."""
    root = ElementTree.fromstring(figures.figure(report(mode, **over), module))
    name = lambda e: e.tag.split("}")[1]
    rects = [{k: e.get(k) if k == "fill" else float(e.get(k)) for k in ("x", "y", "width", "height", "fill")} for e in root if name(e) == "rect"]
    lines = [[tuple(map(float, p.split(","))) for p in e.get("points").split()] for e in root if name(e) == "polyline"]
    return rects, lines, [e.text for e in root if name(e) == "text"]


def height(value, top, low=0.0):
    return (Y0 - Y1) * (value - low) / (top - low)


@pytest.mark.parametrize(("module", "mode", "values"), [
    ("per_seq_quality", "short", [5, 40, 10]), ("per_seq_gc", "short", [10, 40, 50, 60, 90]), ("length_dist", "short", list(range(1, 41))), ("per_seq_n", "long", [9] * 5),
    ("length_dist", "long", [i * i for i in range(8)]), ("duplication_levels", "short", [n / 28 for n in range(1, 8)]), ("adapter_content", "long", [0, 1, 2, 3, 4]),
])
def test_bars_are_as_high_as_their_values(module, mode, values):
    bars = [r for r in drawn(module, mode)[0] if r["fill"] == C.COLOURS[0]]
    assert len(bars) == len(values)
    slot = (X1 - X0) / len(values)
    for i, (bar, value) in enumerate(zip(bars, values)):
        assert bar["height"] == pytest.approx(height(value, max(values)), abs=0.11)
        assert bar["y"] + bar["height"] == pytest.approx(Y0, abs=0.11)
        assert bar["x"] == pytest.approx(X0 + slot * (i + 0.1), abs=0.06) and bar["width"] == pytest.approx(0.8 * slot, abs=0.06)


def test_bands_cover_their_values():
    slot = (X1 - X0) / 5
    (band,) = [r for r in drawn("per_seq_gc")[0] if r["fill"] == C.GOOD]
    assert (band["x"], band["width"], band["height"]) == (pytest.approx(X0 + slot, abs=0.1), pytest.approx(3 * slot, abs=0.1), pytest.approx(Y0 - Y1, abs=0.1))
    n_bands = {r["fill"]: r for r in drawn("per_base_n")[0]}
    top, low = 58.0, 2.0  # data from 10 to 50, a fifth of their range on both sides
    for fill, lo, hi in ((C.GOOD, low, 5), (C.FAIR, 5, 20), (C.POOR, 20, top)):
        assert n_bands[fill]["height"] == pytest.approx(height(hi - lo, top - low), abs=0.11), fill
        assert n_bands[fill]["y"] == pytest.approx(Y0 - height(hi, top, low), abs=0.11)
    widths = {r["fill"]: r["width"] for r in drawn("per_seq_n", "long")[0] if r["fill"] in (C.GOOD, C.FAIR, C.POOR)}
    assert widths[C.GOOD] == pytest.approx(2 * slot, abs=0.1)


def test_boxes_whiskers_and_medians():
    rects, lines, _ = drawn("per_base_quality")
    top, slot = 41, (X1 - X0) / 5
    bands, boxes = rects[:3], rects[3:]
    assert [(b["fill"], pytest.approx(b["height"], abs=0.11)) for b in bands] == [(C.POOR, height(20, top)), (C.FAIR, height(8, top)), (C.GOOD, height(13, top))]
    assert len({b["fill"] for b in boxes[:2]} | {boxes[4]["fill"]}) == 2 and boxes[2]["fill"] == boxes[3]["fill"] != boxes[4]["fill"]
    for i, m in enumerate((35, 28, 24, 20, 12)):
        assert boxes[i]["height"] == pytest.approx(height(6, top), abs=0.11) and boxes[i]["y"] == pytest.approx(Y0 - height(m + 3, top), abs=0.11)
        whisker, median = lines[2 * i], lines[2 * i + 1]
        centre = X0 + slot * (i + 0.5)
        assert whisker == [(pytest.approx(centre, abs=0.06), pytest.approx(Y0 - height(m + d, top), abs=0.06)) for d in (-6, 6)]
        assert [p[1] for p in median] == [pytest.approx(Y0 - height(m, top), abs=0.06)] * 2 and median[0][0] < centre < median[1][0]


def test_lines_follow_the_table():
    _, lines, texts = drawn("per_base_content")
    assert [t for t in texts if t in "GATC"] == list("GATC")
    low, top = 20.0 - 2, 30.0 + 2  # a fifth of their range, and at least 2
    assert [p[1] for p in lines[0]] == [pytest.approx(Y0 - height(20.0 + b, top, low), abs=0.06) for b in range(1, 6)]
    assert [p[0] for p in lines[0]] == [pytest.approx(X0 + (X1 - X0) * b / 4, abs=0.06) for b in range(5)]
    _, lines, texts = drawn("adapter_content")
    assert len(lines) == 5 and [t for t in texts if t in {a[:12] for a in ADAPTERS}] == [a[:12] for a in ADAPTERS]
    assert len({p[1] for p in lines[0]}) == 1 and lines[4] == sorted(lines[4], key=lambda p: (p[0], -p[1]))
    _, flat, _ = drawn("per_base_n", per_base_n=[Row(base=1, n_percent=0.0)])
    assert flat == [[(X0, Y0)]]


def test_text_panels_show_the_first_rows():
    _, _, texts = drawn("overrepresented")
    assert len(texts) == figures.SHOWN and texts[0].split() == ["9,000", "1.50", "%", "No", "Hit", "<A9>"]
    assert drawn("overrepresented", overrepresented=[])[2] == ["No overrepresented sequences"]
    assert "4.50 at 15 %" in drawn("kmer_content")[2][0] and drawn("kmer_content", kmer_content=[])[2] == ["No enriched words"]
    assert figures.figure(report(), "basic_stats") is None


@pytest.mark.parametrize(("lo", "hi", "wanted"), [(0, 40, 5), (0, 1, 5), (0.03, 0.11, 5), (-3, 7, 10), (0, 123456, 5), (5, 5, 5)])
def test_ticks_are_round_and_within(lo, hi, wanted):
    found = C.ticks(lo, hi, wanted)
    assert all(lo <= t <= hi for t in found) and 1 <= len(found) <= wanted + 1
    steps = {round(b - a, 9) for a, b in zip(found, found[1:])}
    assert len(steps) <= 1 and all(f"{s:e}"[0] in "125" for s in steps)


def test_every_module_has_a_figure_in_its_set():
    assert latex.figure_set(report(), "supplement") == list(MODULES["short"][1:]) and latex.figure_set(report("long"), "supplement") == list(MODULES["long"][1:])
    failed = report()
    failed.statuses["adapter_content"] = "WARN"
    assert latex.figure_set(report(), "summary") == latex.figure_set(failed, "summary")[:-1] and latex.figure_set(failed, "summary")[-1] == "adapter_content"


def test_export_with_and_without_a_converter(tmp_path, monkeypatch):
    monkeypatch.setenv("PATH", str(tmp_path / "none"))
    latex.export(report(), tmp_path / "svg", "summary")
    text = (tmp_path / "svg/readprism.tex").read_text()
    assert "\\usepackage{svg}" in text and "\\includesvg[width=\\linewidth]{figures/per_base_quality}" in text and "s\\&1" in text
    assert "f\\_1.fq" in (tmp_path / "svg/tables/basic_statistics.tex").read_text()
    note = (tmp_path / "svg/README.tex.md").read_text()
    assert "-shell-escape" in note and "`figures/per_seq_quality.svg`" in note
    first = (tmp_path / "svg/readprism_latex.zip").read_bytes()
    latex.export(report(), tmp_path / "svg", "summary")
    assert (tmp_path / "svg/readprism_latex.zip").read_bytes() == first

    (tmp_path / "bin").mkdir()
    program = tmp_path / "bin/rsvg-convert"
    program.write_text('#!/bin/sh\nprintf "%%PDF of $5" > "$4"\n')
    program.chmod(program.stat().st_mode | stat.S_IEXEC)
    monkeypatch.setenv("PATH", str(tmp_path / "bin"))
    latex.export(report(), tmp_path / "pdf", "supplement")
    text = (tmp_path / "pdf/readprism.tex").read_text()
    assert "\\usepackage{graphicx}" in text and "\\includegraphics" in text and "includesvg" not in text
    names = zipfile.ZipFile(tmp_path / "pdf/readprism_latex.zip").namelist()
    assert len([n for n in names if n.endswith(".pdf")]) == len([n for n in names if n.endswith(".svg")]) == 10
    assert "`pdflatex readprism.tex`" in (tmp_path / "pdf/README.tex.md").read_text()

    program.write_text("#!/bin/sh\nexit 1\n")
    latex.export(report(), tmp_path / "bad", "summary")
    assert "includesvg" in (tmp_path / "bad/readprism.tex").read_text()
