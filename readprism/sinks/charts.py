"""Small SVG charts as strings."""

from __future__ import annotations

import math
from collections.abc import Sequence
from html import escape

WIDTH, HEIGHT = 800, 260
LEFT, RIGHT, TOP, BOTTOM = 50, 20, 12, 34
COLOURS = ("#1f77b4", "#d62728", "#2ca02c", "#9467bd", "#ff7f0e")
GOOD, FAIR, POOR = "#dff0d8", "#fcf3d7", "#f7dcdc"


def ticks(lo: float, hi: float, wanted: int = 5) -> list[float]:
    """Round numbers that cover [lo, hi]: steps of 1, 2 or 5 times a power of ten."""
    if hi <= lo:
        return [lo]
    raw = (hi - lo) / wanted
    power = 10 ** math.floor(math.log10(raw))
    step = next(m * power for m in (1, 2, 5, 10) if m * power >= raw)
    first = math.ceil(lo / step)
    return [round(k * step, 10) for k in range(first, math.floor(hi / step) + 1)]


class Chart:
    """A plot area with scales; shapes are added in drawing order."""

    def __init__(self, x: tuple[float, float], y: tuple[float, float], x_title: str, y_title: str):
        self.x, self.y = x, (y[0], y[1] if y[1] > y[0] else y[0] + 1)
        self.parts: list[str] = []
        self.titles = (x_title, y_title)

    def px(self, v: float) -> float:
        lo, hi = self.x
        return LEFT + (WIDTH - LEFT - RIGHT) * (v - lo) / ((hi - lo) or 1)

    def py(self, v: float) -> float:
        lo, hi = self.y
        return HEIGHT - BOTTOM - (HEIGHT - TOP - BOTTOM) * (v - lo) / (hi - lo)

    def rect(self, x0: float, y0: float, x1: float, y1: float, fill: str, stroke: str = "none") -> None:
        a, b, c, d = self.px(x0), self.py(max(y0, y1)), self.px(x1), self.py(min(y0, y1))
        self.parts.append(f'<rect x="{a:.1f}" y="{b:.1f}" width="{max(c - a, 0.5):.1f}" height="{max(d - b, 0):.1f}" fill="{fill}" stroke="{stroke}"/>')

    def line(self, points: Sequence[tuple[float, float]], colour: str) -> None:
        path = " ".join(f"{self.px(a):.1f},{self.py(b):.1f}" for a, b in points)
        self.parts.append(f'<polyline points="{path}" fill="none" stroke="{colour}" stroke-width="1.5"/>')

    def band(self, y0: float, y1: float, fill: str) -> None:
        self.rect(self.x[0], max(y0, self.y[0]), self.x[1], min(y1, self.y[1]), fill)

    def legend(self, names: Sequence[str]) -> None:
        for i, name in enumerate(names):
            self.parts.append(f'<text x="{WIDTH - RIGHT - 4}" y="{TOP + 14 + 14 * i}" text-anchor="end" fill="{COLOURS[i % 5]}">{escape(name)}</text>')

    def svg(self, labels: Sequence[tuple[float, str]] | None = None) -> str:
        axes = [f'<path d="M{LEFT} {TOP}V{HEIGHT - BOTTOM}H{WIDTH - RIGHT}" fill="none" stroke="#444"/>']
        for v in ticks(*self.y):
            axes.append(f'<text x="{LEFT - 5}" y="{self.py(v) + 4:.1f}" text-anchor="end">{v:g}</text>')
        for v, name in labels if labels is not None else [(v, f"{v:g}") for v in ticks(*self.x, 10)]:
            axes.append(f'<text x="{self.px(v):.1f}" y="{HEIGHT - BOTTOM + 14}" text-anchor="middle">{escape(name)}</text>')
        axes.append(f'<text x="{(LEFT + WIDTH - RIGHT) / 2}" y="{HEIGHT - 4}" text-anchor="middle">{escape(self.titles[0])}</text>')
        axes.append(f'<text x="12" y="{HEIGHT / 2}" transform="rotate(-90 12 {HEIGHT / 2})" text-anchor="middle">{escape(self.titles[1])}</text>')
        return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" font-family="sans-serif" font-size="11">' + "".join(self.parts + axes) + "</svg>"


def box_plot(rows: Sequence, x_title: str) -> str:
    """Quality by position: quartile boxes, 10-90 whiskers and medians over three bands."""
    top = max([40, *(r.p90 for r in rows)])
    c = Chart((0.5, len(rows) + 0.5), (0, top), x_title, "Quality")
    for lo, hi, fill in ((0, 20, POOR), (20, 28, FAIR), (28, top, GOOD)):
        c.band(lo, hi, fill)
    for r in rows:
        c.line([(r.base, r.p10), (r.base, r.p90)], "#555")
        colour = "#4c9a4c" if r.median >= 28 else "#d9a520" if r.median >= 20 else "#c0392b"
        c.rect(r.base - 0.35, r.q25, r.base + 0.35, r.q75, colour, "#555")
        c.line([(r.base - 0.35, r.median), (r.base + 0.35, r.median)], "#000")
    return c.svg()


def bars(names: Sequence[str], values: Sequence[float], x_title: str, y_title: str = "Count", bands: Sequence[tuple[float, float, str]] = ()) -> str:
    """One bar for each value, in order; ``bands`` shade x ranges in units of bars."""
    c = Chart((0, max(len(values), 1)), (0, max([1, *values]) if y_title == "Count" else max([0.01, *values])), x_title, y_title)
    for lo, hi, fill in bands:
        c.rect(max(lo, 0), c.y[0], min(hi, c.x[1]), c.y[1], fill)
    for i, v in enumerate(values):
        c.rect(i + 0.1, 0, i + 0.9, v, COLOURS[0])
    step = max(1, len(names) // 16)
    return c.svg([(i + 0.5, n) for i, n in enumerate(names) if i % step == 0])


def lines(series: dict[str, Sequence[tuple[float, float]]], x_title: str, y_title: str, y: tuple[float, float] | None = None, bands: Sequence[tuple[float, float, str]] = (), padding: float = 1) -> str:
    """Lines over a common x axis; without ``y`` the range is the data's with a fifth of it, and at least ``padding``, on both sides, within 0 to 100."""
    points = [p for s in series.values() for p in s]
    if y is None:
        lo, hi = min([p[1] for p in points], default=0), max([p[1] for p in points], default=1)
        pad = max((hi - lo) / 5, padding)
        y = (max(0, lo - pad), min(100, hi + pad))
    c = Chart((min([p[0] for p in points], default=0), max([p[0] for p in points], default=1)), y, x_title, y_title)
    for lo, hi, fill in bands:
        if lo < c.y[1]:
            c.band(lo, hi, fill)
    for i, s in enumerate(series.values()):
        c.line(s, COLOURS[i % 5])
    c.legend(list(series))
    return c.svg()


def text_panel(rows: Sequence[str]) -> str:
    """A few lines of text as a figure."""
    body = "".join(f'<text x="12" y="{24 + 18 * i}">{escape(r)}</text>' for i, r in enumerate(rows))
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" font-family="monospace" font-size="12">{body}</svg>'
