"""HTML reports with inline drawings."""

from __future__ import annotations

import html
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.search import Found
from barloom.operators.walkforward import Outcome
from barloom.plans.backtest import Report

TITLES = {
    "en": {"performance": "Performance", "risk": "Risk", "trade": "Trades", "params": "Parameters", "equity": "Equity", "costs": "Costs", "tests": "Tests", "sensitivity": "Sensitivity", "regimes": "Regimes", "trials": "Best trials", "folds": "Folds"},
    "zh": {"performance": "绩效", "risk": "风险", "trade": "交易", "params": "参数", "equity": "权益", "costs": "成本", "tests": "检验", "sensitivity": "敏感性", "regimes": "行情", "trials": "最优试验", "folds": "分段"},
}


def _cell(value) -> str:
    return html.escape(f"{value:.6g}" if isinstance(value, float) else str(value))


def table_of(rows: list[dict]) -> str:
    if not rows:
        return "<p>-</p>"
    head = "".join(f"<th>{html.escape(str(k))}</th>" for k in rows[0])
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in r.values()) + "</tr>" for r in rows) + "</table>"


def thinned(equity: DataFrame, points: int = 500) -> list[tuple[int, float]]:
    """About `points` bars of the curve, the last of each stretch; only these come to the driver."""
    n = equity.agg(F.max("bar_idx")).first()[0]
    if n is None:
        return []
    step = max(1, (n + 1) // points)
    rows = equity.groupBy(F.floor(F.col("bar_idx") / step).alias("g")).agg(F.max_by("equity", "bar_idx").alias("equity")).orderBy("g")
    return [(r["g"] * step, r["equity"]) for r in rows.collect()]


def _line(points: list[tuple[int, float]], width: int, height: int, colour: str) -> str:
    low, high = min(y for _, y in points), max(y for _, y in points)
    last, span = points[-1][0] or 1, high - low or 1.0
    path = " ".join(f"{x / last * width:.1f},{height - (y - low) / span * height:.1f}" for x, y in points)
    return f'<svg viewBox="0 0 {width} {height}" width="{width}" height="{height}"><polyline fill="none" stroke="{colour}" stroke-width="1.5" points="{path}"/></svg>'


def drawing(points: list[tuple[int, float]], width: int = 800, height: int = 240) -> str:
    """The curve and, below it, how far it is under its highest point so far, as inline SVG."""
    if len(points) < 2:
        return "<p>-</p>"
    peaks = itertools.accumulate((y for _, y in points), max)
    depths = [(x, (y - peak) / max(peak, 1e-12)) for (x, y), peak in zip(points, peaks, strict=True)]
    return _line(points, width, height, "#1f5fa8") + f"<p>min {min(d for _, d in depths):.2%}</p>" + _line(depths, width, height // 3, "#a83232")


def heatmap(rows: list[dict], x: str, y: str, score: str, cell: int = 36) -> str:
    """Scores of two parameters as coloured cells, from low (white) to high (blue); empty ones are grey."""
    values = {(r[x], r[y]): r[score] for r in rows if r[score] is not None and r[score] == r[score]}
    across, down = (sorted({r[c] for r in rows}) for c in (x, y))
    if not values:
        return "<p>-</p>"
    low, span = min(values.values()), max(values.values()) - min(values.values()) or 1.0
    boxes = []
    for j, b in enumerate(down):
        for i, a in enumerate(across):
            value = values.get((a, b))
            shade = "#dddddd" if value is None else f"rgb({255 - int(224 * (value - low) / span)},{255 - int(160 * (value - low) / span)},255)"
            text = "" if value is None else f"{value:.3g}"
            boxes.append(f'<g><rect x="{(i + 1) * cell}" y="{(j + 1) * cell}" width="{cell}" height="{cell}" fill="{shade}"><title>{x}={a}, {y}={b}: {text}</title></rect><text x="{(i + 1.1) * cell}" y="{(j + 1.6) * cell}" font-size="9">{text}</text></g>')
    names = [f'<text x="{(i + 1.1) * cell}" y="{0.8 * cell}" font-size="10">{html.escape(str(a))}</text>' for i, a in enumerate(across)] + [f'<text x="2" y="{(j + 1.6) * cell}" font-size="10">{html.escape(str(b))}</text>' for j, b in enumerate(down)]
    width, height = (len(across) + 1) * cell, (len(down) + 1) * cell
    return f'<svg viewBox="0 0 {width} {height}" width="{width}" height="{height}">{"".join(boxes + names)}</svg>'


#: Rows of a table that a page shows; it says how many there are.
SHOWN_ROWS = 1000


def shown(frame: DataFrame) -> str:
    """The first SHOWN_ROWS rows of frame, in order of all its columns, and the number of all."""
    rows = [r.asDict() for r in frame.orderBy(*frame.columns).limit(SHOWN_ROWS).collect()]
    total = frame.count() if len(rows) == SHOWN_ROWS else len(rows)
    return table_of(rows) + (f"<p>{len(rows)} / {total}</p>" if total > len(rows) else "")


def page(title: str, sections: dict[str, str]) -> str:
    style = "body{font-family:sans-serif;margin:2em;max-width:60em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .6em;text-align:right}"
    body = "".join(f"<h2>{html.escape(name)}</h2>{content}" for name, content in sections.items())
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{body}</body></html>'


def backtest_page(report: Report, language: str = "en", costs: DataFrame | None = None, tests: DataFrame | None = None, sensitivity: DataFrame | None = None, regimes: DataFrame | None = None, sections: set[str] | None = None) -> str:
    """Parameters, measures, equity, and what else is given; `sections` picks some."""
    t, measures = TITLES[language], report.measures()
    parts = {"params": table_of([report.params]), "equity": drawing(thinned(report.equity)), **{k: table_of([measures[k]]) for k in ("performance", "risk", "trade")}}
    for name, frame in (("costs", costs), ("tests", tests), ("sensitivity", sensitivity), ("regimes", regimes)):
        if frame is not None:
            parts[name] = shown(frame)
    return page(report.strategy, {t[k]: v for k, v in parts.items() if sections is None or k in sections})


def search_page(found: Found, language: str = "en") -> str:
    """The best trials and, of a search over two numbers, a map of all."""
    rows = [{**params, found.metric: score} for params, score in found.top(20)]
    sections = {TITLES[language]["trials"]: table_of(rows)}
    axes = [k for k in (rows[0] if rows else {}) if k != found.metric and len({str(p.get(k)) for p, _ in found.trials}) > 1]
    if len(axes) == 2:
        sections[found.metric] = heatmap([{**params, found.metric: score} for params, score in found.trials], *axes, found.metric)
    return page(f"{found.method}: {found.metric}", sections)


def walk_forward_page(outcome: Outcome, language: str = "en") -> str:
    rows = [{"fold": f.fold, **{f"is_{k}": v for k, v in i.items() if k != "combo_id"}, **{f"oos_{k}": v for k, v in o.items() if k != "combo_id"}} for f, _, i, o in outcome.folds]
    return page("walk-forward", {TITLES[language]["folds"]: table_of(rows), TITLES[language]["performance"]: table_of([outcome.means()])})


def to_pdf(text: str, path: str) -> None:
    try:
        import weasyprint
    except ImportError as missing:
        raise RuntimeError("PDF output needs weasyprint") from missing
    weasyprint.HTML(string=text).write_pdf(path)
