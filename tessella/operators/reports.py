"""Report texts from small result tables (576 rows at most), formatted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame


def latex_escape(text: str) -> str:
    return "".join("\\textbackslash{}" if c == "\\" else "\\" + c if c in "&%$#_{}" else c for c in text)


def humanize(n: float) -> str:
    """1234567 as 1.2M."""
    for size, unit in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")):
        if abs(n) >= size:
            return f"{n / size:.1f}{unit}"
    return f"{n:.0f}"


def format_value(value: object) -> str:
    if value is None:
        return "--"
    return f"{value:.4f}" if isinstance(value, float) else f"{value:,}" if isinstance(value, int) and not isinstance(value, bool) else str(value)


def latex_table(frame: DataFrame, columns: list[str], caption: str = "") -> str:
    rows = [" & ".join(latex_escape(format_value(r[c])) for c in columns) + " \\\\" for r in frame.select(*columns).collect()]
    head = " & ".join(latex_escape(c) for c in columns) + " \\\\"
    lines = ["\\begin{table}", f"\\caption{{{latex_escape(caption)}}}", f"\\begin{{tabular}}{{{'l' * len(columns)}}}", "\\toprule", head, "\\midrule", *rows, "\\bottomrule", "\\end{tabular}", "\\end{table}"]
    return "\n".join(lines)


def markdown_table(frame: DataFrame, columns: list[str]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(format_value(r[c]) for c in columns) + " |" for r in frame.select(*columns).collect())])


def summary(concentration: dict, over: list[str], under: list[str]) -> str:
    return "\n".join([f"- bins: {concentration['total_bins']}, empty: {concentration['empty_bins']}", f"- Gini of tokens: {concentration['gini_token']:.4f}", f"- most over-represented: {', '.join(over)}", f"- most under-represented: {', '.join(under)}"])


def ticks(lowest: float, highest: float, log: bool = False) -> list[float]:
    """Axis ticks: five even steps, or 1-2-5 decades."""
    if not log:
        return [lowest + (highest - lowest) * k / 4 for k in range(5)]
    out, decade = [], 1.0
    while decade <= max(highest, 1):
        out += [decade * m for m in (1, 2, 5) if max(lowest, 1) <= decade * m <= highest]
        decade *= 10
    return out
