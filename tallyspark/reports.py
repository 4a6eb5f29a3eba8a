"""Ready reports over an attribution log: its main figures, a check of them against pandas, and a page with one query."""

from __future__ import annotations

import html
from typing import Any

from pyspark.sql import functions as F

from .plans.query import Table
from .plans.result import Result

DAY_S = 86_400


def figures(table: Table, top: int = 5) -> dict[str, Any]:
    """Impressions, clicks, conversions, their rates, spend, cost of a click, the campaigns whose clicks cost most, and
    the days that the log covers. Totals come from one pass."""
    click, conversion = F.col("click") == 1, F.col("conversion") == 1
    totals = table.df.agg(
        F.count(F.lit(1)).alias("impressions"),
        F.count_if(click).alias("clicks"),
        F.count_if(conversion).alias("conversions"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("spend"),
        F.coalesce(F.avg(F.when(click, F.col("cost"))), F.lit(0.0)).alias("cost_per_click"),
    ).head()
    out = totals.asDict()
    shown = max(out["impressions"], 1)
    out["ctr"], out["cvr"] = out["clicks"] / shown, out["conversions"] / shown
    best = table.filter(click=1).group_by("campaign").sum("cost").top(top)
    out["top"] = list(zip(best.keys, best.values.tolist(), best.counts.tolist(), strict=True))
    out["days"] = len(table.group_by("timestamp", DAY_S).count().keys)
    return out


def shown(f: dict[str, Any]) -> str:
    lines = [
        f"impressions {f['impressions']}",
        f"clicks {f['clicks']} (CTR {100 * f['ctr']:.3f} %)",
        f"conversions {f['conversions']} (CVR {100 * f['cvr']:.3f} %)",
        f"spend {f['spend']:.2f}, a click {f['cost_per_click']:.5f}",
        f"days {f['days']}",
        *(f"  {name}: {value:.2f} for {count} clicks" for name, value, count in f["top"]),
    ]
    return "\n".join(lines) + "\n"


def differences(path: str, f: dict[str, Any]) -> list[str]:
    """What pandas finds otherwise in the same tab-separated file, which must fit in memory."""
    import pandas as pd

    log = pd.read_csv(path, sep="\t")
    found = {"impressions": len(log), "clicks": int((log.click == 1).sum()), "conversions": int((log.conversion == 1).sum()), "spend": float(log.cost.sum())}
    return [f"{name}: {f[name]}, pandas has {value}" for name, value in found.items() if abs(f[name] - value) > 1e-6 * max(1.0, abs(value))]


def page(result: Result, most: int = 15) -> str:
    """One grouped result as a page: its figures, bars of the largest groups, and their table."""
    best = result.top(most)
    rows = list(zip(best.keys, best.counts.tolist(), best.values.tolist(), strict=True))
    largest = max((abs(v) for _, _, v in rows), default=0.0) or 1.0
    bars = "".join(
        f'<g transform="translate(0,{24 * i})"><text x="190" y="16" text-anchor="end">{html.escape(key)}</text>'
        f'<rect x="200" y="3" width="{420 * abs(value) / largest:.1f}" height="18"/><text x="{206 + 420 * abs(value) / largest:.1f}" y="16">{value:.6g}</text></g>'
        for i, (key, _, value) in enumerate(rows)
    )
    cells = "".join(f"<tr><td>{html.escape(key)}</td><td>{count}</td><td>{value:.6g}</td></tr>" for key, count, value in rows)
    title = html.escape(f"{result.value_name} by {result.group_col}")
    head = f"{result.rows_scanned} rows, {best.seconds:.3f} s"
    style = "body{font:14px sans-serif}text{font-size:12px}rect{fill:#4878a8}td{padding:0 1em 0 0}"
    return (
        f"<!doctype html><meta charset=utf-8><title>{title}</title><style>{style}</style><h1>{title}</h1><p>{head}</p>"
        f'<svg width="760" height="{24 * len(rows) + 8}">{bars}</svg><table><tr><th>{html.escape(result.group_col)}<th>count<th>{html.escape(result.value_name)}</tr>{cells}</table>'
    )
