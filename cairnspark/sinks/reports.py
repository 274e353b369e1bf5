"""Analyses as JSON, Markdown, plain text and a self-contained HTML page. Each takes the rows of a ranked result that
the caller has cut to what one page shows, and counts that Spark has aggregated."""

from __future__ import annotations

import html
import json
from typing import Any

from cairnspark.functions.text import percent, plural, short_path, truncate

LEVELS = ["HIGH", "MEDIUM", "LOW"]
FOCUS = 5
#: Diagnostics that a report shows, and hotspots of a page.
DIAGNOSTICS, TOP = 10, 10
HINTS = {"HIGH": "check the callers", "MEDIUM": "check the public surface", "LOW": "a look is enough"}

#: Stands, unseen, in a comment that we wrote.
MARK = "<!-- cairnspark impact -->"

Rows = list[dict[str, Any]]


def as_json(rows: Rows, summary: dict) -> str:
    return json.dumps({"summary": summary, "affected": rows}, indent=2, default=str)


def diagnostics(issues: Rows) -> list[str]:
    """The first issues, and how many more there are."""
    out = ["; ".join(f"{k}: {v}" for k, v in x.items()) for x in issues[:DIAGNOSTICS]]
    return out + ([f"and {len(issues) - DIAGNOSTICS} more"] if len(issues) > DIAGNOSTICS else [])


def text(rows: Rows, summary: dict, issues: Rows = ()) -> str:
    """Grouped by risk, best score first; then diagnostics."""
    out = [", ".join(f"{k}: {v}" for k, v in summary.items())]
    for level in LEVELS:
        group = sorted((r for r in rows if r["risk"] == level), key=lambda r: (-r["score"], -r["callers"], r["name"]))
        if group:
            out.append(f"\n{level} ({len(group)})")
            out += [f"  {r['name']:<32} score {r['score']:>4}  callers {r['callers']:>4}  depth {r['depth']}  {r['confidence']}" for r in group]
    if not rows:
        out.append("nothing else is affected")
    if issues:
        out += ["\nDiagnostics", *("  " + x for x in diagnostics(issues))]
    return "\n".join(out) + "\n"


def _cell(x: Any) -> str:
    return str(x).replace("|", "\\|").replace("\n", " ")


def _table(head: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(map(_cell, r)) + " |" for r in rows), ""]


def markdown(rows: Rows, summary: dict, reviewers: Rows = (), total: int | None = None, issues: Rows = ()) -> str:
    """Counts, the first rows to look at, one table a risk, reviewers, diagnostics."""
    out = ["## Change impact", "", *_table(["what", "count"], [[k, v] for k, v in summary.items()])]
    if rows:
        out += ["### Look here first", "", *(f"{i}. `{_cell(r['name'])}`: score {r['score']}, {HINTS[r['risk']]}" for i, r in enumerate(rows[:FOCUS], 1)), ""]
    for level in LEVELS:
        group = [[r["name"], r["score"], r["callers"], r["depth"], r["confidence"]] for r in rows if r["risk"] == level]
        if group:
            out += [f"### {level}", "", *_table(["function", "score", "callers", "depth", "confidence"], group)]
    if total is not None and total > len(rows):
        out += [f"{len(rows)} of {total} functions are shown.", ""]
    if issues:
        out += ["### Diagnostics", "", *(f"- {_cell(x)}" for x in diagnostics(issues)), ""]
    if reviewers:
        out += ["### Reviewers", "", *_table(["owner", "files"], [[r["owner"], r["files"]] for r in reviewers])]
    return "\n".join(out)


def _html_table(rows: Rows) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in (rows[0] if rows else {}))
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def page(rows: Rows, summary: dict, title: str = "Change impact", hot: Rows = ()) -> str:
    """One HTML file: what is affected and the first TOP hotspots; the data sits in it as JSON in which no tag can end the script."""
    data = json.dumps({"summary": summary, "affected": rows, "hotspots": list(hot)}, default=str).replace("</", "<\\/")
    most = f"<h2>Most called</h2>{_html_table(list(hot)[:TOP])}" if hot else ""
    return f'<!DOCTYPE html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{_html_table(rows)}{most}<script type="application/json" id="data">{data}</script>\n'


def hotspots(rows: Rows, base: str = "", total: int = 0) -> str:
    """A numbered table."""
    if not rows:
        return "no hotspots\n"
    out = [f"{'#':>4} {'function':<30} {'file':<40} {'in':>6} {'out':>6} {'coupling':>8}  risk"]
    for i, r in enumerate(rows, 1):
        at = truncate(f"{short_path(r['file_path'], base)}:{r['start_line']}", 40)
        out.append(f"{i:>4} {truncate(r['name'], 30):<30} {at:<40} {r['inbound']:>6} {r['outbound']:>6} {r['coupling']:>8}  {r['risk']}{' [exported]' if r.get('is_export') else ''}")
    if total > len(rows):
        out.append(f"{len(rows)} of {plural(total, 'function')} with calls")
    return "\n".join(out) + "\n"


def path(found: dict) -> str:
    """A chain of calls, a step a line."""
    if not found["found"]:
        return found["message"] + "\n"
    steps = [("" if not i else "  " * i + "-> ") + x["name"] for i, x in enumerate(found["steps"])]
    return "\n".join([*steps, plural(len(steps) - 1, "call")]) + "\n"


def candidates(message: str, rows: Rows) -> str:
    return "\n".join([message, *(f"  {r['package']}.{r['name']}  {r['file_path']}" for r in rows)]) + "\n"


def counts(of: dict[str, int]) -> str:
    return "".join(f"{k:<24} {n:>10}\n" for k, n in sorted(of.items()))


def statuses(rows: Rows) -> str:
    return "".join(f"{r['name']:<32} {r['state']:<16} {r['output'] or r['reason']}\n" for r in rows)


def resolution(stats: dict[str, int]) -> str:
    """How references resolved, by kind, with the share of exact ones."""
    out = []
    for kind in ("call", "inheritance"):
        n = {k.split("_", 1)[1]: v for k, v in stats.items() if k.startswith(kind + "_")}
        out.append(f"{kind:<12} " + "  ".join(f"{k} {v}" for k, v in n.items()) + f"  ({percent(n.get('exact', 0), sum(n.values())):.1f} % exact)")
    return "\n".join(out) + "\n"


def comparison(of: dict[str, dict], examples: dict[str, list[str]]) -> str:
    out = [f"{kind}s: base {c['base']}, candidate {c['candidate']}, shared {c['shared']} ({percent(c['shared'], c['base']):.1f} %), missing {c['missing']}, extra {c['extra']}" for kind, c in sorted(of.items(), reverse=True)]
    for what, sigs in examples.items():
        if sigs:
            out += [f"{what}:", *("  " + x for x in sigs)]
    return "\n".join(out) + "\n"


def evaluation(of: dict[str, int], rankers: Rows) -> str:
    """Counts and a line for each ranker."""
    out = [f"{plural(of['n'], 'commit')}: {of['positives']} risky ({of['reverted']} reverted, {of['hot_fixed']} fixed soon after)"]
    names = [k for k in rankers[0] if k != "ranker"] if rankers else []
    out.append(f"{'ranker':<10}" + "".join(f"{n:>10}" for n in names))
    out += [f"{r['ranker']:<10}" + "".join(f"{r[n]:>10.3f}" for n in names) for r in rankers]
    return "\n".join(out) + "\n"


def comment(body: str, existing: Rows) -> tuple[str, Any]:
    """What to post on a change whose comments (id, body) are given, and the id of the comment that it replaces: ours,
    so that there is one; None for a new one."""
    return f"{MARK}\n{body}", next((c["id"] for c in existing if MARK in (c.get("body") or "")), None)
