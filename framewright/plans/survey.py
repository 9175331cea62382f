"""Scores a list of datasets; one that fails becomes a row that says so."""

from __future__ import annotations

from framewright.plans import report as R
from framewright.plans.score import evaluate


def survey(spark, sources, load, most: int | None = 200) -> list[dict]:
    """A row for each source; load(spark, source, max_episodes=most) gives its dataset."""
    rows = []
    for source in sources:
        try:
            ds = load(spark, source, max_episodes=most)
            r = R.build(ds, evaluate(ds))
            rows.append({"source": source, "episodes": r["dataset"]["episodes"], "frames": r["dataset"]["frames"], **{k: r["summary"][k] for k in ("mean_score", "median_score", "trimmable_idle_s")}, "duplicates": len(r["summary"]["duplicate_groups"]), "flags": r["summary"]["flags_by_check"], "error": None})
        except Exception as e:  # noqa: BLE001 - the next source is still worth scoring
            rows.append({"source": source, "error": f"{type(e).__name__}: {e}".splitlines()[0]})
    return rows


def table(rows: list[dict]) -> str:
    out = ["| dataset | episodes | frames | mean | median | trimmable idle | duplicate groups | flags |", "|---|---|---|---|---|---|---|---|"]
    for r in rows:
        if r["error"]:
            out.append(f"| {R.escape(r['source'])} | error: {R.escape(r['error'])} | | | | | | |")
        else:
            flags = ", ".join(f"{c} x{n}" for c, n in r["flags"].items()) or "none"
            out.append(f"| {R.escape(r['source'])} | {r['episodes']} | {r['frames']} | {r['mean_score']:.1f} | {r['median_score']:.1f} | {r['trimmable_idle_s']:.1f} s | {r['duplicates']} | {flags} |")
    return "\n".join(out) + "\n"
