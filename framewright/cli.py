"""Command line: score, dedupe, export, push-report (dry run only)."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from framewright import __version__
from framewright.config import CHECKS, Config
from framewright.functions.scalars import episode_spec
from framewright.plans import report as R


def _positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="framewright", description="Quality of episodic datasets")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, text):
        c = sub.add_parser(name, help=text)
        c.add_argument("source", help="folder of a dataset, anywhere Spark can read")
        c.add_argument("--episodes", help="which, as in 0-9,20")
        c.add_argument("--max-episodes", type=_positive, help="only the first so many")
        c.add_argument("--config", type=Path, help="TOML file with thresholds")
        return c

    score = command("score", "score every episode")
    for kind in ("json", "csv", "md"):
        score.add_argument(f"--{kind}", type=Path, help=f"write the report as {kind}")
    score.add_argument("--min-score", type=float, default=R.MIN_SCORE)
    score.add_argument("--disable-check", action="append", default=[], choices=CHECKS)
    score.add_argument("--decode-video", action="store_true")
    score.add_argument("--top", type=int, default=10)
    score.add_argument("--fail-under", type=float, help="exit with 1 if the mean score is lower")
    score.add_argument("--quiet", action="store_true")
    command("dedupe", "find exact and near duplicates").add_argument("--json", type=Path)
    export = command("export", "write a cleaned copy")
    keep = export.add_mutually_exclusive_group(required=True)
    keep.add_argument("--keep-from", type=Path, help="keep what this JSON report keeps")
    keep.add_argument("--min-score", type=float, help="score now, and keep what reaches this")
    export.add_argument("-o", "--output", type=Path, required=True)
    export.add_argument("--apply-trim", action="store_true")
    video = export.add_mutually_exclusive_group()
    video.add_argument("--copy-videos", action="store_true")
    video.add_argument("--symlink-videos", action="store_true")
    push = command("push-report", "prepare a summary and badge for a dataset card")
    push.add_argument("--min-score", type=float, default=R.MIN_SCORE)
    push.add_argument("--disable-check", action="append", default=[], choices=CHECKS)
    push.add_argument("--top", type=int, default=10)
    push.add_argument("--dry-run", action="store_true")
    push.add_argument("-o", "--output", type=Path)
    return p


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("framewright").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args, spark or _session())
    except (ValueError, FileNotFoundError, FileExistsError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def run(args, spark) -> int:
    from framewright.plans.score import evaluate
    from framewright.sources import episodic, video

    if args.command == "push-report" and not args.dry_run:
        raise ValueError("there is no uploader here; use --dry-run and upload the files that it writes")
    cfg = Config.load(args.config) if args.config else Config()
    ds = episodic.load(spark, args.source, episode_spec(args.episodes) if args.episodes else None, args.max_episodes)
    for w in ds.warnings:
        print(f"warning: {w}", file=sys.stderr)
    if args.command == "export" and args.keep_from:
        n = ds.frames.groupBy("episode_index").count()
        sizes = [r["count"] for r in n.collect()]
        report = R.load(args.keep_from, len(sizes), sum(sizes))
        keep = R.keep_of(report)
    else:
        # Duplicates are compared without their idle ends; no other check has a part in that.
        off = set(CHECKS) - {"idle", "duplicate"} if args.command == "dedupe" else getattr(args, "disable_check", ())
        scored = evaluate(ds, cfg, frozenset(off), video=video.check if getattr(args, "decode_video", False) else None)
        report = R.build(ds, scored, getattr(args, "min_score", R.MIN_SCORE))
        keep = R.keep_of(report)
    if args.command == "score":
        if args.json:
            R.write_json(report, args.json)
        if args.csv:
            R.write_csv(scored, args.csv)
        if args.md:
            args.md.write_text(R.markdown(report, args.top), encoding="utf-8")
        if not args.quiet:
            print(R.terminal(report, args.top))
        return int(args.fail_under is not None and report["summary"]["mean_score"] < args.fail_under)
    if args.command == "dedupe":
        groups = report["summary"]["duplicate_groups"]
        if args.json:
            args.json.write_text(json.dumps(groups, indent=2) + "\n", encoding="utf-8")
        print(R.duplicates_text(groups))
        return 0
    if args.command == "export":
        from framewright.plans.export import export

        done = export(spark, args.source, args.output, keep, R.trims_of(report) if args.apply_trim else None, args.copy_videos, args.symlink_videos)
        print(f"kept {len(done.kept)} episodes ({done.frames} frames), dropped {len(done.dropped)}, trimmed {done.trimmed_frames} frames: {done.out}")
        for w in done.warnings:
            print(f"warning: {w}", file=sys.stderr)
        return 0
    text = R.badge(report["summary"]["mean_score"]) + "\n\n" + R.markdown(report, args.top)
    if args.output:
        args.output.mkdir(parents=True, exist_ok=True)
        (args.output / "quality.md").write_text(text, encoding="utf-8")
        R.write_json(report, args.output / "quality.json")
    print(text)
    return 0
