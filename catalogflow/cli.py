"""Command line: ``python -m catalogflow.cli`` with ``list`` and ``run`` (registered queries), ``pipeline``,
``detect``, ``associate``, ``augment``, ``ready`` and ``coherence`` (the user's own files), and the parsers that
they share. What a command did is printed as one JSON object a line."""

from __future__ import annotations

import argparse
import json

from .operators.associate import GATE

#: Fixed names and defaults of the quality gate.
QC = {"erh": 5.0, "erz": 5.0, "gap": 270.0, "num": 5.0, "rms": 1.0}


def pairs(text: str, known: dict[str, float]) -> dict[str, float]:
    """``k=v,k=v`` over known names; an unknown name is an error, what is not named keeps its default."""
    out = dict(known)
    for part in filter(None, (text or "").split(",")):
        name, _, value = part.partition("=")
        if name.strip() not in known:
            raise ValueError(f"unknown name {name.strip()!r}; known: {', '.join(known)}")
        out[name.strip()] = type(known[name.strip()])(float(value))
    return out


def parse_qc(text: str) -> dict[str, float]:
    return pairs(text, QC)


def parse_gate(text: str) -> dict[str, float]:
    return pairs(text, GATE)


def parse_years(text: str) -> list[int]:
    """``2010-2012,2015`` as a sorted list without repeats."""
    out: set[int] = set()
    for part in filter(None, text.split(",")):
        a, _, b = part.partition("-")
        out |= set(range(int(a), int(b or a) + 1))
    return sorted(out)


def qc_predicate(limits: dict[str, float]) -> str:
    """Strict bounds; a null fails each."""
    return f"erh < {limits['erh']} AND erz < {limits['erz']} AND gap < {limits['gap']} AND num > {limits['num']} AND rms < {limits['rms']}"


def _parser() -> argparse.ArgumentParser:
    from .plans import queries as core
    from .plans.commands import STAGES

    parser = argparse.ArgumentParser(prog="catalogflow")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list")
    run = verbs.add_parser("run")
    run.add_argument("query", choices=sorted(core.queries()))
    run.add_argument("--data", required=True)
    run.add_argument("--out")

    def command(name: str, *wanted: str) -> argparse.ArgumentParser:
        one = verbs.add_parser(name)
        for w in wanted:
            one.add_argument(f"--{w}", required=True)
        return one

    p = command("pipeline", "years", "picks", "out", "stations")
    p.add_argument("--traces")
    p.add_argument("--stage-from", choices=STAGES, default=STAGES[0])
    p.add_argument("--through", choices=STAGES, default=STAGES[-1])
    p.add_argument("--strict", action="store_true")
    p.add_argument("--gate", default="")
    p = command("detect", "traces", "picks", "year")
    p.add_argument("--days", default="")
    p.add_argument("--min-prob", type=float, default=0.3)
    p.add_argument("--no-skip-existing", action="store_true")
    p = command("associate", "picks", "stations", "out", "year")
    p.add_argument("--gate", default="")
    p.add_argument("--pick-match-tol", type=float, default=1.5)
    p.add_argument("--overlap-s", type=int, default=150)
    p = command("augment", "picks", "out", "stations", "year")
    p.add_argument("--radius-km", type=float, default=100.0)
    p.add_argument("--tolerance-s", type=float, default=1.0)
    p.add_argument("--min-prob", type=float, default=0.3)
    p.add_argument("--tie-s", type=float, default=0.2)
    command("ready", "picks", "out", "years")
    p = command("coherence", "catalog", "picks", "stations", "years")
    p.add_argument("--inlier-min", type=float, default=0.5)
    for kind in ("scored", "clean", "audit"):
        p.add_argument(f"--out-{kind}")
    return parser


def main(arguments: list[str] | None = None) -> int:
    from .plans import commands as do
    from .plans import queries as core

    given = _parser().parse_args(arguments)
    if given.verb == "list":
        print("\n".join(sorted(core.queries())))
        return 0
    gate = parse_gate(getattr(given, "gate", ""))
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    core.prepare(spark)
    if given.verb == "run":
        frame = core.queries()[given.query](spark, given.data)
        if given.out:
            frame.write.parquet(given.out)
        else:
            frame.show(20, truncate=False)
        return 0
    if given.verb == "pipeline":
        told = do.run_years(spark, parse_years(given.years), folder=given.picks, out=given.out, stations=given.stations, traces=given.traces, stage_from=given.stage_from, through=given.through, strict=given.strict, gate=gate)
    elif given.verb == "detect":
        told = [do.detect_year(spark, given.traces, given.picks, int(given.year), days=parse_years(given.days) or None, least=given.min_prob, skip=not given.no_skip_existing)]
    elif given.verb == "associate":
        told = [do.associate_year(spark, given.picks, given.stations, given.out, int(given.year), gate=gate, overlap_s=given.overlap_s, tolerance_s=given.pick_match_tol)]
    elif given.verb == "augment":
        told = [do.augment_year(spark, given.picks, given.out, given.stations, int(given.year), radius_km=given.radius_km, tolerance_s=given.tolerance_s, least=given.min_prob, tie_s=given.tie_s)]
    elif given.verb == "ready":
        told = [do.readiness(spark, given.picks, given.out, y) for y in parse_years(given.years)]
    else:
        told = [do.coherence_files(spark, given.catalog, given.picks, given.stations, years=parse_years(given.years), inlier_min=given.inlier_min, out_scored=given.out_scored, out_clean=given.out_clean, out_audit=given.out_audit)]
    for one in told:
        print(json.dumps(one, default=str))
    return int(any("failed" in one for one in told))


if __name__ == "__main__":
    raise SystemExit(main())
