"""Command line: list the components, run a deployment on a scenario."""

from __future__ import annotations

import argparse

from ..sources.synthetic import build_scenario
from .config import ComponentSpec, DeploymentConfig
from .deployment import build, render_report, render_summary
from .observability import ConsoleExporter, JsonExporter
from .registry import DETECTORS, EXPORTERS, POLICIES, ROLLOUTS, SCENARIOS, THRESHOLDS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="driftwell")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all components")
    run = sub.add_parser("run", help="run a deployment on a scenario")
    run.add_argument("--config", help="YAML file; replaces the other choices")
    for name, default in (("detector", "diffusion"), ("rollout", "canary"), ("policy", "risk_aware"), ("scenario", "healthy"), ("threshold", "sigma"), ("risk-tier", "standard")):
        run.add_argument(f"--{name}", default=default)
    run.add_argument("--seed", type=int, default=0)
    run.add_argument("--json", help="file for the events")
    run.add_argument("--quiet", action="store_true", help="no line for each event")
    run.add_argument("--report", action="store_true", help="the whole report, not the summary alone")
    return p


def main(args: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(args)
    if a.command == "list":
        for kind, registry in (("detectors", DETECTORS), ("thresholds", THRESHOLDS), ("rollouts", ROLLOUTS), ("policies", POLICIES), ("exporters", EXPORTERS), ("scenarios", SCENARIOS)):
            print(f"{kind}: {', '.join(registry.names())}")
        return 0
    config = DeploymentConfig.from_yaml(a.config) if a.config else DeploymentConfig.from_dict(
        {"detector": a.detector, "rollout": a.rollout, "policy": a.policy, "scenario": a.scenario, "threshold": a.threshold, "risk_tier": a.risk_tier, "seed": a.seed}
    )
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("driftwell").getOrCreate()
    spec: ComponentSpec = config.scenario
    scenario = build_scenario(spark, spec.name, **({"seed": config.seed} | spec.params))
    deployment = build(config)
    deployment.exporters = [*([] if a.quiet else [ConsoleExporter()]), *([JsonExporter(a.json)] if a.json else [])]
    report = deployment.fit(scenario.baseline).run(scenario.windows)
    print(render_report(report) if a.report else render_summary(report))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
