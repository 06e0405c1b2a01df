"""python -m tandem PHASE ...: the phases of a study from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import phases
from .sources import readers, writers


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tandem")
    sub = top.add_subparsers(dest="phase", required=True)

    def phase(name: str, *flags: tuple[str, dict]) -> None:
        p = sub.add_parser(name)
        p.add_argument("--projects-dir", default="./projects")
        for flag, options in flags:
            p.add_argument(flag, **options)

    project = ("--project", {"required": True})
    phase("ingest", ("--repo-url", {"required": True}), ("--repo-name", {}), ("--branch", {}), ("--max-commits", {"type": int}))
    phase("analyze", project, ("--source-dir", {}))
    phase("features", project)
    phase("labels", project, ("--mode", {"choices": ["hybrid", "static"], "default": "hybrid"}), ("--min-cochange", {"type": int, "default": 3}), ("--negative-ratio", {"type": float, "default": 2.5}), ("--max-commits", {"type": int}))
    phase("pairs", project)
    phase("train", project)
    phase("train-joint", ("--projects", {"nargs": "+", "required": True}), ("--output-dir", {"default": "./model"}))
    phase("predict", project, ("--model-path", {"required": True}), ("--threshold", {"type": float, "default": 0.7}), ("--max-distance", {"type": int, "default": 2}), ("--output-format", {"choices": ["parquet", "graphml", "json"], "default": "parquet"}))
    phase("evaluate", ("--source", {"required": True}), ("--target", {"required": True}), ("--threshold", {"type": float, "default": 0.5}), ("--model-path", {}))
    return top


def main(args: list[str] | None = None) -> None:
    a = _parser().parse_args(args)
    spark = SparkSession.builder.appName("tandem").getOrCreate()
    of = lambda name: phases.Project(spark, a.projects_dir, name)
    match a.phase:
        case "ingest":
            p = phases.ingest(spark, a.repo_url, a.projects_dir, a.repo_name, a.branch, a.max_commits)
            print(writers.report(p.read("stats/totals")))
        case "analyze":
            phases.analyze(of(a.project), a.source_dir)
        case "features":
            phases.extract_features(of(a.project))
        case "labels":
            phases.generate_labels(of(a.project), a.mode, a.min_cochange, a.negative_ratio, a.max_commits)
        case "pairs":
            phases.pair_dataset(of(a.project))
        case "train":
            phases.train_single(of(a.project))
            print(writers.report(of(a.project).read("metrics/test")))
        case "train-joint":
            print(phases.train_joint(spark, [of(n) for n in a.projects], a.output_dir)[1])
        case "predict":
            phases.predict_graph(of(a.project), readers.model(a.model_path), a.threshold, a.max_distance, a.output_format)
        case "evaluate":
            model = readers.model(a.model_path or of(a.source).path("model"))
            print(writers.report(phases.evaluate_cross_project(model, of(a.target), a.threshold)))


if __name__ == "__main__":
    main()
