"""python -m quarry [PROJECT]: analyze a project and write the report as JSON, Markdown or both."""

from __future__ import annotations

import argparse
import re
import sys
import time
from pathlib import Path


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarry", description="Evidence-first analysis of a code repository")
    parser.add_argument("project", nargs="?", default=".")
    parser.add_argument("-f", "--format", choices=("json", "markdown", "both"), default="both")
    parser.add_argument("-o", "--output", default="quarry-report", help="output file without ending")
    parser.add_argument("--exclude", nargs="*", default=[], help="more glob patterns to leave out")
    parser.add_argument("--full-graph", action="store_true", help="every resolved edge in the JSON report")
    parser.add_argument("--no-pretty", action="store_true", help="compact JSON")
    options = parser.parse_args(arguments)

    from pyspark.sql import SparkSession

    from quarry.plans.markdown import render
    from quarry.plans.project import analyze_project, to_json

    spark = SparkSession.builder.appName("quarry").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    began = time.time()
    try:
        report = analyze_project(spark, options.project, exclude=options.exclude, full_graph=options.full_graph)
    except (OSError, ValueError) as e:
        print(f"quarry: {e}", file=sys.stderr)
        return 1
    base = Path(re.sub(r"\.(json|md)$", "", options.output, flags=re.I)).resolve()
    base.parent.mkdir(parents=True, exist_ok=True)
    for kind, ending, text in (("json", ".json", lambda: to_json(report, not options.no_pretty) + "\n"), ("markdown", ".md", lambda: render(report))):
        if options.format in (kind, "both"):
            out = base.with_name(base.name + ending)
            out.write_text(text(), encoding="utf-8")
            print(out)
    print(f"Done in {time.time() - began:.1f}s. {report['summary']['candidateClasses']} unreachable types.", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
