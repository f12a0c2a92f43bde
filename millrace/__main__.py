"""Command line: run, lint, test, blobl, list, explain."""

from __future__ import annotations

import argparse
import os
import sys


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "lint", "test", "echo"):
        commands.add_parser(name).add_argument("config")
    commands.add_parser("blobl").add_argument("mapping")
    commands.add_parser("list").add_argument("kind", nargs="?", choices=("methods", "functions", "processors", "inputs", "outputs", "scanners"))
    create = commands.add_parser("create")
    create.add_argument("expression", help="input/processor,processor/output")
    given = parser.parse_args(args)
    if given.command == "blobl":
        from millrace.functions.values import MappingError
        from millrace.plans.evaluator import Message, State, map_message, program

        p, state = program(given.mapping), State()
        for line in sys.stdin.buffer:
            try:
                out = map_message(p, Message(line.rstrip(b"\n")), state=state)
                print("" if out is None else f"error: {out.err['msg']}" if out.err else out.content.decode("utf-8", "replace"))
            except MappingError as e:
                print(f"error: {e}")
        return 0
    if given.command == "list":
        from millrace.config import INPUTS, OUTPUTS
        from millrace.functions.table import FUNCTIONS, METHODS
        from millrace.operators.flow import PROCESSORS
        from millrace.plans import evaluator
        from millrace.sources.scanners import KINDS

        assert evaluator
        every = {"methods": sorted(METHODS), "functions": sorted(FUNCTIONS), "processors": sorted(PROCESSORS), "inputs": sorted(INPUTS), "outputs": sorted(OUTPUTS), "scanners": sorted(KINDS)}
        for kind, names in every.items():
            if given.kind in (None, kind):
                print(f"{kind}: {', '.join(names)}")
        return 0
    if given.command == "create":
        import yaml

        source, processors, sink = (given.expression.split("/") + ["", "", ""])[:3]
        print(yaml.safe_dump({"input": {source or "stdin": {}}, "pipeline": {"processors": [{p: {}} for p in processors.split(",") if p]}, "output": {sink or "stdout": {}}}, sort_keys=False), end="")
        return 0
    from millrace.config import lint, load, run_tests

    with open(given.config) as f:
        text = f.read()
    if given.command == "echo":
        import yaml

        print(yaml.safe_dump(load(text), sort_keys=False), end="")
        return 0
    problems = lint(text)
    for p in problems:
        print(p, file=sys.stderr)
    if given.command == "lint" or problems:
        return int(bool(problems))
    if given.command == "test":
        failed = 0
        for outcome in run_tests(text, os.path.dirname(os.path.abspath(given.config))):
            print(("FAIL " if outcome.problems else "ok   ") + outcome.name)
            for p in outcome.problems:
                print("     " + p)
            failed += bool(outcome.problems)
        return int(bool(failed))
    from pyspark.sql import SparkSession

    from millrace.pipeline import run

    run(SparkSession.builder.appName("millrace").getOrCreate(), load(text))
    return 0


if __name__ == "__main__":
    sys.exit(main())
