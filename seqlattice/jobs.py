"""Jobs in YAML, and the command line.

A job names its task, inputs, parameters and output; paths are relative to the file, unknown
keys are errors. A pipeline lists jobs, which run in order and stop at the first failure.
Options given on the command line override the file, which overrides the defaults.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass, fields
from pathlib import Path

import pandas as pd
import yaml

from . import tasks

VERSION = "0.1.0"


class JobError(ValueError):
    """A job that can't be read or run."""


@dataclass(frozen=True)
class Task:
    options: type
    run: Callable
    paths: tuple[str, ...]  # options that are paths
    outputs: str  # 'stdout': a report; 'files': tables under a prefix; 'option': the output option
    aliases: dict[str, str]  # names in a job file -> options
    about: str


TASKS = {
    "array": Task(tasks.ArrayOptions, tasks.run_array, ("bed", "genome", "output"), "option", {"file": "output"}, "build the k-mer index of a BED file's regions"),
    "intensities": Task(tasks.IntensityOptions, tasks.run_intensities, ("bed", "signal", "genome", "output"), "option", {"file": "output", "genome_fasta": "genome"}, "summarise a signal over regions and correct it for composition"),
    "snv": Task(tasks.VariantOptions, tasks.run_variants, ("intensities", "array", "genome", "snv_list_file"), "stdout", {"variants": "snv_list_file", "snv": "snv_list"}, "effects of single-base variants"),
    "scan": Task(tasks.ScanOptions, tasks.run_scan, ("intensities", "array", "genome"), "stdout", {}, "effects of every base of an interval"),
    "motifs": Task(tasks.MotifOptions, tasks.run_motifs, ("intensities", "array", "genome"), "files", {}, "a probability matrix from ranked regions"),
    "calibrate_max_probes": Task(tasks.CapOptions, tasks.run_caps, ("intensities", "array"), "files", {}, "stability of effects under a cap"),
    "calibrate_mask": Task(tasks.MaskOptions, tasks.run_masks, ("intensities", "genome"), "files", {}, "stability of effects under masks"),
}


def load(path: str | os.PathLike) -> dict:
    """A job file as {task, options, stdout, prefix} or {task: pipeline, steps}; paths made absolute."""
    source = Path(path).expanduser().resolve()
    try:
        job = yaml.safe_load(source.read_text())
    except (OSError, yaml.YAMLError) as e:
        raise JobError(f"{source}: {e}") from e
    if not isinstance(job, dict) or "task" not in job:
        raise JobError(f"{source}: a job is a mapping with a task")
    where = lambda p: str((source.parent / Path(os.path.expandvars(str(p))).expanduser()).resolve())
    if job["task"] == "pipeline":
        if set(job) - {"task", "steps"} or not isinstance(job.get("steps"), list) or not job["steps"]:
            raise JobError(f"{source}: a pipeline has steps and nothing else")
        return {"task": "pipeline", "source": source, "steps": [where(s) for s in job["steps"]]}
    task = TASKS.get(job["task"])
    if not task:
        raise JobError(f"{source}: unknown task {job['task']}; one of {', '.join([*TASKS, 'pipeline'])}")
    if extra := set(job) - {"task", "inputs", "parameters", "output"}:
        raise JobError(f"{source}: unknown keys {sorted(extra)}")
    known, out = {f.name for f in fields(task.options)}, {"task": job["task"], "source": source, "options": {}, "stdout": None, "prefix": None}
    for part in ("inputs", "parameters", "output"):
        values = job.get(part) or {}
        if not isinstance(values, dict):
            raise JobError(f"{source}: {part} is a mapping")
        for key, value in values.items():
            name = task.aliases.get(key, key)
            if part == "output" and name in ("stdout", "prefix"):
                out[name] = where(value)
            elif name in known:
                out["options"][name] = where(value) if name in task.paths and value is not None else value
            else:
                raise JobError(f"{source}: unknown key {part}.{key}")
    return out


def run_file(spark_of: Callable, path: str, overrides: dict | None = None, dry_run: bool = False, stack: tuple = ()) -> None:
    job = load(path)
    if job["source"] in stack:
        raise JobError(f"the pipeline calls itself: {job['source']}")
    if job["task"] == "pipeline":
        if overrides:
            raise JobError("options override single jobs, not pipelines")
        for step in job["steps"]:
            run_file(spark_of, step, None, dry_run, (*stack, job["source"]))
        return
    options = job["options"] | (overrides or {})
    if dry_run:
        print(job["task"], *(f"{k}={v!r}" for k, v in options.items()), *([f"> {job['stdout'] or job['prefix']}"] if job["stdout"] or job["prefix"] else []))
        return
    execute(spark_of(), job["task"], options, job["stdout"], job["prefix"])


def execute(spark, name: str, options: dict, stdout: str | None = None, prefix: str | None = None) -> None:
    task = TASKS[name]
    found = task.run(spark, task.options(**options))
    if task.outputs == "stdout":
        if stdout:
            Path(stdout).parent.mkdir(parents=True, exist_ok=True)
            Path(stdout).write_text(found)
        else:
            sys.stdout.write(found)
    elif task.outputs == "files":
        base = prefix or name
        Path(base).parent.mkdir(parents=True, exist_ok=True)
        for part, value in found.items():
            if isinstance(value, dict):
                value = pd.DataFrame([value])
            if isinstance(value, pd.DataFrame):
                value.to_csv(f"{base}.{part}.tsv", sep="\t", index=False, na_rep="NA" if name.startswith("calibrate") else "")
            else:
                Path(f"{base}.{'meme' if part == 'meme' else part + '.txt'}").write_text(value)


def template(name: str) -> str:
    """A job file with every option at its default."""
    if name == "pipeline":
        return "task: pipeline\n\nsteps:\n  - array.yaml\n  - intensities.yaml\n  - snv.yaml\n"
    task = TASKS[name]
    lines = [f"# {task.about}; paths are relative to this file", f"task: {name}", "", "inputs:"]
    inputs = [p for p in task.paths if p != "output"]
    lines += [f"  {p}:" for p in inputs] + ["", "parameters:"]
    for f in fields(task.options):
        if f.name not in task.paths:
            lines.append(f"  # {f.name}: {yaml.safe_dump(f.default).splitlines()[0]}")
    lines += ["", "output:", {"stdout": "  stdout: result.tsv", "files": "  prefix: result", "option": "  file: result"}[task.outputs]]
    return "\n".join(lines) + "\n"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqlattice", description="Sequence-affinity analytics on Spark")
    top.add_argument("--version", action="version", version=VERSION)
    sub = top.add_subparsers(dest="command", required=True)
    for name, task in TASKS.items():
        p = sub.add_parser(name.replace("_", "-"), help=task.about)
        for f in fields(task.options):
            flag = "--" + f.name.replace("_", "-")
            if str(f.type) == "bool":
                p.add_argument(flag, dest=f.name, action=argparse.BooleanOptionalAction, default=None)
            else:
                p.add_argument(flag, dest=f.name, default=None)
        p.add_argument("--stdout")
        p.add_argument("--prefix")
    p = sub.add_parser("run", help="run job files")
    p.add_argument("jobs", nargs="+")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--set", action="append", default=[], metavar="OPTION=VALUE", help="override an option of one job")
    p = sub.add_parser("template", help="print a job file")
    p.add_argument("name", choices=[*TASKS, "pipeline"])
    sub.add_parser("list", help="list the tasks")
    return top


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    command = args.pop("command").replace("-", "_")

    def spark_of():
        from .session import session

        return session()

    try:
        if command == "list":
            print("\n".join(f"{n}\t{t.about}" for n, t in TASKS.items()))
        elif command == "template":
            print(template(args["name"]), end="")
        elif command == "run":
            overrides = dict(x.split("=", 1) for x in args["set"])
            if overrides and len(args["jobs"]) > 1:
                raise JobError("options override one job")
            for job in args["jobs"]:
                run_file(spark_of, job, {k.replace("-", "_"): yaml.safe_load(v) for k, v in overrides.items()}, args["dry_run"])
        else:
            stdout, prefix = args.pop("stdout"), args.pop("prefix")
            execute(spark_of(), command, {k: v for k, v in args.items() if v is not None}, stdout, prefix)
    except (JobError, tasks.OptionError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0
