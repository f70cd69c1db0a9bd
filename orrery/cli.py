"""Command line: ``experiment``, ``evaluate`` and ``query``."""

from __future__ import annotations

import argparse
import contextlib
import logging
import sys

from orrery.config import DATASETS, Dataset, Solver
from orrery.operators.chunks import chunks_from_events
from orrery.plans import experiment as ex
from orrery.session import session
from orrery.sources.signals import read_signals, signals_from_events
from orrery.storage import stored


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="orrery")
    p.add_argument("--master")
    p.add_argument("--log-file")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("experiment", help="train, stream and store artifacts of all scenarios")
    e.add_argument("--signals", nargs="+", help="Parquet tables of signals, one for each data set")
    e.add_argument("--events", help="Parquet table of events, in place of signals")
    e.add_argument("--dataset", nargs="+", choices=[*DATASETS, "events"], default=["cwru"])
    e.add_argument("--out-dir", required=True)
    e.add_argument("--otta-mode", choices=["dual", "single"], default="dual")
    e.add_argument("--kernel", choices=["linear", "rbf", "poly"], default="linear")
    e.add_argument("--gamma", type=float, help="of the rbf or poly kernel; rbf without it takes the median heuristic")
    e.add_argument("--nu", type=float, default=0.1)
    e.add_argument("--workers", type=int, help="local cores, where no master is given")
    e.add_argument("--chunk", type=int, help="with --events: read signals as chunks of so many samples, for signals larger than a row should be")
    e.add_argument("--source", type=int)
    e.add_argument("--target", type=int)
    v = sub.add_parser("evaluate", help="reports from stored artifacts")
    v.add_argument("--results-root", required=True)
    v.add_argument("--out-dir", required=True)
    v.add_argument("--kernel", choices=["linear", "rbf", "poly"])
    q = sub.add_parser("query", help="run a registered query and show it")
    q.add_argument("name")
    q.add_argument("--tables", required=True)
    return p


class Tee:
    """Standard output that goes to a log file as well."""

    def __init__(self, *to):
        self.to = to

    def write(self, text: str) -> int:
        for t in self.to:
            t.write(text)
        return len(text)

    def flush(self) -> None:
        for t in self.to:
            t.flush()


def main(argv: list[str] | None = None) -> None:
    p = parser()
    a = p.parse_args(argv)
    if not a.log_file:
        return _run(p, a)
    with open(a.log_file, "a", encoding="utf-8") as log, contextlib.redirect_stdout(Tee(sys.stdout, log)):
        try:
            _run(p, a)
        finally:
            logging.basicConfig(handlers=[logging.StreamHandler(sys.__stderr__)], force=True)  # the log is closed from here on


def _run(p: argparse.ArgumentParser, a: argparse.Namespace) -> None:
    if a.command == "experiment" and not a.events and len(a.signals or []) != len(a.dataset):
        p.error("a table of signals is needed for each data set")
    if a.command == "experiment" and a.kernel == "poly" and a.gamma is None:
        p.error("the poly kernel needs --gamma")
    logging.basicConfig(level=logging.INFO, handlers=[logging.StreamHandler(sys.stdout if a.log_file else None)], force=True)
    spark = session(a.master or (f"local[{a.workers}]" if getattr(a, "workers", None) else None))
    if a.command == "experiment":
        solver = Solver(mode=a.otta_mode, kernel=a.kernel, gamma=a.gamma, nu=a.nu)
        for name, path in zip(a.dataset, [a.events] if a.events else a.signals):
            dataset = DATASETS.get(name) or Dataset("events", {}, 16, None, (0.5, 1.5), 1)
            if dataset.domains and any(x is not None and x not in dataset.domains.values() for x in (a.source, a.target)):
                p.error(f"{name} has the domains {sorted(dataset.domains.values())}")
            if a.events and a.chunk:
                signals = stored(chunks_from_events(spark.read.parquet(path), a.chunk), "chunks")
            else:
                signals = signals_from_events(spark.read.parquet(path)) if a.events else read_signals(spark, path)
            ex.run_experiment(spark, signals, dataset, f"{a.out_dir}/{name}" if len(a.dataset) > 1 else a.out_dir, solver, a.source, a.target, chunk=a.chunk if a.events else None)
        logging.info("artifacts in %s", a.out_dir)
    elif a.command == "evaluate":
        ex.evaluate_distances(spark, a.results_root, a.out_dir, kernel=a.kernel)
        ex.evaluate_stream(spark, a.results_root, a.out_dir, a.kernel)
        logging.info("reports in %s", a.out_dir)
    else:
        from orrery.plans.queries import QUERIES

        QUERIES[a.name](spark, a.tables).show(50, truncate=False)


if __name__ == "__main__":
    main()
