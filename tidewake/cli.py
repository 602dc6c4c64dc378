"""A small shell: statements from the arguments or line by line, rows to standard output; and collecting and forwarding.

A configuration of --collect is {"include": [..], "exclude": [..], "schemas": [{"path": "..", "tags": {..},
"fields": {..}, "fmt": "..", "date_patterns": [..], "keys": [..]}], "checkpoint": "..", "every": "10 seconds"},
one of --forward {"workers": {name: {"pipe": "..", "source": "..", "where": "..", "sink": {"type": "stdout"} or
{"type": "syslog", "protocol": "tcp", "address": "host:port"}}}, "checkpoints": "..", "every": "10 seconds"}.
Without "every" what there is is taken once. An interrupt, or a file named stop in the store, ends both.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from .errors import StatementError
from .functions import formatter
from .language import ast
from .language.parser import parse
from .plans.engine import Engine

DEFAULT_FORMAT, DEFAULT_LIMIT = "{msg}\n", 50


def run(engine: Engine, text: str, out=sys.stdout) -> None:
    """Run one statement and print its rows."""
    what = parse(text)
    if not isinstance(what, ast.Select):
        frame = engine.execute(text)
        print("\t".join(frame.columns), file=out)
        for row in frame.toLocalIterator():
            print("\t".join(map(str, row)), file=out)
        return
    rows = engine.rows(what, limit=DEFAULT_LIMIT if what.limit is None else None)
    template = what.format if what.format is not None else DEFAULT_FORMAT
    for row in rows.select(formatter.render(template, trim_msg=True).alias("line")).toLocalIterator():
        out.write(row["line"])


def trigger_of(config: dict) -> dict:
    return {"processingTime": config["every"]} if "every" in config else {"availableNow": True}


def collect(engine: Engine, config: dict) -> list:
    """Start the collector of a configuration; its streaming query."""
    from .sources.collector import Collector, PathSchema

    collector = Collector(config["include"], [PathSchema(**s) for s in config["schemas"]], config.get("exclude", []))
    return [engine.collect(collector, config["checkpoint"], config.get("idle"), **trigger_of(config))]


def forward(engine: Engine, config: dict, out=None) -> list:
    """Make the pipes of a configuration, run them and forward what they copy; the streaming queries."""
    from .sinks.stdout import Stdout
    from .sinks.syslog import Syslog, Target
    from .streaming.forward import Forwarder

    trigger = trigger_of(config)
    workers, queries = {}, []
    for name, worker in config["workers"].items():
        sink = dict(worker["sink"])
        kind = sink.pop("type")
        workers[name] = (worker["pipe"], Stdout(out or sys.stdout) if kind == "stdout" else Syslog(Target(**sink)))
        engine.pipes.ensure(worker["pipe"], worker.get("source", ""), worker.get("where", ""))
        copying = engine.pipes.start(worker["pipe"], **trigger)
        if copying is not None and "every" not in config:
            copying.awaitTermination()
        queries += [copying] if copying is not None else []
    forwarder = Forwarder(engine, config["checkpoints"], **trigger)
    forwarder.sync(workers)
    return queries + [query for _, query in forwarder.running.values()]


def follow(engine: Engine, queries: list) -> None:
    """Wait until the queries end, or stop them on an interrupt or where the store has a file named stop."""
    try:
        while any(q.isActive for q in queries):
            if engine.store.exists("stop"):
                engine.store.delete("stop")
                break
            time.sleep(0.5)
    except KeyboardInterrupt:
        pass
    for q in queries:
        q.stop()
        if q.exception() is not None:
            raise q.exception()


def main(arguments: list[str] | None = None) -> int:
    options = argparse.ArgumentParser(description=__doc__)
    options.add_argument("root", help="folder of the store")
    options.add_argument("statement", nargs="*", help="a statement; without one they are read line by line, to quit or exit")
    options.add_argument("--collect", metavar="FILE", help="a collector's configuration to run")
    options.add_argument("--forward", metavar="FILE", help="a forwarder's configuration to run")
    options.add_argument("--stop", action="store_true", help="end what collects and forwards into or from this store")
    given = options.parse_args(arguments)
    engine = Engine(SparkSession.builder.getOrCreate(), given.root)
    if given.stop:
        engine.store.write_text("stop", "")
        return 0
    for file, start in ((given.collect, collect), (given.forward, forward)):
        if file:
            with open(file, encoding="utf-8") as f:
                follow(engine, start(engine, json.load(f)))
    if given.collect or given.forward:
        return 0
    lines = [" ".join(given.statement)] if given.statement else (x.strip() for x in sys.stdin)
    failed = 0
    for line in lines:
        if line.lower() in ("quit", "exit"):
            break
        if not line:
            continue
        try:
            run(engine, line)
        except (StatementError, ValueError) as e:
            failed = 1
            print(f"error: {e}", file=sys.stderr)
    return failed


if __name__ == "__main__":
    sys.exit(main())
