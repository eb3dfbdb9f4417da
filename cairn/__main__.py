"""Commands: ingest search aggregate get-log put get delete scan stats flush compact."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime

from pyspark.sql import SparkSession

from .operators.search import Query
from .plans.engine import Engine, SearchEngine, since
from .sources.json_ingest import read_logs


def line(r: dict) -> str:
    """A log in one line: local time to the millisecond, level, service, the first 8 characters of the id, message."""
    at = datetime.fromtimestamp(r["timestamp"] / 1e9).strftime("%Y-%m-%d %H:%M:%S.%f")[:-3]
    return f"{at} {r['level']:<5} {r['service']} [{r['id'][:8]}] {r['message']}"


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="cairn", description=__doc__)
    top.add_argument("--root", default="cairn-data")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("ingest")
    p.add_argument("file", nargs="?", help="JSON object, array or lines; standard input if not given")
    p.add_argument("--lines", action="store_true", help="an object per line: the file may be of any size")
    for name, limit in (("search", 20), ("aggregate", 0)):
        p = sub.add_parser(name)
        p.add_argument("text", nargs="?", default="")
        for o in ("level", "service", "host", "since"):
            p.add_argument(f"--{o}", default="")
        p.add_argument("--from", dest="start", type=int, default=0, help="nanoseconds; --since counts back from now instead")
        p.add_argument("--to", type=int, default=0, help="nanoseconds, inclusive")
        p.add_argument("--field", action="append", default=[], metavar="NAME=VALUE")
        p.add_argument("--json", action="store_true", help="whole records instead of a line each")
        p.add_argument("--limit", type=int, default=limit)
        p.add_argument("--offset", type=int, default=0)
        p.add_argument("--interval", default="1m")
    for name in ("get-log", "get", "delete"):
        sub.add_parser(name).add_argument("key")
    p = sub.add_parser("put")
    p.add_argument("key")
    p.add_argument("value")
    p = sub.add_parser("scan")
    p.add_argument("start", nargs="?")
    p.add_argument("end", nargs="?")
    p.add_argument("--limit", type=int, default=100)
    for name in ("stats", "flush", "compact"):
        sub.add_parser(name)
    a = top.parse_args(argv)
    spark = SparkSession.builder.appName("cairn").getOrCreate()
    logs, data = lambda: SearchEngine(spark, f"{a.root}/logs"), lambda: Engine(spark, f"{a.root}/kv")
    if a.command == "ingest":
        if a.file and a.lines:  # read by the executors, in parts
            n, bad = logs().ingest(read_logs(spark, a.file))
        else:
            with open(a.file) if a.file else sys.stdin as f:
                n, bad = logs().ingest_json(f.read())
        print(json.dumps({"ingested": n, "rejected": bad}))
    elif a.command in ("search", "aggregate"):
        q = Query(a.text, a.level, a.service, a.host, since(a.since) if a.since else a.start, a.to, dict(f.partition("=")[::2] for f in a.field), a.limit, a.offset)
        if a.command == "search":
            got = logs().search(q)
            if a.json:
                print(json.dumps(got, ensure_ascii=False, indent=1))
            else:
                for r in got["logs"]:
                    print(line(r))
                print(f"{len(got['logs'])} of {got['total_hits']} hits, {got['took_ms']:.0f} ms")
        else:
            got = logs().aggregate(q, a.interval)
            most = max((b["count"] for b in got["buckets"]), default=1)
            for b in got["buckets"]:
                print(b["timestamp"], f"{b['count']:>8}", "█" * max(1, b["count"] * 40 // most))
            print("total", got["total"])
    elif a.command == "get-log":
        print(json.dumps(logs().get(a.key), ensure_ascii=False))
    elif a.command == "put":
        data().put(a.key.encode(), a.value.encode())
    elif a.command == "get":
        value = data().get(a.key.encode())
        print("not found" if value is None else value.decode("utf-8", "replace"))
        return int(value is None)
    elif a.command == "delete":
        data().delete(a.key.encode())
    elif a.command == "scan":
        for k, v in data().scan(a.start and a.start.encode(), a.end and a.end.encode(), a.limit):
            print(k.decode("utf-8", "replace"), v.decode("utf-8", "replace"), sep="\t")
    elif a.command == "stats":
        print(data().metrics(), end="")
    elif a.command == "compact":
        print(data().compact(), "compactions")
    else:
        print("every write is flushed when it is made")
    return 0


if __name__ == "__main__":
    sys.exit(main())
