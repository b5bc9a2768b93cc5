"""Command line: list, matrix, show, validate, template, hash."""

from __future__ import annotations

import argparse
import json
import sys

from . import config, registry


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="volumetra")
    sub = parser.add_subparsers(dest="what", required=True)
    a = sub.add_parser("list")
    a.add_argument("--backend", choices=registry.BACKENDS)
    a.add_argument("--group", choices=registry.GROUPS)
    sub.add_parser("matrix")
    sub.add_parser("show").add_argument("name")
    sub.add_parser("validate").add_argument("path")
    sub.add_parser("template").add_argument("backend", choices=registry.BACKENDS)
    sub.add_parser("hash").add_argument("path")
    args = parser.parse_args(argv)
    try:
        if args.what == "list":
            for e in registry.entries(args.backend, args.group):
                print(f"{e.name}\t{e.backend}\t{e.group}\t{e.concept}")
        elif args.what == "matrix":
            rows: dict[str, dict] = {}
            for e in registry.entries():
                rows.setdefault(e.concept, {}).setdefault(e.backend, e.name)
            for concept, r in rows.items():
                print(f"{concept}\t{r.get('GPU', '-')}\t{r.get('CPU', '-')}")
        elif args.what == "show":
            e = registry.get(args.name)
            print(json.dumps({"name": e.name, "backend": e.backend, "group": e.group, "concept": e.concept, "parameters": e.defaults(), "required": sorted(e.required)}, indent=1, default=str))
        elif args.what == "validate":
            config.Config.load(args.path)
            print("ok")
        elif args.what == "template":
            print(json.dumps(registry.template(args.backend), indent=1, default=list))
        else:
            with open(args.path, encoding="utf-8") as f:
                print(config.config_hash(json.load(f))[:8])
    except (registry.UnknownOperator, config.InvalidConfig, OSError, json.JSONDecodeError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
