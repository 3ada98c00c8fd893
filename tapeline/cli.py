"""python -m tapeline.cli [--profile NAME] version | config show | config hash. Survey id: C4."""

from __future__ import annotations

import argparse

from . import __version__, config, logs
from .clock import LiveClock


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tapeline")
    parser.add_argument("--profile", "-p", choices=config.PROFILES)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version", help="print the version")
    shown = commands.add_parser("config", help="print what a process would run with").add_subparsers(dest="what", required=True)
    shown.add_parser("show", help="all settings, their hash and the run's id")
    shown.add_parser("hash", help="the hash alone")
    args = parser.parse_args(argv)
    settings = config.load(args.profile)
    run = logs.configure(settings, LiveClock())
    if args.command == "version":
        print(__version__)
    elif args.what == "hash":
        print(config.config_hash(settings))
    else:
        print(config.describe(settings))
        print(f"{'config_hash':<20} {config.config_hash(settings)}")
        print(f"{'run_id':<20} {run}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
