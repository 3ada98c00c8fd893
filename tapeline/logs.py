"""Driver logs that carry the run's identity. Survey ids: C5, C6. Logs go to stderr, answers to stdout."""

from __future__ import annotations

import json
import logging
import sys
from contextvars import ContextVar

from .clock import Clock
from .config import Settings, config_hash
from .functions.ids import run_id

_context: ContextVar[dict[str, str]] = ContextVar("tapeline_log_context", default={})


class _Json(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"level": record.levelname.lower(), "logger": record.name, "event": record.getMessage(), **_context.get()})


class _Console(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return f"{record.levelname:<8} {record.getMessage()} " + " ".join(f"{k}={v}" for k, v in _context.get().items())


def configure(settings: Settings, clock: Clock) -> str:
    """Set up the logs of a run and return its id: lines for people in research, JSON elsewhere."""
    fingerprint = config_hash(settings)
    run = run_id(fingerprint, clock.now_ns())
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(_Console() if settings.profile == "research" else _Json())
    log = logging.getLogger("tapeline")
    log.handlers[:] = [handler]
    log.setLevel(settings.log_level)
    log.propagate = False
    clear_context()
    bind(run_id=run, profile=settings.profile, config_hash=fingerprint)
    return run


def bind(**values: str) -> None:
    _context.set(_context.get() | values)


def clear_context() -> None:
    _context.set({})


def get_logger(name: str = "") -> logging.Logger:
    return logging.getLogger(f"tapeline.{name}" if name else "tapeline")
