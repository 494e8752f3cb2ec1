"""Logging on the driver."""

from __future__ import annotations

import logging
import os

from quire.config import Config


def get_logger(name: str, config: Config | None = None, path: str = "quire-debug.log") -> logging.Logger:
    """A logger to the console; with ``QUIRE_DEBUG`` set or ``ui_settings.enable_debug`` on, all of it also goes to a file."""
    log = logging.getLogger(name)
    if log.handlers:
        return log
    line = logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s")
    debug = bool(os.environ.get("QUIRE_DEBUG")) or bool(config and config.get("ui_settings.enable_debug"))
    console = logging.StreamHandler()
    console.setLevel(logging.INFO)
    for handler in [console, *([logging.FileHandler(path, encoding="utf-8")] if debug else [])]:
        handler.setFormatter(line)
        log.addHandler(handler)
    log.setLevel(logging.DEBUG if debug else logging.INFO)
    log.propagate = False
    return log
