"""Logging to the console and, if a file is named, to it."""

import logging
from pathlib import Path


def logger(name: str, file: str | None = None) -> logging.Logger:
    """The same logger for the same name, with its handlers added once."""
    log = logging.getLogger(name)
    if not log.handlers:
        log.setLevel(logging.INFO)
        handlers: list[logging.Handler] = [logging.StreamHandler()]
        if file:
            Path(file).parent.mkdir(parents=True, exist_ok=True)
            handlers.append(logging.FileHandler(file, encoding="utf-8"))
        for h in handlers:
            h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
            log.addHandler(h)
        log.propagate = False
    return log
