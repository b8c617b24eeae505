"""A log file and the terminal for one run, named by what runs and when."""

from __future__ import annotations

import logging
import re
from datetime import datetime
from pathlib import Path


def run_log(folder: str, *names: str, level: int = logging.INFO, now: datetime | None = None) -> logging.Logger:
    """A logger of its own that writes to ``<folder>/<names>_<time>.log`` and to the terminal.

    ``names`` say what runs (model, data set, variant); signs unfit for a file
    name become ``-``. Asking again for the same run gives the same logger,
    without doubled lines.
    """
    stem = "_".join([*(re.sub(r"[^\w.-]+", "-", n) for n in names), (now or datetime.now()).strftime("%Y%m%d_%H%M%S")])
    logger = logging.getLogger(f"pathloom.run.{folder}.{stem}")
    if not logger.handlers:
        Path(folder).mkdir(parents=True, exist_ok=True)
        form = logging.Formatter("%(asctime)s %(levelname)s %(message)s")
        for handler in (logging.FileHandler(Path(folder) / f"{stem}.log", encoding="utf-8"), logging.StreamHandler()):
            handler.setFormatter(form)
            logger.addHandler(handler)
        logger.setLevel(level)
        logger.propagate = False
    return logger
