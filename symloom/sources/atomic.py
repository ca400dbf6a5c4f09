"""Atomic replacement of a source file, on the driver only."""

from __future__ import annotations

import os
import tempfile


def write_text(path: str, text: str) -> None:
    """A temporary file beside the target, synced, then renamed over it."""
    folder = os.path.dirname(path)
    handle, name = tempfile.mkstemp(dir=folder, prefix=".symloom-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(text.encode())
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise
