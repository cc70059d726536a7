"""Vocabulary files on the executors: the driver reads a file once and broadcasts its bytes.

A vocabulary file is a few megabytes at most, whatever the size of the corpus; ``MAX_BYTES`` is
checked before the broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from . import worker_memory

MAX_BYTES = 64 << 20


class SharedFile:
    """A file's bytes, broadcast; ``built(f)`` gives ``f(bytes)``, made once while a process works with it."""

    def __init__(self, spark: SparkSession, path: str):
        data = Path(path).read_bytes()
        if len(data) > MAX_BYTES:
            raise ValueError(f"{path} has {len(data)} bytes; a vocabulary may have {MAX_BYTES}")
        self.digest = hashlib.sha256(data).hexdigest()
        self.data = spark.sparkContext.broadcast(data)

    def built(self, make: Callable[[bytes], Any]) -> Any:
        return worker_memory.built(make.__qualname__, self.digest, lambda: make(self.data.value))
