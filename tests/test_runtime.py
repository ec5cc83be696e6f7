"""What the shared-folder helpers leave behind."""

from __future__ import annotations

import ctypes
import os
import re
from pathlib import Path

from linkforge import runtime


def _collections(spark) -> int:
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_cut_gives_the_drivers_heap_back_once_it_is_large(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HEAP_SHARE", 0.0)
    before = _collections(spark)
    assert runtime.cut(spark.range(5), "five").count() == 5
    assert _collections(spark) > before
    monkeypatch.setattr(runtime, "HEAP_SHARE", 1.0)
    before = _collections(spark)
    assert runtime.cut(spark.range(5), "five").count() == 5
    assert _collections(spark) == before


def test_memory_freed_by_native_code_goes_back_to_the_system(spark):
    def held() -> int:
        return int(re.search(r"RssAnon:\s+(\d+)", Path(f"/proc/{os.getpid()}/status").read_text()).group(1))

    libc = ctypes.CDLL(None)
    libc.malloc.restype, libc.malloc.argtypes, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p]
    size = 64 << 10  # below the size that is mapped by itself
    blocks = [libc.malloc(size) for _ in range(1024)]
    for b in blocks:
        ctypes.memset(b, 1, size)
    for b in blocks[:-1]:  # the last one keeps the heap from shrinking by itself
        libc.free(b)
    full = held()
    runtime.cut(spark.range(5), "five")
    assert held() < full - (32 << 10)
    libc.free(blocks[-1])
