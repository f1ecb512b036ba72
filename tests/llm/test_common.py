import ctypes
import os

import pyarrow as pa
import pytest
from oriel.llm.common import giving_back

PAGE = os.sysconf("SC_PAGE_SIZE")


def resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * PAGE


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="not glibc")
def test_a_worker_is_small_after_a_task():
    pins = []

    def run(batches):
        for b in batches:
            blocks = [bytearray(b"x" * 60_000) for _ in range(3000)]
            pins.append(blocks[-1])  # what lies below a block in use stays with the process
            yield b

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["a"])
    assert list(run([batch])) == [batch]
    large = resident()
    assert list(giving_back(run)([batch])) == [batch]
    assert resident() < large - 100_000_000
