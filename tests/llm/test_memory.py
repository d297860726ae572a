import numpy as np
import psutil

from tidemark.llm import spans


def test_a_task_gives_free_memory_back():
    """Small blocks are freed but the last, so the allocator alone would keep them all."""
    size = lambda: psutil.Process().memory_info().rss
    kept = []

    def run(batches):
        for b in batches:
            blocks = [np.ones(8_000, np.int8) for _ in range(20_000)]
            kept.append(blocks[-1])
            del blocks
            held.append(size())
            yield b

    held: list[int] = []
    assert list(spans.freed(run)([1, 2])) == [1, 2]
    assert size() < max(held) - 100_000_000
