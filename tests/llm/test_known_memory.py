"""What encoders keep is bounded by the memory it takes."""

from __future__ import annotations

import gc
import tracemalloc

from quantweave.llm.encoders import Known


def test_known_pieces_take_no_more_than_their_limit():
    limit = 8_000_000
    known = Known(lambda new: [p.encode()[:4] * 2 for p in new], limit)
    gc.collect()
    tracemalloc.start()
    try:
        most = 0
        for start in range(0, 120_000, 2000):
            known.ids([f"p{i}" for i in range(start, start + 2000)])
            most = max(most, tracemalloc.get_traced_memory()[0])
    finally:
        tracemalloc.stop()
    assert most < 1.1 * limit and len(known) > 2000
