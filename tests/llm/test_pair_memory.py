"""Packets of many pairs are compared in little memory: workers outlive a stage and share their executor's."""

import tracemalloc

import numpy as np
import pyarrow as pa

from sorrel.llm import nearcopies, simhash


def _peak(call):
    tracemalloc.start()
    try:
        return call(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_packet_of_fingerprints_needs_little_memory():
    rng = np.random.default_rng(7)
    keys, each = 500, 90
    fp = rng.integers(-1 << 62, 1 << 62, keys * each)
    near = np.arange(0, len(fp), 10)
    fp[near + 1] = fp[near] ^ 5
    table = pa.table({"unit": np.repeat(np.arange(keys), each), "side": np.tile(np.arange(each) % 2, keys).astype(np.int8), "fp": fp})
    links, peak = _peak(lambda: simhash._verify_packet(table))
    assert {frozenset(p) for p in zip(*(links.column(c).to_pylist() for c in "uv"))} == {frozenset(p) for p in zip(fp[near].tolist(), fp[near + 1].tolist())}
    assert peak < 20


def test_a_packet_of_blocks_needs_little_memory():
    n = 1200
    rng = np.random.default_rng(8)
    odd = rng.integers(-1 << 62, 1 << 62, (n, nearcopies.PARITIES // 64))
    odd[1::2] = odd[::2]
    batch = pa.record_batch({"unit": np.zeros(n, np.int64), "side": np.ones(n, np.int32), "s": np.arange(n), "size": np.full(n, 300), "at": np.zeros(n, np.int64),
                             "root": np.arange(n), "odd": pa.array(list(odd), pa.list_(pa.int64()))})
    out, peak = _peak(lambda: list(nearcopies._meet((pa.scalar(0),), iter([batch]))))
    pairs = {(u, v) for b in out for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    assert pairs == {p for i in range(0, n, 2) for p in ((i, i + 1), (i + 1, i))}
    assert peak < 20


def test_code_tables_that_a_worker_keeps_are_small():
    tracemalloc.start()
    try:
        tables = simhash._tables.__wrapped__()
        held = tracemalloc.get_traced_memory()[0] / 1e6
    finally:
        tracemalloc.stop()
    assert sum(map(len, tables[1])) == 8855
    assert held < 5
