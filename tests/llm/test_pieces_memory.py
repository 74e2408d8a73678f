"""Memory that the sampling of segmentations takes, beside the texts and what is drawn."""

import random
import tracemalloc

import pyarrow as pa

from tessera.llm import pieces

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def test_memory_of_sampling():
    """Many different words: what is sampled at once and the lattices that a process keeps stay small, as several processes share an executor's memory with its JVM."""
    v = pieces.Vocabulary.load(VOCABULARY)
    v.tables()
    r = random.Random(3)
    word = lambda: "".join(r.choice("aeinorstlmd") for _ in range(r.randint(2, 11)))
    batches = [pa.record_batch([pa.array(range(400), pa.int64()), pa.array([" ".join(word() for _ in range(400)).encode() for _ in range(400)], pa.binary())], names=["doc_id", "text"]) for _ in range(2)]
    pieces._kept.clear()
    tracemalloc.start()
    try:
        n = sum(len(ids) for ids, *_ in pieces._each(batches, v, 2, 0))
        peak = tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()
        pieces._kept.clear()
    assert n == 800
    assert peak < 230, f"{peak:.0f} MiB"
