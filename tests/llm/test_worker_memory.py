"""What the text operators' maps take of a Python worker's memory, and leave held when a task has ended."""

import os
import random
import subprocess
import sys
import tracemalloc

import numpy as np
import public_tokenizers

from framequery.llm import bpe, simhash

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Runs an operator's function on the rows of a table as a worker does, twice; prints the MB that could have gone back.
LEFT = """
import ctypes, re, sys
import pyarrow.parquet as pq
import public_tokenizers
from unittest import mock
from framequery.llm import bpe, simhash

docs = mock.MagicMock()
docs.select.return_value = docs
with mock.patch("pyspark.sql.functions.col"):
    simhash.fingerprints(docs) if sys.argv[1] == "simhash" else bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
run = docs.mapInArrow.call_args[0][0]

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

table = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).slice(0, 3000)
for _ in range(2):
    for batch in run(iter(table.to_batches())):
        pass
    del batch
before = held()
ctypes.CDLL(None).malloc_trim(0)
print(before - held())
"""


def left(name):
    """MB that a worker's C library still holds for nothing after a task of the operator."""
    out = subprocess.run([sys.executable, "-c", LEFT, name], capture_output=True, text=True, cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT})
    assert out.returncode == 0, out.stderr
    return float(out.stdout)


def peak(call, *args):
    tracemalloc.start()
    try:
        out = call(*args)
        return out, tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_op7_task_gives_its_memory_back():
    assert left("bpe") < 15


def test_op5_task_gives_its_memory_back():
    assert left("simhash") < 15


def test_op5_bits_are_counted_by_bounded_parts():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 1 << 63, 200_000).astype(np.uint64)
    offsets = np.concatenate([[0], np.sort(rng.choice(200_000, 99, replace=False)), [200_000]])
    got, mb = peak(simhash.majority_bits, hashes, offsets)
    for k in range(100):
        own = hashes[offsets[k] : offsets[k + 1]]
        want = sum(1 << b for b in range(64) if 2 * int((own >> np.uint64(b) & np.uint64(1)).sum()) > len(own))
        assert int(got[k]) == want
    assert mb < 40


def test_op7_exact_merges_are_made_by_bounded_parts():
    rng = random.Random(7)
    words = list({"".join(rng.choice("etaoinshrdlu") for _ in range(40)).encode() for _ in range(20_000)})
    table = bpe.word_bpe(public_tokenizers.path("word_bpe_49k.json"))
    (ids, offsets), mb = peak(table.encode_words, words)
    for k in range(0, len(words), 997):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == table.merged(words[k])
    assert mb < 60, mb
