"""What a Python worker still holds when its task is over."""

import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

SCRIPT = """
import re
import pyarrow as pa
from assayer.llm.words import text_chunks

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    for _ in range(4):
        texts = [b"%d " % i * 150 for i in range(20_000)]
        yield pa.RecordBatch.from_arrays([pa.array(range(20_000)), pa.array(texts).cast(pa.string())], names=["doc_id", "text"])

before, kept, seen = held(), [], 0
for ids, texts in text_chunks(batches()):
    seen += len(texts)
    kept.append([bytes(t[:600]) for t in texts[::500]])
assert seen == 80_000, seen
print(held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_texts_are_given_back():
    out = subprocess.run([sys.executable, "-c", SCRIPT], env=os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[2])}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert re.fullmatch(r"[\d.-]+", out.stdout.strip())
    assert float(out.stdout) < 70
