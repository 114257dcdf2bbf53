"""What the Python workers of an executor hold, which counts with the executor."""

import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa

from mailquarry.llm import arrays, neardup, tokens
from mailquarry.llm.queries import TOKENIZER


def test_operators_of_the_pipeline_do_not_load_pandas_in_workers():
    code = "import sys; import mailquarry.llm.langid, mailquarry.llm.neardup, mailquarry.llm.decontaminate, mailquarry.llm.packing; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0


def test_sketches_of_many_texts_take_little_memory():
    rng = np.random.default_rng(1)
    element = rng.integers(1, 1 << 62, neardup.SKETCH_ROWS * 150).astype(np.uint64)
    owner = np.repeat(np.arange(neardup.SKETCH_ROWS), 150)
    tracemalloc.start()
    neardup.signatures(owner, element, np.ones(len(element)), neardup.SKETCH_ROWS, neardup.SKETCH)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20


def test_signing_short_texts_takes_little_memory():
    texts = [" ".join(f"w{(7 * i + 3 * j) % 5000}" for j in range(150)) for i in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tracemalloc.start()
    for part in arrays.slices(batch, limit=getattr(neardup, "SLICE", arrays.SLICE_BYTES)):
        owner, element, count = neardup.shingles(*arrays.utf8(arrays.text_column(part)))
        neardup.bands(neardup.signatures(owner, element, neardup.weights(count, False), part.num_rows))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20


def test_the_encoder_table_is_small_and_leaves_with_the_operator(monkeypatch):
    arrays.forget()
    encoder = tokens.encoder(TOKENIZER)
    assert encoder is tokens.encoder(TOKENIZER)
    assert encoder.keys.nbytes + encoder.slots.nbytes <= 13 << 20
    texts = ["a b c " * 50, "", "x\n\n y's 12 " * 40, "the end"]
    whole, borders = encoder.encode(texts)
    monkeypatch.setattr(tokens, "RANGE_WORDS", 7)                # texts over many ranges
    parts, cut = tokens.Encoder(TOKENIZER).encode(texts)
    assert parts.tolist() == whole.tolist() and cut.tolist() == borders.tolist()
    arrays.forget()
    assert tokens.encoder(TOKENIZER) is not encoder
