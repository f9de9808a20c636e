import re

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import text
from lodestone.llm.encoder import Encoder


@pytest.mark.parametrize("most", [1, 7, 40, 10**9])
def test_slices_hold_all_rows(rows, most):
    texts = [r[1] for r in rows] + ["É" * 9 + " Ünd", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["i", "text"])
    seen, words = [], []
    for part in text.slices(batch.slice(1), "text", most):
        seen += part.column("i").to_pylist()
        found, bounds = text.split_words(text.strings(part.column("text")))
        ids = text.word_ids(found)
        assert len(ids) == len(found) == bounds[-1]
        words += [found.slice(a, b - a).to_pylist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert seen == list(range(1, len(texts)))
    assert words == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts[1:]]


def test_slices_encode_like_wholes(rows):
    import public_tokenizers

    texts = [r[1] for r in rows] + ["É" * 9 + " Ünd"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for name, keeps in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        whole = Encoder(public_tokenizers.path(name), keeps, 0).encode(text.strings(batch.column("text")))[0]
        coder = Encoder(public_tokenizers.path(name), keeps, 0)
        parts = [coder.encode(text.strings(p.column("text")))[0] for p in text.slices(batch, "text", 50)]
        assert np.array_equal(whole, np.concatenate(parts))
