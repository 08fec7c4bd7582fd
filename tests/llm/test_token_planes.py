import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import documents, none, rows
from veritab.llm import token_planes as tp

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("mode", ["byte", "bit"])
@pytest.mark.parametrize("block", [8, 1000])
def test_round_trip_of_files(mode, block):
    rng = np.random.default_rng(1)
    docs = [(k if k != 3 else None, rng.integers(0, [2, 300, 70_000, 1 << 31][k % 4], rng.integers(0, 40), dtype=np.uint32)) for k in range(30)]
    out = io.BytesIO()
    w = tp.PlaneWriter(out, mode, block)
    for d in docs:
        w.add(*d)
    w.close()
    got = list(tp.PlaneReader(io.BytesIO(out.getvalue()), len(out.getvalue())).documents())
    at = 0
    for (doc, ids), (doc2, start, ids2) in zip(docs, got, strict=True):
        assert doc == doc2 and start == at and np.array_equal(ids, ids2)
        at += len(ids)
    with pytest.raises(ValueError):
        tp.PlaneReader(io.BytesIO(out.getvalue()[:-1]), len(out.getvalue()) - 1)


def test_pieces_encode_as_whole_texts():
    t = Tokenizer.from_file(PATH)
    enc = tp.PieceEncoder(PATH, most=6)  # forgets all the time
    texts = ["a b  c", " lead", "trail ", "x\ny z", "it's 12 o'clock###", "", "<|endoftext|> hi", "é b c", "same same same", "###\n\n a", "tab\tb c", "日本 語", "a\u00a0b c", "a \u00a0b", "x\u3000 y z", "em \u2014 dash", "\u2003 a", "a\x1f b \x1f c", "é ", " é", "  ", "a b  "] * 2
    for some in (texts[:5], texts[5:], texts, *([t] for t in texts)):
        assert [list(x) for x in enc.encode(some)] == [e.ids for e in t.encode_batch(some, add_special_tokens=False)]


def test_against_the_library(spark):
    t = Tokenizer.from_file(PATH)
    got = sorted(((r.doc_id is None, r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tp.token_planes(documents(spark), block=64).collect()), key=lambda r: (r[0], r[2]))
    ids = sorted((d is None, d or 0, tuple([*t.encode(x or "", add_special_tokens=False).ids, 0])) for d, x, *_ in rows())
    assert sorted((r[0], r[1] or 0, r[3], r[4]) for r in got) == sorted((n, d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for n, d, i in ids)
    starts = [r[2] for r in got]
    assert starts == [0, *np.cumsum([r[3] for r in got])[:-1].tolist()]
    assert [r[1] for r in got if not r[0]] == sorted(r[1] for r in got if not r[0])
    assert tp.token_planes(none(spark)).count() == 0
