import random
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers

from tessera.llm.encoding import Encoder
from tessera.llm.packing import Limits, Packer, pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_limits_hold_and_nothing_is_lost():
    rng = random.Random(1)
    limits = Limits(tokens=64, segments=6, loss=40, pool=16)
    examples = [SimpleNamespace(n=n, loss_from=rng.randint(0, n)) for n in (rng.choice([1, 2, 5, 30, 63, 64, 65, 200]) for _ in range(400))]
    packer, got = Packer(limits), []
    for x in examples:
        got += packer.add(x)
    got += packer.end()
    seen = {id(x): [] for x in examples}
    for seq in got:
        assert sum(p[2] for p in seq) <= 64 and len(seq) <= 6 and sum(p[3] for p in seq) <= 40
        for x, start, length, loss in seq:
            assert length > 0 and loss == max(0, start + length - max(start, x.loss_from))
            seen[id(x)].append((start, length))
    for x in examples:
        at = 0
        for start, length in sorted(seen[id(x)]):
            assert start == at
            at += length
        assert at == x.n


def test_documents(spark, documents):
    rows = pack_documents(documents, PATH, 1, Limits(2048, 256, 2048)).collect()
    encode = Encoder(PATH)
    want = sorted(len(encode(r.text)) // 4 + 1 for r in documents.collect())
    assert sorted(r.doc_tokens for r in rows if r.start == 0) == want
    assert sum(r.length for r in rows) == sum(want)
    ids = {r.doc_id: np.frombuffer(encode(r.text) + np.array([1], "<u4").tobytes(), "<u4") for r in documents.collect() if r.doc_id not in (0, 6, None)}
    for r in rows:
        if r.doc_id in ids:
            assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and all(r.padded_length == (at if at & (at - 1) == 0 else 2048) for r in pieces)


def test_empty(nothing):
    assert pack_documents(nothing, PATH, 1).count() == 0


def test_pieces_are_worked_out_when_asked_for():
    """Every text's pieces were first compared with the known ones, then looked up; now a lookup alone fills in what is new."""
    from tessera.llm.encoding import _Known

    asked = []
    known = _Known(lambda piece: asked.append(piece) or piece.encode())
    assert b"".join(map(known.__getitem__, ["a", " b", "a", "x" * 65, "x" * 65])) == b"a ba" + b"x" * 130
    assert asked == ["a", " b", "x" * 65, "x" * 65] and set(known) == {"a", " b"}
