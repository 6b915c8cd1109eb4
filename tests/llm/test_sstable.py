import io
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import sstable
from tessera.llm.encoding import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(text, path=PATH):
    t = Tokenizer.from_file(path)
    return t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_whole_encoding():
    odd = ["", " ", " a", "a\tb \t c", "x\n\n y  z \n", "it's 'tis don't 123 45,6 e\u0301 Σας ΣΑΣ \u0301x <|endoftext|> 日本 語", "word.more,and###end", "a \n", "\u00a0a\u00a0b ", "ends.", "re're 'll", "\u200d a"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        few = Encoder(path, most=3)  # forgets all the time
        for text in odd * 2:
            assert np.frombuffer(few(text), "<u4").tolist() == whole(text, path), text


def test_round_trip(spark, documents):
    manifest = sstable.write_shards(documents, PATH, 2, shard_bytes=200)
    got = sstable.read_shards(manifest).orderBy("start").collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, whole(r.text) + [2]) for r in documents.collect()), key=lambda r: r[:2])
    assert [r.doc_id for r in got] == [i if known else None for known, i, _ in rows]
    assert sorted(r.n_tokens for r in got) == sorted(len(x) for _, _, x in rows)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    by_id = {r.doc_id: r for r in got}
    for known, i, ids in rows:
        if known and i not in (0, 6):
            assert (by_id[i].n_tokens, by_id[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert sstable.lookup(manifest, 7)[0].tolist() == whole(documents.where("doc_id = 7").first().text) + [2]
    assert len(sstable.lookup(manifest, 0)) == 2 and sstable.lookup(manifest, 999) == []


def test_empty(spark, nothing):
    assert sstable.read_shards(sstable.write_shards(nothing, PATH, 2)).count() == 0


def test_shard_lookup_and_damage():
    sink = io.BytesIO()
    sink_close, sink.close = sink.close, lambda: None
    w = sstable.ShardWriter(sink, 2, block_bytes=64)
    ids = [-5, 0, 3, 3, 3, 7, 1 << 40]
    for n, i in enumerate(ids):
        w.add(sstable.key_of(i), np.arange(n + 5))
    w.close()
    shard = sstable.Shard(io.BytesIO(sink.getvalue()))
    assert [i for i, _ in shard.scan()] == ids and shard.n_docs == 7
    assert [len(x) for x in shard.get(3)] == [7, 8, 9] and len(shard.get(1 << 40)) == 1 and shard.get(4) == []
    assert sum(bool(all(shard.bloom[p >> 3] >> (p & 7) & 1 for p in sstable._probes(sstable.key_of(i), shard.hashes, shard.bits))) for i in range(1000, 2000)) < 100
    bad = bytearray(sink.getvalue())
    bad[-80] ^= 255
    try:
        sstable.Shard(io.BytesIO(bytes(bad)))
        raise AssertionError
    except ValueError:
        pass
    sink_close()


def test_added_tokens_are_encoded_as_the_library_does():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        added = [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]
        for text in [*added, *(f"a {t} b{t}c" for t in added), "plain text"]:
            assert list(Encoder(path)(text)) == list(np.array(whole(text, path), np.uint32).tobytes()), (name, text)
