from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from cohortlens.llm import rans, tokens
from cohortlens.llm.shared import new_path
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    t = Tokenizer.from_file(PATH)
    ids = [t.encode(x or "", add_special_tokens=False).ids + [2] for _, x in rows]
    return [(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, _), i in zip(rows, ids)]


def test_files_give_back_all_documents(spark, frame, prose, monkeypatch):
    rows = [(i, prose(n)) for i, n in enumerate([3, 70, 0, 500, 9000, 1, 12])] + [(50, "It's A test,NBSP here x İSTANBUL ΣΑΣ é <|endoftext|>z\x1f q"), (51, None), (52, "x" * 3000)]
    monkeypatch.setattr(rans, "BLOCK_IDS", 4096)
    path = new_path(spark, "tokens")
    tokens.write_tokens(frame(rows), path, PATH)
    got = sorted(tokens.document_checksums(spark, path).collect())
    want, start = [], 0
    for d, n, crc in expected(sorted(rows)):
        want.append((d, start, n, crc))
        start += n
    assert [tuple(r) for r in got] == want
    ids = {r.doc_id: r.ids for r in tokens.token_ids(spark, path).collect()}
    assert ids[51] == [2] and ids[1] == Tokenizer.from_file(PATH).encode(rows[1][1], add_special_tokens=False).ids + [2]


def test_odd_rows_and_empty_table(spark, frame, odd):
    path = new_path(spark, "tokens")
    tokens.write_tokens(frame(odd), path, PATH)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.document_checksums(spark, path).collect()), key=str)
    assert got == sorted(expected(odd), key=str)
    path = new_path(spark, "tokens")
    tokens.write_tokens(frame(odd).limit(0), path, PATH)
    assert tokens.document_checksums(spark, path).count() == 0


def test_blocks_round_trip_from_checkpoints_and_find_damage():
    rng = np.random.default_rng(3)
    ids = np.minimum((rng.pareto(0.7, 150_000) * 4).astype(np.int64), 40_000)
    table = rans.Table.of(*np.unique(ids, return_counts=True))
    assert table.freq.sum() == 1 << rans.SCALE_BITS
    blocks = [ids[:65_536], ids[65_536:140_000], ids[:1], ids[:0], ids[:129]]
    coded = rans.encode(blocks, table)
    assert all((a == b).all() for a, b in zip(blocks, rans.decode(coded, table)))
    step = coded[0]["point_steps"][0]
    assert (rans.decode(coded[:1], table, step)[0] == blocks[0][step * rans.LANES :]).all()
    hurt = dict(coded[0], words=b"\x00" + coded[0]["words"][1:])
    with pytest.raises(ValueError):
        rans.decode([hurt], table)
    only = rans.Table.of(np.array([7]), np.array([5]))
    assert (rans.decode(rans.encode([np.full(1000, 7)], only), only)[0] == 7).all()


def test_crc_of_joined_parts():
    a, b = b"some bytes", b"and more of them" * 9
    assert tokens.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
