"""The packing query over a whole table against the tokenizer."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from compare import DATA

from tidemark.llm import queries as llm


def test_every_id_lies_in_one_piece(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in llm.op1_packing(spark, DATA).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for found, ends in ((pieces, {d: len(x) for d, x in ids.items()}), (sequences, None)):
        for name, spans in found.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at and length > 0
                at += length
            assert at == ends[name] if ends else at == 2048 or at & at - 1 == 0
    assert set(pieces) == set(ids)
