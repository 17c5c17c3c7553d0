"""Token ids of documents in compressed, checksummed files.

Documents go into files in the order of doc_id: file 0 has the smallest, and ids are counted through all files. A file
is cut into blocks of ids, whatever documents they belong to. Each block is coded from a fresh state by an adaptive
range coder that mixes predictions of order 0 to 2 (``rangecoder``), so any block can be read alone, and bears a
checksum of its ids. Blocks are rows of a Parquet table: Spark commits them whole or not at all, and any store that
Spark reads can hold them.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rangecoder
from .common import slices, written

#: Ids of a block, and blocks that are coded side by side.
BLOCK, SIDE = rangecoder.MOST, 96
#: Head of a block: what it is, number of ids, CRC-32 of the ids as little-endian unsigned 32-bit values.
HEAD, KIND = "<4sII", b"IDS2"
#: Pieces of text, and their ids, that an encoder remembers.
MOST_PIECES, MOST_IDS = 500_000, 5_000_000

#: What a byte can be: white space, white space but a space, punctuation that special tokens don't have, an ASCII letter, a visible
#: ASCII character, the first byte of U+00C0 to U+07FF, a byte beyond ASCII, one of a letter in ASCII or from U+00C0 to U+017F.
BLANK, BREAK, STOP, LETTER, VISIBLE, LEAD, TAIL, WORD = (1 << k for k in range(8))
KINDS = np.zeros(256, np.uint8)
for _bytes, _kind in (
    (b" \t\n\r", BLANK), (b"\t\n\r", BREAK), (b".,;:!?#$%&*+()[]{}=/@~^", STOP), ([*range(0x41, 0x5B), *range(0x61, 0x7B)], LETTER | WORD),
    (range(0x21, 0x7F), VISIBLE), (range(0xC3, 0xE0), LEAD), (range(0x80, 0x100), TAIL), ({*range(0x80, 0xC0), 0xC3, 0xC4, 0xC5} - {0x97, 0xB7}, WORD),  # those of signs
):
    KINDS[list(_bytes)] |= np.uint8(_kind)
#: The character that byte-level vocabularies write for each byte, and what they write for a line end.
_WRITTEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
CHARACTER = np.zeros(256, "<u4")
CHARACTER[_WRITTEN] = _WRITTEN
CHARACTER[[b for b in range(256) if b not in _WRITTEN]] = np.arange(0x100, 0x200 - len(_WRITTEN))
LINE_END = chr(CHARACTER[10])

FILE_SCHEMA = "file int, block long, n_ids int, number long, place long, doc_ids array<long>, doc_tokens array<long>, payload binary"
PIECE_SCHEMA = "file int, number long, doc_id long, place long, n_tokens long, start long, length long, crc_share long, ids binary"


class Encoder:
    """Ids of a byte-level BPE tokenizer whose tokens never reach across the start of white space, or from a letter to punctuation.

    So a text is cut before each blank or line end that follows a visible character, after such a line end that a visible
    character follows, and before punctuation that follows a letter up to U+017F, and each distinct piece is tokenized once. White
    space after other white space isn't cut at, nor such beside a character beyond U+07FF, which might be white space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer(self.tokenizer.model)  # takes words of letters, as the vocabulary writes them, a line each
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each token
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(LINE_END)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = defaultdict(count().__next__)
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """Number of each of the distinct pieces; new ones are tokenized."""
        if len(self.known) > MOST_PIECES or len(self.flat) > MOST_IDS:
            self.clear()
        before = len(self.known)
        pieces = pieces.cast(pa.binary())
        number = np.fromiter(map(self.known.__getitem__, pieces.to_numpy(zero_copy_only=False)), np.int64, len(pieces))
        fresh = number >= before  # in the order of their numbers
        if fresh.any():
            pieces = pieces.filter(pa.array(fresh))
            offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
            data = np.frombuffer(pieces.buffers()[2], np.uint8)[: offsets[-1]]
            letter = KINDS[data] & WORD > 0
            letter[offsets[:-1]] |= data[offsets[:-1]] == 0x20
            others = np.append(0, np.cumsum(~letter))
            word = (others[offsets[1:]] == others[offsets[:-1]]) & (data[offsets[1:] - 1] != 0x20)
            lengths, flats = np.zeros(len(pieces), np.int32), []
            raw = pieces.to_numpy(zero_copy_only=False)
            for of_letters, ids_of, most in ((True, self._of_words, 50_000), (False, self._of_others, 4000)):  # the tokenizer's results are many times larger than their ids
                some, counts = raw[word == of_letters], [np.zeros(0, np.int64)]
                for k in range(0, len(some), most):
                    flat, n = ids_of(some[k : k + most].tolist())
                    flats.append(flat)
                    counts.append(n)
                lengths[word == of_letters] = np.concatenate(counts)
            order = np.argsort(~word, kind="stable")
            starts = np.empty(len(pieces), np.int64)
            starts[order] = len(self.flat) + np.cumsum(lengths[order]) - lengths[order]
            self.flat, self.starts, self.lengths = np.concatenate([self.flat, *flats]), np.append(self.starts, starts), np.append(self.lengths, lengths)
        return number

    def _of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, and how many each has."""
        lines = CHARACTER[np.frombuffer(b"\n".join(words), np.uint8)].tobytes().decode("utf-32-le").split(LINE_END)
        found = self.words.encode_batch_fast([LINE_END.join(lines[k : k + 500]) for k in range(0, len(lines), 500)], add_special_tokens=False)
        flat = np.array([i for x in found for i in x.ids], np.uint16)
        ends, until = np.cumsum(list(map(len, words))), np.cumsum(self.sizes[flat])
        at = np.searchsorted(until, ends)
        assert (until[at] == ends).all()
        return flat, np.diff(at, prepend=-1)

    def _of_others(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast([x.decode() for x in pieces], add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint16), np.fromiter(map(len, found), np.int64, len(found))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "").cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or offsets[0] == offsets[-1]:
            return np.zeros(0, np.uint16), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kinds = KINDS[data]
        now, before, second = kinds[1:], kinds[:-1], np.append(np.uint8(0), kinds[:-2])
        blank = (now & BLANK > 0) & ((before & VISIBLE > 0) | (before & TAIL > 0) & (second & LEAD > 0))
        letter = (before & LETTER > 0) | (before & (LEAD | TAIL | WORD) == TAIL | WORD) & (second & (LEAD | WORD) == LEAD | WORD)
        cut = np.append(True, blank | (now & STOP > 0) & letter)
        cut[2:] |= blank[:-1] & (before[1:] & BREAK > 0) & (now[1:] & (VISIBLE | LEAD) > 0)
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        begins = np.flatnonzero(cut)
        pieces = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(data)).astype(np.int32)), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        number = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        lengths = self.lengths[number]
        ends = np.cumsum(lengths, dtype=np.int64)
        places = np.arange(ends[-1], dtype=np.int64)
        places += np.repeat(self.starts[number] - (ends - lengths), lengths)
        until = np.append(0, ends)[np.searchsorted(begins, offsets)]
        return self.flat[places], np.diff(until)


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One for all tasks that a Python worker runs, so that each finds what earlier ones have tokenized."""
    return Encoder(path)


def _zero_bytes() -> list[np.ndarray]:
    """For each k: what 2^k zero bytes after it do to each bit of a CRC-32 (in the reflected form)."""
    square = lambda m: np.array([np.bitwise_xor.reduce(m[[j for j in range(32) if int(x) >> j & 1]]) for x in m], np.uint32)
    power = np.array([0xEDB88320] + [1 << j for j in range(31)], np.uint32)
    for _ in range(3):
        power = square(power)
    out = [power]
    for _ in range(47):
        out.append(square(out[-1]))
    return out


ZERO_BYTES = _zero_bytes()


def crc_followed_by(crcs: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What each CRC-32 adds (by exclusive or) to the CRC-32 of a whole that goes on for so many bytes."""
    out, after = crcs.astype(np.uint32), after.astype(np.int64)
    for k, bits in enumerate(ZERO_BYTES):
        those = np.flatnonzero(after >> k & 1)
        if len(those):
            old, moved = out[those], np.zeros(len(those), np.uint32)
            for j in range(32):
                moved ^= np.where(old >> np.uint32(j) & np.uint32(1), bits[j], np.uint32(0))
            out[those] = moved
    return out


def _spans(starts: np.ndarray, ends: np.ndarray, first: int, blocks: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The first document of each block, and the one after its last; documents are in a row and not empty."""
    begin = first + BLOCK * np.arange(blocks)
    return np.searchsorted(ends, begin, side="right"), np.searchsorted(starts, np.minimum(begin + BLOCK, total), side="left")


def write(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """The files of ``docs`` (doc_id, text), as a table in the shared folder: a row per block, in the order of (file, block).

    tokenizer: path of a byte-level BPE file of at most 65,535 ids that all executors can read; ``end_id`` ends each document.
    A block row has its number of ids, the number (in the file) and the place (ids of the file before it) of its first
    document, doc_ids and doc_tokens of all documents with an id in it, and the payload (head and code).
    Null and empty texts are the end id alone. Rows that repeat a doc_id, or have none (those come first), are documents
    of their own, in any order among themselves; a file may end between them, so a frequent id is spread like any others.
    A text of any length is cut into blocks. An empty table gives no rows. Columns other than doc_id and text aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = encoder_of(tokenizer), TaskContext.get().partitionId()
        ids, first = np.zeros(0, np.uint16), 0  # ids that wait, and the ids of the file before them
        doc_ids, starts, tokens, number = np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0, np.int64), 0  # documents that have some of them, and the first one's number

        def rows(last: bool) -> pa.RecordBatch:
            nonlocal ids, first, doc_ids, starts, tokens, number
            blocks = -(-len(ids) // BLOCK) if last else len(ids) // BLOCK
            lengths = np.minimum(BLOCK, len(ids) - BLOCK * np.arange(blocks))
            codes = [x for k in range(0, blocks, SIDE) for x in rangecoder.encode(ids[k * BLOCK : (k + SIDE) * BLOCK], lengths[k : k + SIDE])]
            raw = ids.astype("<u4")
            heads = [struct.pack(HEAD, KIND, n, zlib.crc32(raw[k * BLOCK : k * BLOCK + n])) for k, n in enumerate(lengths.tolist())]
            low, high = _spans(starts, starts + tokens, first, blocks, first + int(lengths.sum()))
            some = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
            bounds = pa.array(np.append(0, np.cumsum(high - low)), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x[some], pa.int64())) for x in (doc_ids, tokens)]
            out = [pa.array(np.full(blocks, file), pa.int32()), pa.array(first // BLOCK + np.arange(blocks)), pa.array(lengths, pa.int32()), pa.array(number + low), pa.array(starts[low]), *lists, pa.array([a + b for a, b in zip(heads, codes, strict=True)], pa.binary())]
            first += int(lengths.sum())
            ids = ids[lengths.sum() :]
            gone = int(np.searchsorted(starts + tokens, first, side="right"))
            doc_ids, starts, tokens, number = doc_ids[gone:], starts[gone:], tokens[gone:], number + gone
            return pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in FILE_SCHEMA.split(", ")])

        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                found, counts = encoder.encode(part["text"])
                ends = np.cumsum(counts + 1)
                whole = np.full(int(ends[-1]), end_id, np.uint16)
                own = np.ones(len(whole), bool)
                own[ends - 1] = False
                whole[own] = found
                starts = np.append(starts, first + len(ids) + ends - (counts + 1))
                tokens, doc_ids = np.append(tokens, counts + 1), np.append(doc_ids, np.array(part["doc_id"].to_pylist(), object))
                ids = np.append(ids, whole)
                if len(ids) >= BLOCK * SIDE:
                    yield rows(last=False)
        if len(ids):
            yield rows(last=True)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    table = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    ordered = table.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    return written(ordered.mapInArrow(run, FILE_SCHEMA))


def read(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """The ids in the files: one row for each document and block that has some of its ids.

    file and number name the document; doc_id, place (ids of its file before it) and n_tokens are the document's; start
    (ids of it before these), length, crc_share and ids (little-endian unsigned 32-bit values) are the row's. The
    exclusive or of a document's crc_shares is the CRC-32 of all its ids. A block whose checksum fails is an error.
    No rows give no rows; the order of rows and repeated reads don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SIDE):
                yield pieces(batch.slice(at, SIDE))

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        payloads, lengths = batch["payload"].to_pylist(), batch["n_ids"].to_numpy().astype(np.int64)
        heads = [struct.unpack_from(HEAD, x) for x in payloads]
        if any(kind != KIND or n != m for (kind, n, _), m in zip(heads, lengths.tolist(), strict=True)):
            raise ValueError("not a block of token ids")
        flat = rangecoder.decode([x[struct.calcsize(HEAD) :] for x in payloads], lengths).astype("<u4")
        begins = np.cumsum(lengths) - lengths
        for (_, n, crc), a in zip(heads, begins.tolist(), strict=True):
            if zlib.crc32(flat[a : a + n]) != crc:
                raise ValueError("a block of token ids is damaged")
        many = pc.list_value_length(batch["doc_ids"]).to_numpy().astype(np.int64)
        block = np.repeat(np.arange(len(many)), many)
        rank = np.arange(len(block)) - np.repeat(np.cumsum(many) - many, many)
        tokens = batch["doc_tokens"].flatten().to_numpy().astype(np.int64)
        until = np.cumsum(tokens) - tokens
        place = batch["place"].to_numpy()[block] + until - np.repeat(until[np.cumsum(many) - many], many)  # the next document begins where one ends
        opening = batch["block"].to_numpy()[block] * BLOCK
        from_, to = np.maximum(place, opening), np.minimum(place + tokens, opening + lengths[block])
        a = begins[block] + from_ - opening
        parts = [flat[i:j] for i, j in zip(a.tolist(), (a + to - from_).tolist(), strict=True)]
        shares = crc_followed_by(np.array([zlib.crc32(x) for x in parts], np.uint32), 4 * (place + tokens - to))
        columns = [pa.array(batch["file"].to_numpy()[block], pa.int32()), pa.array(batch["number"].to_numpy()[block] + rank), batch["doc_ids"].flatten(), pa.array(place), pa.array(tokens), pa.array(from_ - place), pa.array(to - from_), pa.array(shares.astype(np.int64)), pa.array([x.tobytes() for x in parts] if with_ids else [None] * len(parts), pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PIECE_SCHEMA.split(", ")])

    return files.select(*(x.split()[0] for x in FILE_SCHEMA.split(", "))).mapInArrow(run, PIECE_SCHEMA)


def summary(files: DataFrame) -> DataFrame:
    """Of each document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from its decoded ids."""
    docs = read(files, with_ids=False).groupBy("file", "number").agg(F.first("doc_id").alias("doc_id"), F.first("place").alias("place"), F.first("n_tokens").alias("n_tokens"), F.sum("length").alias("found"), F.bit_xor("crc_share").alias("ids_crc32"))
    sizes = files.groupBy("file").agg(F.sum("n_ids").alias("size"))  # a row per file
    starts = sizes.select("file", (F.sum("size").over(Window.orderBy("file")) - F.col("size")).alias("file_start"))
    whole = F.when(F.col("found") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document's blocks are missing")).cast("long"))
    return docs.join(starts, "file").select("doc_id", (F.col("file_start") + F.col("place")).alias("start"), whole.alias("n_tokens"), "ids_crc32")
