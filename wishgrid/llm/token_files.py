"""Token ids in files of bit or byte planes."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wishgrid.llm.common import send_package, shared_path

END_ID = 2
#: Ids in a block that is transposed at once; ids after which a chunk is closed (with the document that fills it).
BLOCK, CHUNK = 1 << 16, 1 << 18
#: Encoded pieces that a worker remembers.
REMEMBERED = 500_000

CHUNKS = (
    "part int, chunk int, start long, n_ids long, plane_bits int, block int, "
    "doc_ids array<long>, doc_lengths array<long>, plane_bytes array<int>, payload binary"
)
#: The first character behind the Latin letters.
LATIN_END = "\u0250"
#: Byte-level units: printable bytes stand for themselves, the others in order for the characters from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_UNITS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
SPACE_UNIT = chr(BYTE_UNITS[32])
LATIN_UNITS = {c: c.encode().decode("latin-1").translate(BYTE_UNITS) for c in map(chr, range(ord(LATIN_END)))}

_PAIRS = ("  ", "\n\n", " \n", "\n ", "\x00")
_ASCII_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_OTHER_SPACE = re.compile(r"[^\S \n]")
assert array("I").itemsize == 4
_tokenizers: dict[str, object] = {}
_pieces: dict[str, list[dict[str, bytes]]] = {}
_widths: dict[str, np.ndarray] = {}
_packed: dict[str, list[bytes]] = {}
_TAILS = (",", ".")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _odd(text: str) -> bool:
    """Has white space other than single spaces and line breaks."""
    if any(p in text for p in _PAIRS):
        return True
    return any(c in text for c in _ASCII_SPACE) if text.isascii() else bool(_OTHER_SPACE.search(text))


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text, as little-endian unsigned 32-bit integers.

    A byte-level BPE never joins what stands before a space or on either side of a line break, nor a letter with the
    comma or full stop behind it. Where white space is single spaces and line breaks, the pieces between are encoded
    once and remembered, the last REMEMBERED of them and those that were used since. New words of Latin letters, each one
    unit of the pre-tokenizer, go to the model itself, with a comma or full stop behind them set off; other new words are
    encoded as one text.
    Any other text, and texts with a special token, are encoded whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    if path not in _tokenizers:
        _tokenizers[path], _pieces[path] = Tokenizer.from_file(path), [{}, {}]
        vocabulary = _tokenizers[path].get_vocab()
        _widths[path] = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        _packed[path] = [array("I", [n]).tobytes() for n in range(len(_widths[path]))]
        for token, number in vocabulary.items():
            _widths[path][number] = len(token)  # byte-level: a character of the vocabulary stands for a byte
    tokenizer, (known, older) = _tokenizers[path], _pieces[path]
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def ids(some: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    model = tokenizer.model
    direct = isinstance(tokenizer.pre_tokenizer, ByteLevel) and tokenizer.normalizer is None

    def joined(pieces: list[str]) -> list[bytes]:
        """Ids of pieces that start with a space and a word, encoded as one text and cut by the bytes of its tokens."""
        if not pieces:
            return []
        found = np.array(tokenizer.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum([len(p.encode()) for p in pieces])
        reached = np.cumsum(_widths[path][found])
        cuts = np.searchsorted(reached, ends)
        if len(reached) == 0 or reached[-1] != ends[-1] or not np.array_equal(reached[cuts], ends):
            return ids(pieces)
        flat, cuts = found.tobytes(), [0, *(4 * cuts + 4).tolist()]
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    out: list[bytes] = []
    split: dict[int, list[str]] = {}
    for k, text in enumerate(texts):
        if _odd(text) or any(s in text for s in special):
            out += ids([text])
            continue
        split[k] = text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")
        out.append(b"")
    if any(split.values()):
        known.update(zip(",.", ids([",", "."]), strict=True))
    tokenize, packed, rest = model.tokenize, _packed[path], []
    for p in set().union(*split.values()).difference(known):
        own = older.get(p)
        if own is None:
            stem, tail = (p[:-1], p[-1]) if p[-1:] in _TAILS else (p, "")
            space = stem[:1] == " "
            body = stem[1:] if space else stem
            plain = body.isascii()
            if not (direct and body.isalpha() and (plain or max(body) < LATIN_END)):
                rest.append(p)
                continue
            own = (known.get(stem) or older.get(stem)) if tail else None
            if own is None:
                units = body if plain else "".join([LATIN_UNITS[c] for c in body])
                own = b"".join([packed[t.id] for t in tokenize(SPACE_UNIT + units if space else units)])
                if tail:
                    known[stem] = own
            if tail:
                own += known[tail]
        known[p] = own
    words = [p for p in rest if p[:1] == " " and len(p) > 1]
    known.update(zip(words, joined(words), strict=True))
    others = [p for p in rest if p not in known]
    known.update(zip(others, ids(others), strict=True))
    for k, pieces in split.items():
        out[k] = b"".join(map(known.__getitem__, pieces))
    if len(known) > REMEMBERED:
        _pieces[path] = [{}, known]
    return out


def to_planes(ids: np.ndarray, plane_bits: int) -> list[bytes]:
    """One block of ids as compressed planes, from the lowest: all bits (or bytes) of equal weight side by side."""
    if plane_bits == 8:
        octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        planes = np.ascontiguousarray(octets.T)
    else:
        bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    press = zstandard.ZstdCompressor(level=3)
    return [press.compress(p.tobytes()) if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, plane_bits: int) -> np.ndarray:
    """The inverse of ``to_planes`` for ``n`` ids; an empty plane is all zeros."""
    undo, width = zstandard.ZstdDecompressor(), n if plane_bits == 8 else (n + 7) // 8
    rows = np.zeros((len(planes), width), np.uint8)
    for k, p in enumerate(planes):
        if p:
            rows[k] = np.frombuffer(undo.decompress(p), np.uint8)
    if plane_bits == 8:
        return np.ascontiguousarray(rows.T).view("<u4").ravel()
    bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").ravel()


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, plane_bits: int = 8, chunk: int = CHUNK
) -> None:
    """documents(doc_id, text) -> files in ``path``; an end id closes every document; null texts are empty.

    Documents are dealt by ranges of doc_id (nulls first; rows of one id by hash of their text, then by text, so equal
    rows are alike, and the bounds sampled for the ranges hold two numbers a row, never texts). Each task writes its
    range in order as rows of ``CHUNKS``: whole documents up to about ``chunk`` ids, their ids and lengths, where the
    chunk starts in its part, and the payload of planes of ``BLOCK`` ids with the byte length of each plane as index.
    Parquet holds the chunks, so Spark's commit covers lost tasks and any store will do.
    A task holds one batch of texts and one chunk; a chunk holds more ids only if one document does, and a very long text
    takes about 100 bytes a word while it is encoded. Other columns take no part; no rows give no files but Spark's own.
    Ids must be whole numbers: any other type is an error, since the files hold them as 64-bit numbers.
    """
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long", "void"):
        raise ValueError("doc_id must be a whole number")
    send_package(docs.sparkSession)
    model = tokenizer or default_tokenizer()
    planes = {1: 32, 8: 4}[plane_bits]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        names: list[int | None] = []
        held = 0
        end = np.array([end_id], "<u4").tobytes()

        def closed() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(ids), "<u4")
            packed = [p for k in range(0, len(flat), BLOCK) for p in to_planes(flat[k : k + BLOCK], plane_bits)]
            assert len(packed) == planes * -(-len(flat) // BLOCK)
            row = [part, number, start, len(flat), plane_bits, BLOCK, names, [len(x) // 4 for x in ids], [len(p) for p in packed], b"".join(packed)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], [c.split()[0] for c in CHUNKS.split(", ")])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                texts = [t or "" for t in some.column(1).to_pylist()]
                for name, own in zip(some.column(0).to_pylist(), encode(texts, model), strict=True):
                    ids.append(own + end)
                    names.append(name)
                    held += len(ids[-1]) // 4
                    if held >= chunk:
                        yield closed()
                        number, start, held, ids, names = number + 1, start + held, 0, [], []
        if ids:
            yield closed()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    dealt = keyed.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key", "text")
    dealt.select("doc_id", "text").mapInArrow(encoded, CHUNKS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Files of ``write_tokens`` -> doc_id, start, n_tokens, ids_crc32 (and ids), read chunk by chunk.

    ``start`` counts the ids of all documents before it: those of earlier parts (a sum per part, read from the index
    columns; as many rows as the writer had tasks) and of earlier chunks of its part.
    """
    send_package(spark)
    chunks = spark.read.schema(CHUNKS).parquet(path)
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = chunks.join(F.broadcast(bases), "part").select(
        (F.col("base") + F.col("start")).alias("start"), "plane_bits", "block", "doc_ids", "doc_lengths", "plane_bytes", "payload"
    )

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                c = {k: v[0] for k, v in batch.slice(row, 1).to_pydict().items()}
                flat = unpacked(c["payload"], c["plane_bytes"], sum(c["doc_lengths"]), c["plane_bits"], c["block"])
                ends = np.cumsum(np.array(c["doc_lengths"], np.int64))
                own = np.split(flat.astype("<u4"), ends[:-1])
                columns = [
                    pa.array(c["doc_ids"], pa.int64()),
                    pa.array(c["start"] + ends - np.array(c["doc_lengths"], np.int64)),
                    pa.array(np.array(c["doc_lengths"], np.int64)),
                    pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in own], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.record_batch(columns, names)

    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return placed.mapInArrow(decoded, kinds)


def unpacked(payload: bytes, plane_bytes: list[int], n: int, plane_bits: int, block: int) -> np.ndarray:
    """All ids of a chunk from its payload and index."""
    planes, at, out = {1: 32, 8: 4}[plane_bits], 0, []
    for k, first in enumerate(range(0, n, block)):
        some = []
        for size in plane_bytes[k * planes : (k + 1) * planes]:
            some.append(payload[at : at + size])
            at += size
        out.append(from_planes(some, min(block, n - first), plane_bits))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def round_trip(docs: DataFrame, tokenizer: str | None = None, plane_bits: int = 8) -> DataFrame:
    """Write the tokens of ``docs`` to the shared folder and read the files back."""
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, plane_bits=plane_bits)
    return read_tokens(docs.sparkSession, path)
