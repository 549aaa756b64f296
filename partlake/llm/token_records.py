"""Token-ID output as length-delimited binary records with a separate offset index.

A record file is a run of frames, each::

    length   unsigned 64-bit, little-endian: bytes of data
    check    unsigned 32-bit: masked crc32c of the eight length bytes
    data     the sequence, ids as little-endian unsigned integers of ``id_bytes``
    check    unsigned 32-bit: masked crc32c of data

The mask rotates a checksum right by 15 bits and adds a constant, so that a checksum
stored inside data is not mistaken for one of its own. The offset index is a Parquet
table (file, first byte and length of each frame, id, number of ids), by which readers
fetch frames in any order. Files are named by the attempt that wrote them and only
those in the index exist for readers: a task that is lost and run again leaves at
most an unlisted file.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from partlake.llm.batches import slices_by_bytes, text_batches

CASTAGNOLI = 0x82F63B78
MASK_ADD = 0xA282EAD8
HEAD = struct.Struct("<QI")
TAIL = struct.Struct("<I")


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CASTAGNOLI), t >> 1).astype(np.uint32)
    return t


@lru_cache(maxsize=64)
def _zeros(power: int) -> np.ndarray:
    """Effect of 2**power zero bytes on a checksum register, as one 256-entry table a byte."""
    t = _crc_table()
    if power == 0:
        reg = np.arange(32, dtype=np.uint32)
        col = (np.uint32(1) << reg).astype(np.uint32)
        out = (col >> np.uint32(8)) ^ t[col & 0xFF]
    else:
        half = _zeros(power - 1)
        col = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
        out = _apply(half, _apply(half, col))
    tables = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            sel = (np.arange(256) >> bit) & 1 == 1
            tables[byte, sel] ^= out[8 * byte + bit]
    return tables


def _apply(tables: np.ndarray, reg: np.ndarray) -> np.ndarray:
    return tables[0, reg & 0xFF] ^ tables[1, (reg >> 8) & 0xFF] ^ tables[2, (reg >> 16) & 0xFF] ^ tables[3, reg >> 24]


def crc32c_many(items: list[bytes], power: int = 8) -> np.ndarray:
    """Castagnoli checksums of many byte strings at once.

    All strings are cut into blocks of ``2 ** power`` bytes (zeros in front, which leave
    an empty register as it is) that run side by side; the blocks of a string are then
    joined in pairs, the left register moving on by the right one's length.
    """
    table = _crc_table()
    n = np.array([len(x) for x in items], np.int64)
    blocks = np.maximum(1, -(-n >> power))
    ends = np.cumsum(blocks) << power
    buf = bytearray(int(ends[-1]) if len(ends) else 0)
    for x, end in zip(items, ends.tolist()):
        buf[end - len(x) : end] = x
    regs = np.zeros(len(buf) >> power, np.uint32)
    for col in np.ascontiguousarray(np.frombuffer(buf, np.uint8).reshape(-1, 1 << power).T):
        regs = table[(regs ^ col) & 0xFF] ^ (regs >> np.uint32(8))
    while len(regs) > len(items):
        odd = (blocks & 1) == 1
        starts = np.cumsum(blocks) - blocks
        regs = np.insert(regs, starts[odd], np.uint32(0))
        blocks = (blocks + odd) // 2
        regs = _apply(_zeros(power), regs[0::2]) ^ regs[1::2]
        power += 1
    start = np.full(len(items), 0xFFFFFFFF, np.uint32)
    for p in range(int(n.max(initial=0)).bit_length()):
        on = (n >> p) & 1 == 1
        start[on] = _apply(_zeros(p), start[on])
    return regs ^ start ^ np.uint32(0xFFFFFFFF)


def crc32c(data: bytes) -> int:
    return int(crc32c_many([data])[0])


def _mask(crc: np.ndarray) -> np.ndarray:
    c = crc.astype(np.uint64)
    return ((((c >> np.uint64(15)) | (c << np.uint64(17))) + np.uint64(MASK_ADD)) & np.uint64(0xFFFFFFFF)).astype("<u4")


def frames(items: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(x)) for x in items]
    head_checks = _mask(crc32c_many(heads, 3)).tolist()
    checks = _mask(crc32c_many(items)).tolist()
    return [h + TAIL.pack(a) + x + TAIL.pack(b) for h, a, x, b in zip(heads, head_checks, items, checks)]


def unframe(bufs: list[bytes]) -> list[bytes]:
    """The data of whole frames; raises ValueError where a length or a checksum is wrong."""
    if any(len(b) < HEAD.size + TAIL.size or HEAD.unpack_from(b)[0] != len(b) - HEAD.size - TAIL.size for b in bufs):
        raise ValueError("frame length does not match")
    out = [b[HEAD.size : -TAIL.size] for b in bufs]
    if (_mask(crc32c_many([b[:8] for b in bufs], 3)) != np.array([HEAD.unpack_from(b)[1] for b in bufs], np.uint32)).any():
        raise ValueError("length checksum does not match")
    tails = np.array([TAIL.unpack_from(b, len(b) - TAIL.size)[0] for b in bufs], np.uint32)
    if (_mask(crc32c_many(out)) != tails).any():
        raise ValueError("data checksum does not match")
    return out


class WordEncoder:
    """Whole-text encoding with the tokenizers library, word by word with a bounded memory of words.

    For vocabularies whose pre-tokenizer drops white space, so that a blank always
    separates matches: a text's ids are those of its blank-separated words in order.
    Words of Latin letters, which normalisation only lower-cases and the pre-tokenizer
    leaves whole, go straight to the library's merge model; all others take its full path.
    Added tokens such as ``<|endoftext|>`` have their ids wherever a text holds them, as the
    library does it; with ``split_added`` they are cut into pieces like other text.
    """

    _plain = re.compile(r"([A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]+)([.,]?)").fullmatch

    def __init__(self, path: str, id_bytes: int, words: int = 600_000, split_added: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        if split_added:
            self.tok.encode_special_tokens = True
        self.tok.no_padding()
        self.tok.no_truncation()
        self.kind = np.dtype(f"<u{id_bytes}")
        self.id_bytes = id_bytes
        self.words = words
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks = {"": b"", ".": self._full(["."])[0], ",": self._full([","])[0]}
        self.byte_chars = _byte_chars()
        self.direct = self._agrees()

    def _full(self, words: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _model(self, word: str) -> bytes:
        mapped = word if word.isascii() else "".join([self.byte_chars[b] for b in word.encode()])
        ids = [t.id for t in self.tok.model.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}{'H' if self.id_bytes == 2 else 'I'}", *ids)

    def _agrees(self) -> bool:
        """Whether the short way gives this vocabulary's ids; where its pipeline differs, only the full path is used."""
        probe = ["the", "Encoding", "Éàüß", "xylophonistically", "straße", "QUEUE", "naïveté"]
        return all(self._model(w.lower()) == f for w, f in zip(probe, self._full(probe))) and all(
            f == self._model(w[:-1]) + self.marks["."] for w, f in [("word.", self._full(["word."])[0])]
        )

    def _learn(self, new: list[str]) -> None:
        known, slow = self.known, []
        for w in new:
            m = self._plain(w) if self.direct else None
            if m is None:
                slow.append(w)
                continue
            low = m[1].lower()
            ids = known.get(low) or self.older.get(low)
            if ids is None:
                ids = self._model(low)
            known[low] = ids
            known[w] = ids + self.marks[m[2]]
        for i in range(0, len(slow), 4096):
            known.update(zip(slow[i : i + 4096], self._full(slow[i : i + 4096])))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids, packed. Words are told apart once a batch; ids are then gathered by word number."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        ends = words.offsets.to_numpy()
        ends = ends - ends[0]
        coded = words.flatten().dictionary_encode()
        which = coded.indices.to_numpy()
        unique = coded.dictionary.to_pylist()
        if len(self.known) + len(unique) > self.words:  # words not met in a while are forgotten
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = [w for w in unique if w not in known]
        if new:
            known.update((w, older[w]) for w in new if w in older)
            self._learn([w for w in new if w not in known])
        ids = [known[w] for w in unique]
        flat = np.frombuffer(b"".join(ids), self.kind)
        size = np.array([len(x) for x in ids], np.int32) // self.id_bytes
        start = (np.cumsum(size, dtype=np.int64) - size).astype(np.int32)
        upto = np.zeros(len(which) + 1, np.int64)
        np.cumsum(size[which], out=upto[1:])
        parts = []
        for i in range(0, len(which), 1 << 16):  # pieces that stay in the processor's cache
            w = which[i : i + (1 << 16)]
            n = size[w]
            at = np.cumsum(n, dtype=np.int32)
            parts.append(flat[np.repeat(start[w] - (at - n), n) + np.arange(at[-1], dtype=np.int32)].tobytes())
        packed = b"".join(parts)
        cut = (upto[ends] * self.id_bytes).tolist()
        return [packed[a:b] for a, b in zip(cut[:-1], cut[1:])]


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=2)
def _encoder(path: str, id_bytes: int, split_added: bool) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path, id_bytes, split_added=split_added)


def write_token_records(
    docs: DataFrame,
    out_dir: str,
    tokenizer_file: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    id_bytes: int = 2,
    partitions: int | None = None,
    split_added: bool = True,
) -> DataFrame:
    """Write every text's ids and ``end_id`` as one record each, in ascending id order; returns the offset index.

    Files follow each other in name order, records inside a file in id order (a null id
    first, rows that repeat an id by text). Null and empty texts are records of the end id
    alone. The index has: ``part`` (order of the files), ``file``, ``row`` (order in the
    file), ``offset`` and ``size`` of the frame, id, ``n_tokens``. An empty table gives an
    empty index and no file. Added tokens that a text holds literally are split into pieces,
    or with ``split_added=False`` get their ids. Only the id and text columns are read. ``out_dir`` is a folder
    that all executors can write to.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    fs_dir = out_dir if "://" in out_dir or out_dir.startswith("file:") else f"file://{out_dir}"
    if fs_dir.startswith("file:/") and not fs_dir.startswith("file://"):
        fs_dir = "file://" + fs_dir.removeprefix("file:")
    end = int(end_id).to_bytes(id_bytes, "little")
    run_id = uuid.uuid4().hex[:8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        enc = _encoder(tokenizer_file, id_bytes, split_added)
        part, out, at, row = task.partitionId(), None, 0, 0
        name = f"records-{part:06d}-{run_id}-{task.taskAttemptId()}.bin"
        fs, root = pafs.FileSystem.from_uri(fs_dir)
        try:
            for b in batches:
                for s in slices_by_bytes(b, 1):
                    data = [x + end for x in enc.encode(s.column(1))]
                    framed = frames(data)
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{name}")
                    out.write(b"".join(framed))
                    sizes = np.array([len(f) for f in framed], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part] * len(s), pa.int32()),
                            pa.array([name] * len(s), pa.string()),
                            pa.array(np.arange(row, row + len(s), dtype=np.int64)),
                            pa.array(at + np.cumsum(sizes) - sizes),
                            pa.array(sizes),
                            s.column(0),
                            pa.array([len(x) // id_bytes for x in data], pa.int64()),
                        ],
                        names=["part", "file", "row", "offset", "size", id_col, "n_tokens"],
                    )
                    at += int(sizes.sum())
                    row += len(s)
        finally:
            if out is not None:
                out.close()

    slim = docs.select(id_col, text_col)
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = slim.repartitionByRange(n, id_col).sortWithinPartitions(id_col, text_col)
    schema = f"part int, file string, row long, offset long, size long, `{id_col}` {kind}, n_tokens long"
    text_batches(ordered).mapInArrow(run, schema).write.parquet(f"{out_dir}/index")
    return docs.sparkSession.read.schema(schema).parquet(f"{out_dir}/index")


def read_token_records(spark: SparkSession, out_dir: str, id_col: str = "doc_id", id_bytes: int = 2) -> DataFrame:
    """(``part``, ``row``, id, ``ids`` binary as unsigned 32-bit): every record, checked, from the files by the index.

    Each task takes whole files of the index in one pass; a record that fails its
    checksums fails the task.
    """
    index = spark.read.parquet(f"{out_dir}/index")
    kind = index.schema[id_col].dataType.simpleString()
    fs_dir = out_dir if "://" in out_dir else f"file://{out_dir.removeprefix('file:')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(fs_dir)
        name, src = None, None
        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                part, file, row, offset, size, ids = (s.column(c) for c in range(6))
                out = []
                for f, o, z in zip(file.to_pylist(), offset.to_pylist(), size.to_pylist()):
                    if f != name:
                        if src is not None:
                            src.close()
                        name, src = f, fs.open_input_file(f"{root}/{f}")
                    out.append(src.read_at(z, o))
                out = [np.frombuffer(x, f"<u{id_bytes}").astype("<u4").tobytes() for x in unframe(out)]
                yield pa.RecordBatch.from_arrays(
                    [part, row, ids, pa.array(out, pa.binary())], names=["part", "row", id_col, "ids"]
                )
        if src is not None:
            src.close()

    return index.select("part", "file", "row", "offset", "size", id_col).mapInArrow(
        run, f"part int, row long, `{id_col}` {kind}, ids binary"
    )
