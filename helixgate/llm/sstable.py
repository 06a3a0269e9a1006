"""Token-ID output as sorted-string-table shards.

A shard holds documents in ascending key order in blocks of about ``block_bytes``:

    block   entries, then crc32 of them (u32)
    entry   varint shared, varint unshared, varint value bytes, unshared key bytes, value
    index   per block: varint key bytes, first key, then offset, bytes, entries, ids before (u64 each)
    bloom   bits of a Bloom filter over all keys
    footer  index offset, index bytes, bloom offset, bloom bytes, documents, ids (u64 each),
            bytes of an id, hash functions (u32 each), crc32 of index and bloom (u32), magic

A key shares its first bytes with the key before it in the block; the first key of a block is
whole. Values are token ids, little-endian, in 2 bytes where the vocabulary allows and else 4.
``Reader.get`` asks the Bloom filter, bisects the sparse block index and reads one block.

A document's key is one byte (0 for a null doc_id, which comes first, 1 for a number, 2 for a string)
and the doc_id: a number with its sign bit turned, big-endian, so that bytes sort as numbers do, or the
string's UTF-8. Repeated doc_ids keep all their rows, in the order of their texts' hashes.

Texts are dealt to shards of about ``shard_chars`` characters by ranges of doc_id, and of the texts'
hashes where doc_ids repeat; each task sorts, encodes and streams its range to a file of a name of its
own, and only files that the manifest of successful tasks names count, so lost executors and repeated
tasks leave no trace in the result. Texts of one doc_id and hash stay in one shard.

Defined results: null text is encoded as empty (the end id alone); very long texts are encoded whole, by
themselves; rows that repeat a doc_id are kept each, ties in any order, as they are equal; an empty table
gives no shards and an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import array
import bisect
import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from .shared import fresh_path, materialize, read, slices, tidied

MAGIC = b"HGSST\x00\x00\x01"
FOOTER = struct.Struct("<6Q3I8s")
INDEX_ROW = struct.Struct("<4Q")
END_ID = 2


def key_of(doc_id: int | str | None) -> bytes:
    if doc_id is None:
        return b"\x00"
    if isinstance(doc_id, str):
        return b"\x02" + doc_id.encode()
    return b"\x01" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | str | None:
    if key == b"\x00":
        return None
    return key[1:].decode() if key[0] == 2 else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class Writer:
    """Streams entries in key order to ``out``, anything with write()."""

    def __init__(self, out, id_bytes: int, block_bytes: int = 1 << 16, bits_per_key: int = 10):
        self.out, self.id_bytes, self.block_bytes, self.bits_per_key = out, id_bytes, block_bytes, bits_per_key
        self.at = self.documents = self.ids = 0
        self.block, self.last, self.first, self.entries, self.before = bytearray(), b"", b"", 0, 0
        self.index, self.hashes = bytearray(), array.array("Q")

    def add(self, key: bytes, value: bytes) -> None:
        if self.documents and key < self.last:
            raise ValueError("keys must ascend")
        if self.entries and len(self.block) >= self.block_bytes:
            self._flush()
        shared = 0
        if not self.entries:
            self.first, self.before = key, self.ids
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.entries += 1
        self.documents += 1
        self.ids += len(value) // self.id_bytes
        self.hashes.append(xxhash.xxh64_intdigest(key))

    def _flush(self) -> None:
        data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
        self.out.write(data)
        self.index += _varint(len(self.first)) + self.first + INDEX_ROW.pack(self.at, len(data), self.entries, self.before)
        self.at += len(data)
        self.block, self.entries = bytearray(), 0

    def close(self) -> None:
        if self.entries:
            self._flush()
        k = max(1, round(self.bits_per_key * 0.69))
        size = max(64, -(-self.documents * self.bits_per_key // 8) * 8)
        packed = np.zeros(size // 8, np.uint8)
        for n in range(0, len(self.hashes), 1 << 16):
            h = np.frombuffer(self.hashes[n : n + (1 << 16)], np.uint64)
            for i in range(k):
                at = _probe(h, i, size)
                np.bitwise_or.at(packed, (at >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))
        bloom, index = packed.tobytes(), bytes(self.index)
        self.out.write(index + bloom)
        crc = zlib.crc32(bloom, zlib.crc32(index))
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.documents, self.ids, self.id_bytes, k, crc, MAGIC))


def _probe(h, i: int, size: int):
    """Double hashing with the two halves of a 64-bit hash."""
    if isinstance(h, int):
        return ((h & 0xFFFFFFFF) + i * (h >> 32 | 1)) % size
    return ((h & np.uint64(0xFFFFFFFF)) + np.uint64(i) * (h >> np.uint64(32) | np.uint64(1))) % np.uint64(size)


class Reader:
    """Random access to one shard; ``source`` has seek() and read()."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - FOOTER.size)
        at, n, bloom_at, bloom_n, self.documents, self.ids, self.id_bytes, self.k, crc, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        source.seek(at)
        index = source.read(n)
        self.bloom = source.read(bloom_n)
        if zlib.crc32(self.bloom, zlib.crc32(index)) != crc:
            raise ValueError("index or Bloom filter is damaged")
        self.first, self.rows, p = [], [], 0
        while p < n:
            size, p = _read_varint(index, p)
            self.first.append(index[p : p + size])
            self.rows.append(INDEX_ROW.unpack_from(index, p + size))
            p += size + INDEX_ROW.size

    def may_hold(self, key: bytes) -> bool:
        h, size = xxhash.xxh64_intdigest(key), len(self.bloom) * 8
        return all(self.bloom[b >> 3] >> (7 - (b & 7)) & 1 for b in (_probe(h, i, size) for i in range(self.k)))

    def block(self, number: int):
        """(key, ids before the entry in this shard, value) of every entry of a block."""
        at, n, entries, before = self.rows[number]
        self.source.seek(at)
        data = self.source.read(n)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {number} is damaged")
        p, key = 0, b""
        for _ in range(entries):
            shared, p = _read_varint(data, p)
            unshared, p = _read_varint(data, p)
            size, p = _read_varint(data, p)
            key = key[:shared] + data[p : p + unshared]
            p += unshared
            yield key, before, data[p : p + size]
            p += size
            before += size // self.id_bytes

    def __iter__(self):
        for number in range(len(self.rows)):
            yield from self.block(number)

    def get(self, key: bytes) -> list[tuple[int, bytes]]:
        """(ids before it, value) of every document with this key."""
        found: list[tuple[int, bytes]] = []
        if not self.may_hold(key):
            return found
        number = max(0, bisect.bisect_left(self.first, key) - 1)
        while number < len(self.rows) and self.first[number] <= key:
            found += [(before, value) for k, before, value in self.block(number) if k == key]
            number += 1
        return found

    def ids_of(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.id_bytes == 2 else "<u4").astype("<u4")


@dataclass(frozen=True)
class Facts:
    """What a tokenizer's JSON says that lets its texts be encoded chunk by chunk."""

    #: no token crosses white space
    by_chunk: bool
    #: case doesn't matter
    lower: bool
    #: letters and punctuation are never in one token
    splits_marks: bool
    #: how special tokens begin; texts with such an opening are encoded whole
    openings: tuple[str, ...]


_PLAIN = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"}


def facts_of(tokenizer_json: str) -> Facts:
    """Only what is certain: any normalizer or pre-tokenizer that is not known here means whole texts."""
    known = json.loads(tokenizer_json)
    norm, pre = known.get("normalizer"), known.get("pre_tokenizer")
    norms = norm["normalizers"] if norm and norm["type"] == "Sequence" else [norm] if norm else []
    pres = pre["pretokenizers"] if pre and pre["type"] == "Sequence" else [pre] if pre else []
    blank = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    plain = all(n["type"] in _PLAIN or n == blank for n in norms)
    pattern = ""
    if pres and pres[0]["type"] == "Split" and pres[0]["behavior"] == "Removed" and pres[0]["invert"]:
        pattern = pres[0]["pattern"].get("Regex", "")
    # besides classes that leave white space out, nothing that could match it
    rest = re.sub(r"\[\^\\s[^\]]*\]", "", pattern)
    cuts = bool(pattern) and not re.search(r"\\[sWDHvRX]|[ .]|\[\^|\\p\{Z|\\P", rest) or bool(pres) and pres[0]["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")
    rest_known = all(p["type"] == "ByteLevel" and not p.get("add_prefix_space") for p in pres[1:])
    openings = {re.match(r"[^\w\s]*", t["content"]).group() for t in known.get("added_tokens", [])}
    return Facts(
        by_chunk=plain and cuts and rest_known and "" not in openings and not known.get("truncation"),
        lower=any(n["type"] == "Lowercase" for n in norms),
        splits_marks="[\\p{L}]+" in pattern and "[^\\s\\p{L}\\p{N}]+" in pattern,
        openings=tuple(sorted(openings)),
    )


class Encoder:
    """Whole texts to ids through the tokenizer library.

    A tokenizer whose pre-tokenizer never lets a token cross white space gives a text the ids of
    its chunks between white space one after the other; where its JSON says so (``facts_of``), distinct
    chunks are encoded once and remembered in two generations of ``most`` chunks: the older one is
    given up when the younger is full. Texts with the opening of a special token are encoded whole, as
    all texts are with other tokenizers.

    New words of Latin letters go to the library many to a string. Its word-end marks tell them
    apart again; a string whose marks don't add up is encoded word by word."""

    def __init__(self, tokenizer_json: str, most: int = 300_000, whole: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.facts, self.most = facts_of(tokenizer_json), most
        self.by_chunk = self.facts.by_chunk and not whole
        self.id_bytes = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = "<u2" if self.id_bytes == 2 else "<u4"
        self.end = np.array([END_ID], self.kind).tobytes()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix := getattr(self.tokenizer.model, "end_of_word_suffix", None):
            self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters, 256 to a string."""
        out: list[bytes] = []
        groups = [words[k : k + 256] for k in range(0, len(words), 256)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.int64)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(group) or ends[-1] != len(ids):
                out += self._bytes(group)
                continue
            data = ids.astype(self.kind).tobytes()
            at = [0, *(ends * self.id_bytes).tolist()]
            out += [data[a:b] for a, b in zip(at, at[1:])]
        return out

    def _learn(self, chunks: set[str]) -> None:
        """Bring all chunks to the younger generation, new ones encoded. Where the tokenizer does so too, an
        ASCII chunk is taken in lower case, and cut before one closing comma or full stop after a Latin-1 letter."""
        unknown = chunks.difference(self.young)
        if len(self.young) + len(unknown) > self.most:
            self.old, self.young, unknown = self.young, {}, chunks
        parts: dict[str, tuple[str, str]] = {}
        for c in unknown:
            if c in self.old:
                self.young[c] = self.old[c]
                continue
            core, tail = (c.lower() if self.facts.lower and c.isascii() else c), ""
            if self.facts.splits_marks and len(core) > 1 and core[-1] in ",." and core[-2].isalpha() and core[-2] < "\u0100":
                core, tail = core[:-1], core[-1]
            parts[c] = (core, tail)
        ids: dict[str, bytes] = {"": b""}
        new = {x for p in parts.values() for x in p if x}
        ids.update((x, found) for x in new if (found := self.young.get(x) or self.old.get(x)))
        new.difference_update(ids)
        plain = [x for x in new if x.isalpha() and max(x) < "\u0250"]
        ids.update(zip(plain, self._words(plain)))
        rest = list(new.difference(plain))
        ids.update(zip(rest, self._bytes(rest)))
        for c, (core, tail) in parts.items():
            self.young[c] = ids[core] + ids[tail]
            self.young[core] = ids[core]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text with the end id, as bytes."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            # slices of some megabytes; a longer text is a slice of its own
            step = max(1, min(len(texts) - at, 2048, (SLICE_BYTES * (len(texts) - at)) // (texts[at:].nbytes + 1)))
            out += self._slice(texts[at : at + step])
            at += step
        return out

    def _slice(self, texts: pa.Array) -> list[bytes]:
        if not self.by_chunk:
            return [x + self.end for x in self._bytes(texts.to_pylist())]
        whole = sorted({n for x in self.facts.openings for n in np.flatnonzero(pc.match_substring(texts, x).to_numpy(zero_copy_only=False)).tolist()})
        instead = dict(zip(whole, self._bytes([texts[n].as_py() for n in whole])))
        if len(whole) == len(texts):
            return [instead[n] + self.end for n in whole]
        for blank in "\t\n\r":
            texts = pc.replace_substring(texts, blank, " ")
        chunks = pc.split_pattern(texts, " ")
        coded = chunks.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        distinct = coded.dictionary.to_pylist()
        self._learn(set(distinct))
        values = [self.young[c] for c in distinct]
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.id_bytes
        flat = np.frombuffer(b"".join(values), self.kind)
        starts = np.cumsum(sizes) - sizes
        # every chunk's ids, one chunk after the other
        each = sizes[index]
        ends = np.cumsum(each)
        ids = flat[np.repeat(starts[index] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        bounds = np.concatenate([[0], ends])[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()] * self.id_bytes
        return [(instead[n] if n in instead else ids[a:b]) + self.end for n, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist()))]


SLICE_BYTES = 4_000_000
#: characters of text to a shard
SHARD_CHARS = 32_000_000
_encoders: dict[int, Encoder] = {}


def _encoder(tokenizer_json: str) -> Encoder:
    """One encoder in each Python worker, kept from task to task with what it has learnt."""
    key = hash(tokenizer_json)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


def _uri(folder: str) -> str:
    """A folder's URI as pyarrow spells it: Hadoop's names of object stores are known too."""
    scheme, colon, rest = folder.partition("://")
    return {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(_uri(folder))


def write_shards(docs: DataFrame, tokenizer: str, folder: str, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Encode all documents to shards in ``folder`` (any URI that pyarrow's file systems open).
    Returns the manifest: file, shard, documents, ids, in shard order with the ids before it."""
    with open(tokenizer, encoding="utf-8") as f:
        tokenizer_json = f.read()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shards = 1 + (rows.agg(F.sum(F.length("text")).alias("c")).first()["c"] or 0) // shard_chars
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        part, name = TaskContext.get().partitionId(), None
        for batch in slices(batches, 2048):
            if name is None:
                encoder = _encoder(tokenizer_json)
                fs, top = _files(folder)
                fs.create_dir(top, recursive=True)
                name = f"shard-{part:06d}-{uuid.uuid4().hex}.sst"
                stream = fs.open_output_stream(f"{top}/{name}")
                writer = Writer(stream, encoder.id_bytes)
            ids = batch.column(0).to_pylist()
            for doc, value in zip(ids, encoder.encode(batch.column(1))):
                writer.add(key_of(doc), value)
        if name is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "shard": [part], "documents": [writer.documents], "ids": [writer.ids]})

    manifest = materialize(dealt.mapInArrow(tidied(run), "file string, shard long, documents long, ids long"), "sstable-manifest")
    # one row for each shard
    before = F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    return manifest.withColumn("before", F.coalesce(before, F.lit(0).cast("long")))


def read_shards(manifest: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """doc_id (of Spark type ``id_type``), start, n_tokens and ids_crc32 of every document, from the
    files; a task for each few of them."""
    tasks = max(1, min(manifest.count(), 8 * manifest.sparkSession.sparkContext.defaultParallelism))
    kind = to_arrow_type(_parse_datatype_string(id_type))

    def batch_of(rows):
        cols = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, top = _files(folder)
                with fs.open_input_file(f"{top}/{row['file']}") as source:
                    reader = Reader(source)
                    rows = []
                    for key, before, value in reader:
                        ids = reader.ids_of(value)
                        rows.append((id_of(key), row["before"] + before, len(ids), zlib.crc32(ids.tobytes())))
                        if len(rows) == 8192:
                            yield batch_of(rows)
                            rows = []
                    yield batch_of(rows)

    return manifest.select("file", "before").repartition(tasks, "file").mapInArrow(tidied(run), f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def tokenize_to_shards(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write shards, to a fresh folder beside the checkpoints by default, and read them back."""
    folder = folder or fresh_path(docs.sparkSession, "token-shards")
    return read_shards(write_shards(docs, tokenizer, folder), folder, dict(docs.dtypes)["doc_id"])


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenize_to_shards(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
