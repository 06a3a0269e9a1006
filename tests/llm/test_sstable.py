import io
import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from common import documents, empty, hard, row
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helixgate.llm import sstable

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(1 << 63), (1 << 63) - 1)), st.lists(st.integers(0, 65535), max_size=9)), max_size=60))
def test_round_trip_and_lookup(rows):
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    out = io.BytesIO()
    writer = sstable.Writer(out, 2, block_bytes=40)
    for doc, ids in rows:
        writer.add(sstable.key_of(doc), np.array(ids, "<u2").tobytes())
    writer.close()
    reader = sstable.Reader(io.BytesIO(out.getvalue()))
    got = [(sstable.id_of(k), before, reader.ids_of(v).tolist()) for k, before, v in reader]
    want, start = [], 0
    for doc, ids in rows:
        want.append((doc, start, ids))
        start += len(ids)
    assert got == want and (reader.documents, reader.ids) == (len(rows), start)
    for doc in {r[0] for r in rows}:
        assert [(b, reader.ids_of(v).tolist()) for b, v in reader.get(sstable.key_of(doc))] == [w[1:] for w in want if w[0] == doc]
    missing = [k for k in range(500) if k not in {r[0] for r in rows}]
    assert all(reader.get(sstable.key_of(k)) == [] for k in missing)
    assert sum(reader.may_hold(sstable.key_of(k)) for k in missing) < 60


def test_damage_is_found():
    out = io.BytesIO()
    writer = sstable.Writer(out, 4)
    for k in range(100):
        writer.add(sstable.key_of(k), np.arange(k, dtype="<u4").tobytes())
    writer.close()
    data = bytearray(out.getvalue())
    data[50] ^= 1
    with pytest.raises(ValueError):
        list(sstable.Reader(io.BytesIO(bytes(data))))
    with pytest.raises(ValueError):
        writer.add(sstable.key_of(-5), b"")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abZ é.,'<|>endoftx\t\n\u00a0\u0301\u0130J\u030c1ß日", max_size=40), max_size=6))
def test_chunks_give_the_ids_of_whole_texts(texts):
    encoder = sstable.Encoder(TOKENIZER.to_str(), most=5)
    assert encoder.by_chunk
    texts = [*texts, "<|endoftext|> a", "Don't STOP, it's"]
    want = [np.array([*TOKENIZER.encode(t, add_special_tokens=False).ids, 2], "<u2").tobytes() for t in texts]
    for _ in range(2):
        assert encoder.encode(pa.array(texts)) == want


def expected(docs):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    out, start = [], 0
    for r in rows:
        ids = np.array([*TOKENIZER.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_hard_rows(spark):
    docs = hard(spark)
    got = sorted(map(tuple, sstable.tokenize_to_shards(docs, PATH).collect()), key=lambda r: r[1])
    want = expected(docs)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sorted(map(str, (r[0::3] for r in got))) == sorted(map(str, (r[0::3] for r in want)))
    single = {r[0] for r in want if [x[0] for x in want].count(r[0]) == 1}
    assert [r for r in got if r[0] in single] == [r for r in want if r[0] in single]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizers_encode_whole_texts(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    encoder = sstable.Encoder(tokenizer.to_str())
    assert not encoder.by_chunk
    texts = ["Two  words, and\nMORE. <|endoftext|>x", "", "a b"]
    assert encoder.encode(pa.array(texts)) == [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], encoder.kind).tobytes() for t in texts]


def test_facts_of_tokenizers():
    assert sstable.facts_of(TOKENIZER.to_str()) == sstable.Facts(True, True, True, ("<|",))
    cased = json.loads(TOKENIZER.to_str())
    cased["normalizer"]["normalizers"].pop()
    assert sstable.facts_of(json.dumps(cased)) == sstable.Facts(True, False, True, ("<|",))
    cased["added_tokens"][0]["content"] = "START"
    assert not sstable.facts_of(json.dumps(cased)).by_chunk
    cased = json.loads(TOKENIZER.to_str())
    cased["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] += "| ?x"
    assert not sstable.facts_of(json.dumps(cased)).by_chunk


def test_string_ids_small_shards_and_lookup(spark, tmp_path):
    docs = spark.createDataFrame([(f"doc-{n:03d}", f"text number {n} " * (n % 7)) for n in range(60)] + [(None, "x"), ("é", None)], "doc_id string, text string")
    folder = f"file://{tmp_path}"
    manifest = sstable.write_shards(docs, PATH, folder, shard_chars=500)
    files = manifest.orderBy("shard").collect()
    assert len(files) > 3
    got = sorted(map(tuple, sstable.read_shards(manifest, folder, "string").collect()), key=lambda r: r[1])
    rows = sorted(docs.collect(), key=lambda r: (r[0] is not None, (r[0] or "").encode()))
    start = 0
    for g, r in zip(got, rows, strict=True):
        ids = np.array([*TOKENIZER.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert g == (r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    found = []
    for f in files:
        with open(tmp_path / f["file"], "rb") as source:
            found += [(f["before"] + b, len(v) // 2) for b, v in sstable.Reader(source).get(sstable.key_of("doc-033"))]
    assert found == [next(g[1:3] for g in got if g[0] == "doc-033")]


def test_object_store_names():
    assert sstable._files("file:///tmp/x")[1] == "/tmp/x"
    assert [sstable._uri(x) for x in ("s3a://b/f", "gs://b/f", "file:///x")] == ["s3://b/f", "gs://b/f", "file:///x"]


def test_empty_table(spark):
    assert sstable.tokenize_to_shards(empty(spark), PATH).count() == 0
    assert sstable.tokenize_to_shards(documents(spark, [row(3, None)]), PATH).collect()[0][:3] == (3, 0, 1)
