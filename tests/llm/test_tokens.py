import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import bpe, pretoken, token_files

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n a", "it's we'll I'dx 'S 'll''s", "a\tb \x1c\x85\xa0 c", "漢字とかな١٢٣½", "x" * 5000, "  tail  ", "<|endoftext|>", "é́ \U0001f600\0", "ab " * 300_000, "'" * 50 + "s"]


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(RANKS))


def test_perfect_hash_is_minimal_and_perfect(codec):
    n = len(codec.tokens)
    slots = codec.hash.slots(codec.tokens)
    assert sorted(slots.tolist()) == list(range(n))
    assert (codec.hash.order[slots] == np.arange(n)).all()
    small = bpe.PerfectHash([b"a", b"b", b"c"])
    assert sorted(small.slots([b"a", b"b", b"c"]).tolist()) == [0, 1, 2]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_as_by_the_library(codec, library, text):
    (ids,) = codec.encode([text])
    assert ids.tolist() == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_texts_next_to_each_other(codec, library):
    rnd = random.Random(2)
    alphabet = "aZé 漢1½'’srtvelmd \n\t\r\x0b\x1c\x85\xa0 _-!\0😀"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    assert [x.tolist() for x in codec.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_every_character_is_of_the_right_class(codec, library):
    texts = ["a" + chr(c) + "1" + chr(c) + ". " + chr(c) + "a" for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    assert [x.tolist() for x in codec.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_long_text_is_cut_where_a_pretoken_begins(codec, library, monkeypatch):
    monkeypatch.setattr(pretoken, "CHUNK", 1000)
    text = "Some words, it's 12 here.\n\n   And more " * 400
    assert len(list(pretoken.pieces(text, 1000))) > 5
    (ids,) = codec.encode([text])
    assert ids.tolist() == library.encode_ordinary(text)


def test_round_trip_on_tables(spark, library):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("token_ids", F.lit("clash"))
    codec = bpe.ByteBPE(spark, RANKS)
    got = codec.decode(codec.encode(df)).withColumn("array", bpe.unpacked(F.substring("token_ids", 1, 400))).collect()
    both = {r.doc_id: r for r in codec.round_trip(df).collect()}
    for r in got:
        ids = library.encode_ordinary(ODD[r.doc_id] or "")
        assert np.frombuffer(r.token_ids, "<u4").tolist() == ids
        assert r.array == ids[:100]
        assert bytes(r.decoded) == (ODD[r.doc_id] or "").encode()
        assert (both[r.doc_id].token_ids, both[r.doc_id].decoded) == (r.token_ids, r.decoded)
    assert codec.round_trip(spark.createDataFrame([], "text string")).collect() == []


def test_query_digests(spark, library):
    from quire.llm.queries import op1_byte_bpe

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in op1_byte_bpe(spark, folder).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def expected(rows):
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    out, start = {}, 0
    for doc_id, text in sorted(rows):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_token_files(spark, tmp_path):
    rows = list(enumerate(ODD))
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string").withColumn("id", F.lit("clash")).repartition(3)
    manifest = token_files.write_token_files(df, f"file://{tmp_path}", JSON, length=64)
    got = token_files.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.c) for r in got} == expected(rows)
    for part in manifest.collect():
        file = token_files.TokenFile(part.tokens)
        assert isinstance(file.source, pa.MemoryMappedFile)
        ids, mask = zip(*(file.sequence(r) for r in range(part.n_sequences)))
        assert all(len(x) == 64 for x in ids)
        assert sum(sum(m.to_pylist()) for m in mask) == part.n_ids
        assert pa.types.is_fixed_size_list(file.reader.schema.field("mask").type)


def test_token_files_of_no_rows(spark, tmp_path):
    manifest = token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}", JSON)
    assert token_files.read_token_files(manifest).collect() == []


def test_token_file_query(spark):
    from quire.llm.queries import op3_token_files

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op3_token_files(spark, folder).collect()} == expected(rows)


def test_added_tokens_as_by_the_plain_call():
    with open(JSON, encoding="utf-8") as f:
        spec = f.read()
    texts = [t or "" for t in ODD] + ["a <|endoftext|> b", "<|endoftext|><|endoftext|>\n x", "<|endoftext|", "it's <|endoftext|>"]
    flagged = json.loads(spec)
    flagged["added_tokens"][0] |= {"lstrip": True, "rstrip": True}
    for s in (spec, json.dumps(flagged)):
        plain = Tokenizer.from_str(s)
        got = [x.tolist() for x in token_files.LibraryEncoder(s, added=True).encode(texts)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [64, 220, 50256, 275] in [x.tolist() for x in token_files.LibraryEncoder(spec, added=True).encode(texts)]


def test_query_takes_added_tokens(spark, tmp_path):
    from quire.llm.queries import op3_token_files

    rows = [(1, "a <|endoftext|> b"), (2, "c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = np.array([64, 220, 50256, 275, 0], "<u4").tobytes()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op3_token_files(spark, str(tmp_path)).collect()}
    assert got[1] == (0, 5, zlib.crc32(ids)) and got[2][:2] == (5, 2)


def test_pretokens_are_made_once_in_a_worker(monkeypatch):
    with open(JSON, encoding="utf-8") as f:
        spec = f.read()
    made = []
    real = token_files.LibraryEncoder._ids
    monkeypatch.setattr(token_files.LibraryEncoder, "_ids", lambda self, new: made.extend(new) or real(self, new))
    token_files.encoder_of.cache_clear()
    for _ in range(3):  # as many tasks
        list(token_files.encoder_of(spec, False).encode(["some words", " some", "words", "x" * 100]))
    assert sorted(made) == [" some", " words", "some", "words", *["x" * 100] * 3]


def test_what_is_forgotten_is_made_anew(library):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abé漢'1 \n") for _ in range(rnd.randrange(1, 9))) for _ in range(900)]
    texts = [" ".join(rnd.choices(words[a : a + 60], k=50)) for a in range(0, 840, 6)] + ["y" * 70, ""]
    codec = bpe.Codec(bpe.read_ranks(RANKS))
    codec.known = pretoken.Remembered(64)
    for _ in range(2):
        got = [ids.tolist() for t in texts for ids in codec.encode([t])]
        assert got == [library.encode_ordinary(t) for t in texts]
    assert sum(len(t.hashes) for t in codec.known.tables) < 900


def test_texts_stay_with_the_workers(spark):
    df = spark.createDataFrame([(1, "two words"), (2, None)], "doc_id long, text string")
    codec = bpe.ByteBPE(spark, RANKS)
    got = codec.round_trip(df, keep_text=False)
    assert got.columns == ["doc_id", "token_ids", "decoded"]
    assert got.orderBy("doc_id").collect() == codec.round_trip(df).drop("text").orderBy("doc_id").collect()
