"""Token operators against the libraries, round trips and odd inputs."""

import random
import struct
import zlib

import public_tokenizers as vocabularies
import pytest
import tiktoken
from pyspark.sql import functions as F
from samples import awkward
from tokenizers import Tokenizer

from millrace.llm import bpe, token_counts, token_files
from millrace.llm.pieces import pieces
from millrace.session import workdir

RANKS, WORD = vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.path("word_bpe_49k.json")
PARTS = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "\xa0", "1", "22", "don't", "'S", "'ll", "é", "É", "日本", "🙂", "!!", "%%%", "aaaa", "the", "ING", "\r\n", "\x1c", "\x85", "İ", "Σ", "é", "<|endoftext|>", "<|ENDOFTEXT|>", "²", "×"]


def odd_texts(n=3000):
    rng = random.Random(1)
    return ["".join(rng.choices(PARTS, k=rng.randrange(14))) for _ in range(n)]


def test_merge_replay_equals_the_library():
    library = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    texts = odd_texts() + ["ab" * 3000 + "a" * 3000]
    got = bpe.Encoder(bpe.read_ranks(RANKS), vocabularies.PATTERN).encode(texts)
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in got] == [library.encode_ordinary(t) for t in texts]


def test_replay_takes_the_leftmost_of_equal_ranks_and_lower_ranks_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 300, b"aab": 290, b"ab": 310}
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    words = ["".join(w) for w in __import__("itertools").product("abc", repeat=6)]
    assert bpe.Replay(ranks).run([w.encode() for w in words]) == [library.encode_ordinary(w) for w in words]


def test_encode_and_decode_awkward_rows(spark):
    df = awkward(spark)
    both = bpe.decode(bpe.encode(df, RANKS, vocabularies.PATTERN), RANKS)
    assert both.columns == [c for c in df.columns if c != "ids"] + ["ids", "decoded"]
    rows = both.collect()
    assert len(rows) == df.count()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in rows)
    assert bpe.encode(df.limit(0), RANKS, vocabularies.PATTERN).count() == 0


def test_pieces_equal_the_library():
    library, own = Tokenizer.from_file(WORD), pieces(WORD)
    for t in odd_texts():
        keys = own.split(t)
        known = own.learn(set(keys))
        ids = library.encode(t, add_special_tokens=False).ids
        assert b"".join(map(known.__getitem__, keys)) == struct.pack(f"<{len(ids)}I", *ids), repr(t)


def test_counts_of_awkward_rows(spark):
    library, df = Tokenizer.from_file(WORD), awkward(spark)
    rows = token_counts.count_tokens(df, WORD, limit=100).collect()
    assert len(rows) == df.count()
    for r in rows:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 100)


@pytest.mark.parametrize("frame, file", [(64, 200), (1 << 18, 1 << 25)])
def test_files_read_back_in_order(spark, monkeypatch, frame, file):
    monkeypatch.setattr(token_files, "FRAME_BYTES", frame)
    monkeypatch.setattr(token_files, "FILE_BYTES", file)
    library, df = Tokenizer.from_file(WORD), awkward(spark)
    folder = workdir(spark, "tokens")
    token_files.write_tokens(df, folder, WORD, end_id=2)
    rows = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert [r.key is None for r in rows] == sorted((r.key is None for r in rows), reverse=True)
    named = [r.key for r in rows if r.key is not None]
    assert named == sorted(named)
    at, ids = 0, []
    for r in rows:
        assert r.start == at
        at += len(r.ids) // 4
        ids.append((r.key, zlib.crc32(bytes(r.ids))))
    want = []
    for r in df.collect():
        own = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, zlib.crc32(struct.pack(f"<{len(own)}I", *own))))
    by = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(ids, key=by) == sorted(want, key=by)
    some = {r.key: bytes(r.ids) for r in rows if r.key in (3, 6)}
    found = token_files.read_tokens(spark, folder, wanted=[3, 6, 99]).collect()
    assert {r.key: bytes(r.ids) for r in found} == some and len(some) == 2


def test_empty_table_writes_an_empty_folder(spark):
    folder = workdir(spark, "tokens")
    token_files.write_tokens(awkward(spark).limit(0), folder, WORD, end_id=2)
    assert token_files.read_tokens(spark, folder).count() == 0


def test_a_reader_opens_only_the_frames_it_needs_and_checks_them(monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_BYTES", 64)
    writer = token_files.Writer(2)
    for k in range(100):
        writer.add(k, struct.pack("<9I", *range(k, k + 9)))
    content = writer.finish() + struct.pack("<I", token_files.SEEKABLE)
    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
    assert len(plain) > 100 * 18  # any reader of the format takes the whole file
    opened = []
    reader = token_files.Reader(content)
    frame = reader.frame
    reader.frame = lambda k: opened.append(k) or frame(k)
    assert [k for k, _, _ in reader.documents([40])] == [40] and len(opened) == 1
    broken = bytearray(content)
    at = reader.at[opened[0]]
    broken[at + 14] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.Reader(bytes(broken)).documents())


def test_query_digests(spark):
    from conftest import SF_DIR

    from millrace.llm.queries import QUERIES

    rows = QUERIES["op5_token_files"](spark, SF_DIR)
    assert rows.agg(F.sum("n_tokens")).first()[0] == QUERIES["op10_token_counts"](spark, SF_DIR).agg(F.sum("n_tokens") + F.count("*")).first()[0]
    same = QUERIES["op4_byte_bpe"](spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "doc_id")
    assert same.filter(F.col("decoded_sha256") != F.sha2("text", 256)).count() == 0
