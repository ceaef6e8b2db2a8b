import random
import zlib

import numpy as np
import pytest
from lexweave.llm import bpe, packing, queries, sharding

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, shard string"
ODD = [
    (3, "a b", "x"), (3, "a b", "x"), (None, "née " * 50, "x"), (1, None, None), (2, "", "y"), (9, "z" * 5000, None), (4, "x", "y"), (5, "İ Σας ΣΑΣ <|endoftext|>don't    oḱ 12 中文 🙂!", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def test_shards_are_balanced_contiguous_and_gapless(spark):
    rows = queries.op2_sharding(spark, SF).orderBy("doc_id").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    total, before, slots = sum(r.size for r in rows), 0, {}
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
        assert r.shard == min(39, (2 * before + r.size) * 40 // (2 * total))
        assert r.slot == slots.get(r.shard, 0)
        slots[r.shard] = r.slot + 1
        before += r.size


def test_shards_of_odd_rows(spark, odd):
    out = sharding.shard_by_bytes(odd, shards=3).collect()
    assert len(out) == len(ODD) and {r.shard for r in out} <= {0, 1, 2}
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sharding.shard_by_bytes(odd.limit(0)).count() == 0


def pieces_hold(rows, ids_of, window=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, parts in by_doc.items():
        ids, at = ids_of[doc], 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(by_sequence)


def test_packing_against_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.token_file("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs}
    n = pieces_hold(queries.op6_packing(spark, SF).collect(), ids)
    assert n <= 1.05 * sum(map(len, ids.values())) / 2048 + 1


def test_packing_of_odd_rows(spark, odd):
    path = queries.token_file("byte_bpe_50k.json")
    rows = packing.pack(odd.dropDuplicates(), path, window=16, limit=2).collect()
    spread = {}
    for r in sorted(rows, key=lambda r: r.start):
        spread.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    encode = packing.encoder(path)
    assert spread == {d: [*encode(t or ""), 1] for d, t, _ in ODD}
    assert packing.pack(odd.limit(0), path).count() == 0
    assert packing.pack(odd, path).count() == len(ODD) + 1  # one text of two windows


def test_open_windows_stay_bounded():
    windows, seen = packing.OpenWindows(100, 3), {}
    random.seed(1)
    for _ in range(2000):
        n = random.randint(1, 100)
        number, offset = windows.place(n)
        assert offset == seen.get(number, 0) and offset + n <= 100 and len(windows.rooms) <= 3
        seen[number] = offset + n


def same_as_library(texts):
    from tokenizers import Tokenizer

    path = queries.token_file("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.word_bpe(path)
    library.no_padding()
    library.no_truncation()
    for text in texts:
        ids = own.encode(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text[:200]
        assert own.decode(ids).decode() == library.decode(want, skip_special_tokens=False), text[:200]


def test_bpe_against_the_library(spark):
    same_as_library([r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()])


def test_bpe_on_random_and_odd_words():
    random.seed(7)
    letters = ["a", "e", "t", "th", "ing", "s", "é", "ß", "中", "0", "'", "'s", " ", "!", "Ω", "Σ", "́", "\n", "aa", "</w>", "<", "w", "🙂", "\x1c", "\x85", "﻿", "\0"]
    same_as_library(["".join(random.choices(letters, k=random.randint(0, 60))) for _ in range(4000)])
    same_as_library([t or "" for _, t, _ in ODD] + ["a" * 4000, "<|startoftext|>", "x<|endoftext|><|endoftext|>y <|ENDOFTEXT|>"])


def test_bpe_of_odd_rows(spark, odd):
    path = queries.token_file("word_bpe_49k.json")
    rows = bpe.decode_ids(bpe.encode_texts(odd, path), path).collect()
    assert len(rows) == len(ODD)
    assert {(r.n_tokens, bytes(r.ids), r.decoded) for r in rows if r.doc_id in (1, 2)} == {(0, b"", "")}
    assert bpe.encode_texts(odd.limit(0), path).count() == 0
