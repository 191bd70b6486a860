"""Packing against the library, with every odd case."""

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from masklake.llm import packing, wordbpe


@pytest.fixture(scope="module")
def spec():
    import public_tokenizers
    return open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()


def ids_of(words, text):
    return words.library.encode(text, add_special_tokens=False).ids


def encoded(words, texts):
    ids, bounds = words.encode(texts)
    return [ids[bounds[r]:bounds[r + 1]].tolist() for r in range(len(texts))]


def test_every_code_point_is_classed_like_the_library(spec):
    words = wordbpe.WordBpe(spec)
    texts = [f"a{c}B1{c}{c}! {c} x'S{c} '{c}re{c}" for low, high in wordbpe.LATIN for c in map(chr, range(low, high + 1))]
    assert encoded(words, texts) == [ids_of(words, t) for t in texts]


def test_random_texts_merge_like_the_library(spec, monkeypatch):
    rng = random.Random(4)
    alphabet = "aabcdefgstmdrvlei'''   \n\t12²!?-_éÉßñĀ€漢😀İ\x85\x1c\x00"
    monkeypatch.setattr(wordbpe, "STRETCH", 90)
    monkeypatch.setattr(wordbpe, "MEMO", 300)
    words = wordbpe.WordBpe(spec)
    for n in range(200):
        part = alphabet if n % 2 else alphabet[:38]
        texts = ["".join(rng.choice(part) for _ in range(rng.choice([0, 3, 40, 300]))) for _ in range(rng.randint(0, 8))]
        texts += ["x" * 200, "it's WE'RE they'LL''s '", "a <|endoftext|>b", "<|ENDOFTEXT|>"][:n % 5]
        assert encoded(words, texts) == [ids_of(words, t) for t in texts]


def test_other_tokenizers_are_refused(spec):
    import public_tokenizers
    with pytest.raises(ValueError):
        wordbpe.WordBpe(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())


def test_binary_lengths():
    for n in range(1, 300):
        cut = packing.binary_lengths(n, 64)
        assert sum(cut) == n and cut == sorted(cut, reverse=True) and all(k & (k - 1) == 0 and k <= 64 for k in cut)
        assert len(set(k for k in cut if k < 64)) == sum(k < 64 for k in cut)


@pytest.mark.parametrize("most", [4096, 16])
def test_pack(spark, spec, tmp_path, most):
    import public_tokenizers
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(["Plain", "wörds", "don't", "x2", "<|endoftext|>", "日本", "zzyzx"]) for _ in range(n))
    rows = [(1, None), (2, ""), (3, " \n"), (4, prose(20_000)), (5, "y" * 30_000), (None, prose(7)), (None, "a"), (6, prose(50)), (6, prose(50))]
    rows += [(7, "same text")] * 3 + [(k, prose(rng.randint(0, 400))) for k in range(10, 60)]
    schema = "doc_id bigint, text string, start string, ids string, bucket int, offset int"
    df = spark.createDataFrame([(*r, "s", "i", 9, 9) for r in rows], schema).repartition(4)
    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.pack(df, path, most)
    got = out.collect()
    assert out.schema["sequence_id"].dataType.simpleString() == "bigint" and len({r.sequence_id for r in got}) == len(got)
    assert all(r.length & (r.length - 1) == 0 and 1 << r.bucket == r.length <= most and r.offset == 0 and len(r.ids) == 4 * r.length for r in got)
    by_bucket = sorted(got, key=lambda r: r.sequence_id)
    assert [r.bucket for r in by_bucket] == sorted(r.bucket for r in got)
    parts = defaultdict(list)
    for r in got:
        parts[r.sequence_id & (1 << 58) - 1].append(r)
    words, want, have = wordbpe.WordBpe(spec), [], []
    for i, t in rows:
        ids = ids_of(words, t or "") + [2]
        at = 0
        for n in packing.binary_lengths(len(ids), most):
            want.append((i, at, n, len(ids), b"".join(x.to_bytes(4, "little") for x in ids[at:at + n])))
            at += n
    have = [(r.doc_id, r.start, r.length, r.doc_tokens, bytes(r.ids)) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    crcs = sorted((r.doc_id or -1, r.start, r.ids_crc32) for r in packing.report(out).collect())
    assert crcs == sorted((i or -1, a, zlib.crc32(b)) for i, a, _, _, b in want)
    packing.write_buckets(out, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(got) and back.where(F.expr("length != 1 << bucket")).count() == 0
    assert packing.pack(df.limit(0), path).count() == 0
