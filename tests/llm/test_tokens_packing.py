import random
import zlib
from functools import cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from rillmark.llm import content_store, packing, storage
from rillmark.llm.tokens import BYTE_BPE, WORD_BPE, PieceEncoder, vocabulary_path

ODD = [
    None, "", " ", "a", "  two  blanks ", "don't they'll'S I'M", "tab\tnew\nline\r\n\n  x", "café CAFÉ naïve étude ≠ x",
    "ªº µ x²y Ⅷ 12a34 3.14,-- ...'s", "日本語 テキスト mixed日本", "nb\xa0sp  wide　 \x85 z\x1cq", "<|endoftext|> <|startoftext|>", "a" * 3000, "!!" * 700, "0x3F::'tis '", "​zero ﬁ ǅ İ Σς ẞ",
]


@cache
def library(name):
    out = Tokenizer.from_file(vocabulary_path(name))
    out.encode_special_tokens = True
    return out


def whole(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_pieces_give_the_library_ids(name):
    mine = PieceEncoder(vocabulary_path(name))
    rng = random.Random(4)
    alphabet = "abEé'’ \n\t.,!-_09²ªß日́\xa0\x1c　s t re"
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(mine.id_bytes(text), "<u4").tolist() == whole(name, text), repr(text)


def frame(spark, texts):
    rows = [(None if i == 3 else i, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string")


def test_store_round_trip(spark):
    texts = ODD + [ODD[5]] * 4 + [" ".join(f"w{i % 911} of" for i in range(4000))] * 3
    docs = frame(spark, texts).union(frame(spark, [texts[7]]))
    path = storage.new_path(spark, "test")
    content_store.write_store(docs, path, parts=3)
    back = {}
    for r in content_store.reconstruct(spark, path).collect():
        back.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    digests = content_store.document_digests(spark, path).collect()
    assert len(digests) == len(texts) + 1 and len(back[0]) == 2
    streams = {}
    for i, t in enumerate(texts):
        streams.setdefault(None if i == 3 else i, []).append([*whole(WORD_BPE, t), 1])
    streams[0].append([*whole(WORD_BPE, texts[7]), 1])
    for k, v in streams.items():
        assert sorted(ids for _, ids in back[k]) == sorted(v)
    at = 0
    for r in sorted(digests, key=lambda r: r["start"]):
        ids = dict(back[r["doc_id"]])[r["start"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)
    chunks = content_store.read_chunks(spark, path)
    assert chunks.count() == chunks.select("digest").distinct().count() < sum(r["n_chunks"] for r in digests)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in digests) == [(r["doc_id"] is not None, r["doc_id"] or 0) for r in sorted(digests, key=lambda r: r["start"])]


def test_store_detects_damage(spark):
    path = storage.new_path(spark, "test")
    content_store.write_store(frame(spark, ["one two three", "four"]), f"{path}")
    chunks = content_store.read_chunks(spark, path).collect()
    bad = spark.createDataFrame([(c["digest"], c["n_ids"], c["payload"][:-1] + b"\x07") for c in chunks], "digest binary, n_ids int, payload binary")
    storage.drop_table(spark, f"{path}/chunks")
    bad.write.parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="damaged"):
        content_store.document_digests(spark, path).collect()


def test_empty_tables(spark):
    docs = frame(spark, []).limit(0)
    path = storage.new_path(spark, "test")
    content_store.write_store(docs, path)
    assert content_store.document_digests(spark, path).count() == 0
    assert packing.pack_documents(docs).count() == 0


def one_by_one(lengths, capacity):
    """Best fit decreasing as it is usually written."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room[room.index(min(fits))] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


@pytest.mark.parametrize("seed", range(12))
def test_runs_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 100])
    lengths = [min(capacity, int(rng.paretovariate(0.7)) + rng.randrange(5)) or 1 for _ in range(400)] + [rng.randrange(1, capacity + 1)] * 60
    histogram = {n: lengths.count(n) for n in set(lengths)}
    runs, bins = packing.best_fit_decreasing(histogram, capacity)
    fill, ranks = {}, {}
    for length, first, count, each, bin_, at in runs:
        assert ranks.setdefault(length, 0) == first
        ranks[length] += count
        for j in range(count):
            spot = fill.setdefault(bin_ + j // each, [])
            assert at + j % each * length == sum(spot)
            spot.append(length)
    assert ranks == histogram and sorted(fill) == list(range(bins))
    assert sorted(capacity - sum(v) for v in fill.values()) == one_by_one(lengths, capacity)


def test_packed_documents(spark):
    texts = ODD + ["word " * n for n in (1500, 1023, 1024, 300, 300, 300, 2)] + [None] * 5
    rows = packing.pack_documents(frame(spark, texts)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spots in by.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 1024
    lengths = [n for t in texts for n in packing.cut_lengths(len(whole(BYTE_BPE, t)) + 1)]
    assert sorted(lengths) == sorted(r["length"] for r in rows)
    assert len(by) == len(one_by_one(lengths, 1024))
    long = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == len(ODD))
    ids, at = [*whole(BYTE_BPE, texts[len(ODD)]), 2], 0
    for i, n in enumerate(packing.cut_lengths(len(ids))):
        assert long[i] == (i, at, n, zlib.crc32(np.asarray(ids[at : at + n], "<u4").tobytes()))
        at += n


def test_streams_cut_together_are_cut_alike():
    rng = np.random.default_rng(5)
    streams = [rng.integers(0, 9000, n).astype("<u4") for n in (1, 5, 127, 128, 129, 600, 20_000, 1, 3000)]
    streams += [np.full(9000, 7, "<u4"), np.tile(rng.integers(0, 99, 700).astype("<u4"), 9)]
    assert content_store.cut_together(streams) == [content_store.cut_points(s) for s in streams] and content_store.cut_together([]) == []


def test_a_missing_chunk_is_an_error(spark, tmp_path):
    words = [f"w{i}" for i in range(9000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "short"), (3, None)], "doc_id long, text string")
    path = f"file://{tmp_path}/store"
    content_store.write_store(docs, path)
    assert {r["doc_id"] for r in content_store.reconstruct(spark, path).collect()} == {1, 2, 3}
    chunks = spark.read.parquet(f"{path}/chunks").orderBy("n_ids").collect()
    kept = spark.createDataFrame(chunks[1:], spark.read.parquet(f"{path}/chunks").schema)
    kept.write.mode("overwrite").parquet(f"{path}/chunks2")
    storage.drop_table(spark, f"{path}/chunks")
    spark.read.parquet(f"{path}/chunks2").write.parquet(f"{path}/chunks")
    for read in (content_store.reconstruct, content_store.document_digests):
        with pytest.raises(Exception, match="missing|not stored|differs"):
            read(spark, path).collect()
