import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from lexgrove.llm import packing, token_counts, token_files
from lexgrove.llm.encoding import Encoder
from lexgrove.llm.queries import PIECES, WORD_BPE

BPE = public_tokenizers.path(WORD_BPE)


def library_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_equals_the_library_on_whole_texts(texts):
    rng = random.Random(2)
    alphabet = list("aB'st dm<|>.,-9 0\té́̌JHΣσ漢ß \n") + ["'ll", "'re", "<|endoftext|>", "N'T "]
    more = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    both = [*texts, *more]
    encoder = Encoder(BPE, keep=300)
    expected = library_ids(both)
    for start in range(0, len(both), 100):
        part = pa.array(both[start : start + 100], pa.string())
        ids, ends = encoder.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == expected[start : start + 100]
        assert encoder.lengths(part).tolist() == [len(x) for x in expected[start : start + 100]]


def test_pieces_of_one_code_are_told_apart(texts, monkeypatch):
    from lexgrove.llm import arrow_text

    code = arrow_text.word_codes
    monkeypatch.setattr(arrow_text, "word_codes", lambda raw, starts, ends: code(raw, starts, ends) & arrow_text.U64(7))
    encoder = Encoder(BPE)
    for _ in range(2):
        ids, ends = encoder.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == library_ids(texts)


def test_rows_of_one_id_in_several_tasks(spark, tmp_path):
    rows = [(5, f"text {i}") for i in range(60)] + [(None, "none"), (1, "one"), (9, "nine")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = token_files.write_token_files(frame, f"file://{tmp_path}/t", BPE)
    got = sorted(token_files.read_documents(manifest, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, *[5] * 60, 9]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(np.array([*ids, 2], "<u4").tobytes()) for ids in library_ids([t for _, t in rows]))


def test_token_files_round_trip(spark, docs, texts, tmp_path):
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}/t", BPE, length=64)
    got = {r.doc_id: r for r in token_files.read_documents(manifest, f"file://{tmp_path}/t").collect()}
    start, stream = 0, []
    for i, ids in enumerate(library_ids(texts)):
        ids = [*ids, 2]
        r = got[i * 7 + 3]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start, stream = start + len(ids), stream + ids
    assert len(got) == len(texts)
    back = []
    for m in manifest.orderBy("part").collect():
        file = token_files.TokenFile(f"file://{tmp_path}/t", m.file)
        for i in range(m.n_sequences):
            ids, mask = file[i]
            assert len(ids) == len(mask) == 64
            back += ids[mask].tolist()
    assert back == stream


def test_token_files_of_nothing(empty, tmp_path):
    manifest = token_files.write_token_files(empty, f"file://{tmp_path}/t", BPE)
    assert manifest.count() == 0 and token_files.read_documents(manifest, f"file://{tmp_path}/t").count() == 0


def test_token_counts_equal_plain_dynamic_programming(docs, empty, texts):
    path = public_tokenizers.path(PIECES)
    unigram = token_counts.Unigram(token_counts.load_pieces(path))
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.count_tokens(docs, path).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert got[i * 7 + 3] == (len(words), sum(unigram.count_one("▁" + w) for w in words))
    assert token_counts.count_tokens(empty, path).count() == 0


def test_trie_on_random_words():
    rng = random.Random(3)
    unigram = token_counts.Unigram({p: -rng.random() * 5 for p in ["a", "b", "ab", "aba", "bb", "▁a", "▁", "c", "abcab"]})
    words = sorted({"".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 14))) for _ in range(500)}) + ["ab" * 300]
    assert unigram.count(words).tolist() == [unigram.count_one(w) for w in words]


def brute_padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= x) - x for x in lengths)


def test_bounds_are_optimal():
    from itertools import combinations

    rng = random.Random(4)
    for _ in range(30):
        lengths = [rng.randrange(1, 12) for _ in range(20)]
        values, counts = np.unique(lengths, return_counts=True)
        for k in (1, 2, 3, 20):
            bounds = packing.optimal_bounds(values, counts, k)
            best = min(brute_padding(lengths, [*c, max(lengths)]) for c in combinations(values.tolist(), min(k, len(values)) - 1))
            assert len(bounds) <= k and bounds[-1] == max(lengths)
            assert brute_padding(lengths, bounds) == best
    assert packing.optimal_bounds(np.array([]), np.array([]), 3) == []


def test_packing_keeps_every_token_within_the_budget(docs, empty, texts):
    rows = packing.pack_documents(docs, BPE, max_length=64, buckets=4, budget=256, shard_rows=10).collect()
    for i, ids in enumerate(library_ids(texts)):
        own = sorted((r.part, r.begin, r.length) for r in rows if r.doc_id == i * 7 + 3)
        n = len(ids) + 1
        assert own == [(k, k * 64, min(64, n - k * 64)) for k in range(-(-n // 64))]
    assert len({r.bucket for r in rows}) <= 4
    batches = {}
    for r in rows:
        assert r.length <= r.bucket
        batches.setdefault((r.bucket, r.shard, r.batch), []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) and len(v) * k[0] <= 256 for k, v in batches.items())
    assert packing.pack_documents(empty, BPE).count() == 0
