import random
import re

import pyarrow as pa
import pytest
from lexgrove.llm import arrow_text, substring_dedup, suffix_dedup
from lexgrove.llm.suffix_dedup import leads


def brute(tokens, ids, window):
    """Which tokens of each document a window covers that also starts in a document with a smaller id."""
    first = {}
    for i, t in zip(ids, tokens, strict=True):
        for k in range(len(t) - window + 1) if i is not None else ():
            w = tuple(t[k : k + window])
            first[w] = min(first.get(w, i), i)
    for i, t in zip(ids, tokens, strict=True):
        gone = [False] * len(t)
        for k in range(len(t) - window + 1) if i is not None else ():
            if first[tuple(t[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        yield gone


def spans(gone):
    text = "".join("x" if g else "." for g in gone)
    return [m.span() for m in re.finditer("x+", text)]


def corpus(rng, n):
    """Texts that share passages, with exact and near copies, one line in many texts, and repeats within a text."""
    word = lambda: rng.choice(["a", "bb", "ccc", "é", "dd.", "漢字"]) + str(rng.randrange(40))
    passage = lambda k: " ".join(word() for _ in range(k))
    common = [passage(rng.randrange(3, 30)) for _ in range(6)]
    texts = [None, "", " ", "x", "ab" * 200, "ab" * 150, "c" * 300, "c" * 49, "c" * 50, "y y " * 60, "y y " * 70]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.2 and len(texts) > 20:
            texts.append(rng.choice(texts))
        elif kind < 0.4 and len(texts) > 20:
            t = (rng.choice(texts) or "z").split(" ")
            t[rng.randrange(len(t))] = word()
            texts.append("  ".join(t))
        else:
            texts.append("\n".join(rng.choice([passage(rng.randrange(1, 12)), rng.choice(common)]) for _ in range(rng.randrange(1, 9))))
    return texts


@pytest.mark.parametrize(("seed", "window", "stretch"), [(1, 12, 1 << 20), (2, 5, 4000), (3, 12, 500), (4, 50, 4000)])
def test_words_equal_brute_force(spark, seed, window, stretch):
    rng = random.Random(seed)
    texts = corpus(rng, 150)
    ids = rng.sample(range(-50, 10**6), len(texts))
    ids[30] = ids[31]
    ids[40] = None
    ids, texts = ids + ids[20:26] + [None], texts + texts[20:26] + texts[40:41]
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    frame = spark.createDataFrame([(i, t, "k", [1]) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, text_key string, spans array<int>").repartition(4)
    got = substring_dedup.remove_repeats(frame, window=window, stretch=stretch).collect()
    want = [(str(i), len(t), str(spans(g)), " ".join(w for w, x in zip(t, g, strict=True) if not x)) for i, t, g in zip(ids, tokens, brute(tokens, ids, window), strict=True)]
    assert sorted((str(r.doc_id), r.n_words, str([(s.begin, s.end) for s in r.spans]), r.kept) for r in got) == sorted(want)


@pytest.mark.parametrize(("seed", "threshold", "stretch", "hot"), [(1, 50, 1 << 20, 64), (2, 20, 3000, 1), (3, 50, 700, 2), (4, 9, 2000, 1), (5, 3, 800, 64)])
def test_bytes_equal_brute_force(spark, seed, threshold, stretch, hot):
    rng = random.Random(seed)
    texts = corpus(rng, 110)
    ids = rng.sample(range(-50, 10**6), len(texts))
    ids[30] = ids[31]
    ids[40] = None
    ids, texts = ids + ids[20:26] + [None], texts + texts[20:26] + texts[40:41]
    tokens = [(t or "").encode() for t in texts]
    frame = spark.createDataFrame([(i, t, "k", [1]) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, text_key string, spans array<int>").repartition(4)
    got = suffix_dedup.remove_repeats(frame, threshold=threshold, stretch=stretch, hot=hot).collect()
    want = [(str(i), len(t), str(spans(g)), bytes(b for b, x in zip(t, g, strict=True) if not x)) for i, t, g in zip(ids, tokens, brute(tokens, ids, threshold), strict=True)]
    assert sorted((str(r.doc_id), r.n_bytes, str([(s.begin, s.end) for s in r.spans]), bytes(r.kept)) for r in got) == sorted(want)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_codes_tell_patterned_words_apart(spark):
    """A polynomial modulo a power of two has one code for these two words."""
    one = thue_morse(1 << 12)
    other = one.translate(str.maketrans("ab", "ba"))
    for n in (8, 64, 65, 1024, 1 << 12):
        raw, offsets = arrow_text.flat(pa.array([one[:n], other[:n]]))
        assert len(set(arrow_text.word_codes(raw, offsets[:-1], offsets[1:]).tolist())) == 2
        assert len(set(arrow_text.ByteRuns(raw).codes(offsets[:-1], offsets[1:]).tolist())) == 2
    tail = " ".join(f"w{k}" for k in range(60))
    words = lambda t: " ".join(t[:1024])
    texts = [one, other, f"{one[:1024]} {tail}", f"{other[:1024]} {tail}", words(one), words(other), one[:1024]]
    tokens = [t.split(" ") for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.begin, s.end) for s in r.spans] for r in substring_dedup.remove_repeats(frame, window=20).collect()}
    assert [got[i] for i in range(len(texts))] == [spans(g) for g in brute(tokens, range(len(texts)), 20)]


def test_nothing(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_leads_and_codes():
    rng = random.Random(1)
    text = bytes(rng.choice(b"ab") for _ in range(400))
    raw, _ = arrow_text.flat(pa.array([text.decode()]))
    codes = arrow_text.ByteRuns(raw).rolling(3)
    for width in (1, 2, 3, 7, 26):
        got = leads(codes, width)
        assert len(got) == len(codes) - width + 1
        for i in range(len(got)):
            own = [int(c) >> 31 for c in codes[i : i + width]]
            assert got[i] == i + own.index(min(own))
    assert len({int(c) for c in codes}) == len({text[i : i + 3] for i in range(398)})


def test_buckets_grow_before_they_are_many():
    from lexgrove.llm.repeats import BUCKET_BYTES, buckets_for

    gb = 1 << 30
    assert buckets_for(0) == 0 and buckets_for(gb // 2) == 64 and buckets_for(64 * gb) == buckets_for(512 * gb) == 8192
    assert buckets_for(8192 * gb) == 8192 * gb // (8 * BUCKET_BYTES) and all(buckets_for(x * gb) <= buckets_for((x + 9) * gb) for x in range(0, 9000, 9))
