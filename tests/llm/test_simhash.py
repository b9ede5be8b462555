"""SimHash fingerprints and links beside plain versions."""

import random

import numpy as np
import pytest
import xxhash
from lexgrove.llm import simhash


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    n = len(words) - 2
    shingles = [" ".join(words[i : i + 3]) for i in range(n)] if n > 0 else [" ".join(words)] if words else []
    codes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes)) if codes else 0


def plain_components(rows, bits=2):
    """rows: (id, fingerprint). The least id of each row's component."""
    codes = sorted({f for i, f in rows if i is not None})
    up = {c: c for c in codes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= bits:
                up[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return [None if i is None else least[find(f)] for i, f in rows]


def test_documents(spark, texts, docs, empty):
    rng = random.Random(2)
    own = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    near = []
    for i in range(40):
        words = list(base)
        words[rng.randrange(600)] = f"x{i}"
        near.append((5000 + i, " ".join(words)))
    rows = own + near + [(None, near[0][1]), (None, None), (7000, near[1][1]), (7000, near[1][1])]
    frame = spark.createDataFrame([(t, i, 1, b"x", "y") for i, t in rows], "text string, doc_id long, code int, label binary, least string").repartition(4)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame).collect()), key=str)
    codes = [(i, plain_fingerprint(t)) for i, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(codes, plain_components(codes), strict=True)), key=str)
    assert got == want and len({c for i, _, c in got if i and 5000 <= i < 5040}) < 40
    assert simhash.near_duplicates(empty).count() == 0


def test_long_texts_are_counted_in_chunks(monkeypatch):
    text = " ".join(str(i % 977) for i in range(3000))
    want = plain_fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text.encode()) == want == plain_fingerprint(text)


@pytest.mark.parametrize("bits", [1, 2])
@pytest.mark.parametrize("short", [64, 2])
def test_links_of_clusters(spark, monkeypatch, bits, short):
    """Chains, balls and crowded postings: the components are those of all pairs."""
    import pyarrow as pa

    monkeypatch.setattr(simhash, "SHORT", short)
    rng = random.Random(bits)
    codes = {0, (1 << 64) - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            codes.add(x)
            for _ in range(rng.choice([1, 2, 3])):
                x ^= 1 << rng.choice([rng.randrange(64), rng.randrange(8), 63 - rng.randrange(8)])
    codes = sorted(codes)
    batch = pa.RecordBatch.from_arrays([pa.array(np.array(codes, np.uint64).view(np.int64))], ["code"])
    (posted,) = simhash._post([batch], bits, 3)
    edges = []
    for bucket in range(posted.num_rows):
        found = simhash._links(pa.Table.from_batches([posted.slice(bucket, 1)]), bits)
        edges += zip(found["a"].to_numpy().view(np.uint64).tolist(), found["b"].to_numpy().view(np.uint64).tolist(), strict=True)
    assert all((a ^ b).bit_count() <= bits * 20 for a, b in edges)
    up = {c: c for c in codes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    want = plain_components(list(enumerate(codes)), bits)
    groups = {}
    for c, w in zip(codes, want, strict=True):
        groups.setdefault(w, set()).add(find(c))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
    assert len(edges) <= len(codes) * len(simhash.choices(bits))


def test_each_link_is_taken_in_one_posting():
    rng = random.Random(9)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for _ in range(rng.choice([1, 2, 2])):
            b ^= 1 << rng.randrange(64)
        if a != b:
            both = np.array([a, b], np.uint64)
            taken = sum(bool(simhash.linked(both, np.array([0]), np.array([1]), out, 2)[0]) for out in simhash.choices(2) if (a ^ b) & int(simhash._mask(out)) == 0)
            assert taken == 1
