"""Null ids, and extra columns named as those that operators use inside."""

import public_tokenizers
from lexgrove.llm import clustering, language_id, packing, privacy, simhash, token_counts
from lexgrove.llm.queries import PIECES, WORD_BPE

TEXTS = ["mail ann@example.org or +1 202 555 0147", "tora kami sura", None, "", "mail ann@example.org again", "plost grund"]


def clashing(spark, *names):
    """The same documents without and with columns of those names; one has no id, one is repeated."""
    rows = [(i if i != 1 else None, t, "aa" if i % 2 else "bb") for i, t in enumerate(TEXTS)]
    rows.append(rows[0])
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    extra = ", ".join(f"{n} string" for n in names)
    return plain, spark.createDataFrame([(*r, *("zz" for _ in names)) for r in rows], f"doc_id long, text string, lang string, {extra}")


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) != []


def test_privacy(spark):
    plain, odd = clashing(spark, "row", "own", "base", "spans", "term", "entity", "kind", "n")
    same(privacy.digest(privacy.find_spans(plain)), privacy.digest(privacy.find_spans(odd)))
    out = privacy.sanitise(odd)
    assert out.columns == odd.columns and out.where("text like '%ann@%'").count() == 0 and out.where("own = 'zz' and base = 'zz' and row = 'zz'").count() == 7
    same(privacy.sanitise(plain), out.select(*plain.columns))


def test_packing(spark):
    plain, odd = clashing(spark, "part", "length", "n_tokens", "bucket", "batch", "place", "count")
    path = public_tokenizers.path(WORD_BPE)
    a, b = packing.pack_documents(plain, path), packing.pack_documents(odd, path)
    same(a, b)
    assert {r.doc_id for r in a.collect()} == {None, 0, 2, 3, 4, 5}


def test_token_counts_without_an_id(spark):
    plain, odd = clashing(spark, "piece", "n", "count", "code", "part")
    path = public_tokenizers.path(PIECES)
    same(token_counts.count_tokens(plain, path), token_counts.count_tokens(odd, path))
    found = token_counts.count_tokens(plain, path).collect()
    assert len(found) == 7 and sum(r.doc_id is None for r in found) == 1


def test_language_without_an_id(spark):
    plain, odd = clashing(spark, "lang_pred", "score", "accepted", "code")
    model = language_id.train(plain, buckets=1 << 10)
    found = language_id.identify(odd, model)
    assert found.where("doc_id is null").count() == 1 and found.where("doc_id is null").first().lang_pred in ("aa", "bb")
    a = sorted((str(r.doc_id), r.lang_pred, r.score) for r in language_id.identify(plain, model).collect())
    assert a == sorted((str(r.doc_id), r.lang_pred, r.score) for r in found.collect())
    assert language_id.keep_accepted(odd, model).columns == odd.columns


def test_simhash_and_clustering(spark):
    plain, odd = clashing(spark, "code", "least", "label", "bucket", "choices", "codes", "a", "b", "fingerprint", "component_id")
    same(simhash.near_duplicates(plain), simhash.near_duplicates(odd))
    vectors = spark.createDataFrame([(i % 3 or None, [float(i), 1.0], "zz", "zz") for i in range(9)], "vec_id long, embedding array<double>, weight string, drawn string")
    a, _ = clustering.cluster(vectors, k=3, dim=2)
    b, _ = clustering.cluster(vectors.select("vec_id", "embedding"), k=3, dim=2)
    same(a, b)
