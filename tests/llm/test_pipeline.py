import random

import corpus_pipeline
import pytest
from lexgrove.llm import language_id, privacy
from test_decontamination import brute as brute_hits
from test_jaccard_join import brute as brute_components
from test_jaccard_join import shingles
from test_tokens import library_ids

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    en, de = "the of and that with from this have".split(), "der und nicht auch sich über größe straße".split()
    prose = lambda words, n: " ".join(rng.choice(words) + rng.choice(words)[:3] for _ in range(n))
    items = [prose(en, 25) for _ in range(3)]
    texts = [(prose(w, rng.randrange(20, 90)), lang) for _ in range(60) for w, lang in [rng.choice([(en, "en"), (de, "de")])]]
    texts += [(t, lang) for t, lang in texts[:10]] + [(t + " end", lang) for t, lang in texts[5:15]]
    texts += [(prose(en, 8) + " " + i + " " + prose(en, 8), "en") for i in items] + [(prose(en, 10) + f" mail{k}@host.org +1 (555) 010-200{k} " + prose(en, 9), "en") for k in range(4)]
    texts += [(None, "en"), ("", None), ("12 34 !!", "de"), ("... ---", None), (prose(en, 3), None)]
    rng.shuffle(texts)
    at = tmp_path_factory.mktemp("data")
    rows = [(i * 3 + 1, t, lang, "s", None if t is None else len(t)) for i, (t, lang) in enumerate(texts)]
    spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), items


def test_each_stage_against_a_plain_version(spark, folder):
    at, items = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    start = docs.collect()

    model = language_id.train(docs)
    accepted = {r.doc_id for r in language_id.identify(docs, model).collect() if r.accepted}
    kept = stages["language_id"](spark, docs, at).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in start if r.doc_id in accepted)
    assert all(r.text is not None and any(map(str.isalpha, r.text)) for r in kept) and len(kept) >= len(start) - 4 - 1

    rows = sorted({(r.doc_id, r.text) for r in kept})
    firsts = {i for i, _, c in brute_components(rows) if i == c}
    assert all(shingles(t) for _, t in rows)
    unique = stages["jaccard_join"](spark, spark.createDataFrame(kept, docs.schema), at).collect()
    assert sorted(r.doc_id for r in unique) == sorted(firsts)

    hits = {r.doc_id: h for r, (_, h, _) in zip(unique, brute_hits([r.text for r in unique], list(enumerate(items))), strict=True)}
    assert sum(h > 0 for h in hits.values()) == 3
    clean = stages["decontamination"](spark, spark.createDataFrame(unique, docs.schema), at).collect()
    assert sorted(r.doc_id for r in clean) == sorted(i for i, h in hits.items() if not h)

    frame = spark.createDataFrame(clean, docs.schema)
    private = stages["privacy"](spark, frame, at)
    assert private.columns == COLUMNS
    private = {r.doc_id: r for r in private.collect()}
    assert len(private) == len(clean)
    for r in clean:
        base = privacy.base_spans(r.text)
        assert private[r.doc_id].text == privacy.redact(r.text, base, [])
        assert private[r.doc_id].n_chars == len(private[r.doc_id].text)
    assert sum("[EMAIL]" in r.text for r in private.values()) == 4

    ordered = sorted(private)
    packed = stages["packing"](spark, spark.createDataFrame(list(private.values()), docs.schema), at).collect()
    assert sorted((r.doc_id, r.length) for r in packed) == [(i, len(ids) + 1) for i, ids in zip(ordered, library_ids([private[i].text for i in ordered]), strict=True)]
    whole = corpus_pipeline.run(spark, at).collect()
    assert sorted(map(str, whole)) == sorted(map(str, packed))


def test_stages_on_empty_and_odd_tables(spark, folder, empty, tmp_path):
    at, _ = folder
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, at).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "x y", None, None, None), (1, None, None, None, None), (1, None, None, None, None), (2, "", "en", None, 0)], empty.schema)
    for name, stage in corpus_pipeline.STAGES:
        n = stage(spark, odd, at).count()
        assert n == (1 if name == "language_id" else 5), name  # with one language known, a text with letters is of it
