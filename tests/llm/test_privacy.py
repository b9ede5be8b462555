import hashlib
import math
import random
import re

from lexgrove.llm import privacy

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    text = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        odd = [int(x) for x in d[::-1]]
        total = sum(odd[::2]) + sum(sum(divmod(2 * x, 10)) for x in odd[1::2])
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


FIXED = ["a@b.c@d.e", "x.y+z@mail-1.example.com.", "a@b", "@b.c a@@b.cc", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.255", "4111 1111 1111 1111", "4111-1111-1111-1111-", "+1 (683) 555-0123 x", "+12345678901234567", "+1.2.3.4.5.6.7.8", "4234545145184556", "0001.02.3.4", "é@x.y", None, "", "a" * 3000 + "@b", "1" * 5000, "ü a.b@c.d ü"]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    texts = FIXED + ["".join(rng.choice("ab1204.@-+ ()%_é") for _ in range(rng.randrange(80))) for _ in range(6000)]
    texts += ["".join(rng.choice(["1", "4", " ", "-", "12", "+", "3.", "255"]) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for t in texts:
        assert privacy.base_spans(t) == plain(t), t


def test_digest_and_odd_rows(spark, docs, empty):
    frame = spark.createDataFrame([(i, t, "k", [1]) for i, t in enumerate(FIXED * 2)], "doc_id long, text string, kind string, base array<int>").repartition(3)
    got = {r.doc_id: r for r in privacy.digest(privacy.find_spans(frame)).collect()}
    for i, t in enumerate(FIXED * 2):
        own = plain(t)
        spelled = ",".join(f"{k}:{s}:{e}" for k, s, e in own)
        assert [got[i][f"n_{k}"] for k in privacy.KINDS] == [sum(x[0] == k for x in own) for k in privacy.KINDS]
        assert got[i].base_sha256 == hashlib.sha256(spelled.encode()).hexdigest()
        assert got[i].spans.startswith(spelled)
    assert privacy.digest(privacy.find_spans(empty)).count() == 0
    assert privacy.sanitise(empty).columns == empty.columns
    clean = privacy.sanitise(docs)
    assert clean.schema == docs.schema and sorted(map(str, clean.collect())) == sorted(map(str, docs.collect()))


def test_terms_that_disclose_an_entity_are_found(spark):
    rng = random.Random(3)
    word = lambda: "w" + str(rng.randrange(3000))
    filler = lambda n: " ".join(word() for _ in range(n))
    texts = [f"{filler(20)} Writes Zanzibor, at zed@host.example.org the {filler(20)}" for _ in range(6)]
    texts += [f"{filler(10)} the at writes {filler(10)}" for _ in range(200)]
    texts += ["rareword beside solo@host.example.org once " + filler(5)] * 5  # copies are one context
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in privacy.find_spans(frame).collect()}
    for i in range(6):
        found = {texts[i][t.start : t.stop]: t.removed for t in got[i].terms}
        assert found == {"Zanzibor": True}
    assert all(not r.terms for k, r in got.items() if k >= 6)
    cleaned = {r.doc_id: r.text for r in privacy.sanitise(frame).collect()}
    assert all("zed@" not in cleaned[i] and "[EMAIL]" in cleaned[i] and "Zanzibor" not in cleaned[i] and "Writes ," in cleaned[i] for i in range(6))
    assert cleaned[10] == texts[10]


def test_terms_far_from_the_entity_are_found_wherever_they_stand(spark):
    rng = random.Random(8)
    filler = lambda n: " ".join("w" + str(rng.randrange(10**7)) for _ in range(n))
    texts = [f"By Žanzibor. {filler(30)} İ zed@host.example.org {filler(30)} (ŽANZIBOR) 漢 {filler(3)}" for _ in range(4)]
    texts += [f"{filler(10)} 漢 İ by {filler(10)}" for _ in range(100)]
    texts += [f"{filler(3)} once@host.example.org {filler(3)}"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in privacy.find_spans(frame).collect()}
    for i, t in enumerate(texts):
        assert [t[x.start : x.stop] for x in got[i].terms] == (["Žanzibor", "ŽANZIBOR"] if i < 4 else [])


def test_rows_without_an_id_are_sanitised(spark):
    texts = [f"row{k} Zanzibor {k * 7} zed@host.example.org w{k}" for k in range(4)] + [f"clean w{k}" for k in range(150)]
    texts += texts[:2]
    frame = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(3)
    want = [t.replace("Zanzibor", "").replace("zed@host.example.org", "[EMAIL]") for t in texts]
    assert sorted(r.text for r in privacy.sanitise(frame).collect()) == sorted(want)
    assert sum(len(r.terms) for r in privacy.find_spans(frame).collect()) == 6


def test_redaction_of_overlaps():
    assert privacy.redact("ab cd ef", [("ip", 0, 5), ("card", 3, 8)], []) == "[IP]"
    assert privacy.redact("ab c1 ef", [], [(3, 5, False)]) == "ab [NUMBER] ef"
    assert privacy.redact("ab cd ef", [], [(3, 5, False)]) == "ab [TERM] ef"
    assert privacy.redact(None, [], []) is None


def plain_terms(texts, support=3, generalise=0.8, remove=0.95, chance=0.05):
    """PMI by counting everything."""
    words = [[(m.start() + len(w) - len(w.lstrip(privacy.EDGE)), w.strip(privacy.EDGE)) for m in re.finditer(r"[^ \t-\r]+", t or "") for w in [m[0]]] for t in texts]
    words = [[(s, s + len(w), w.lower()) for s, w in own if w] for own in words]
    base = [plain(t) for t in texts]
    free = [[x for x in own if all(x[1] <= s or x[0] >= e for _, s, e in b)] for own, b in zip(words, base, strict=True)]
    name = lambda t, x: (x[0], t[x[1] : x[2]].lower() if x[0] in ("email", "ip") else re.sub("[^0-9]", "", t[x[1] : x[2]]))
    entities = [{name(t, x) for x in b} for t, b in zip(texts, base, strict=True)]
    n, pairs = len(texts), {}
    for e in set().union(*entities):
        rows = [i for i in range(n) if e in entities[i]]
        if len({texts[i] for i in rows}) >= support:
            for i in rows:
                for w in {w for _, _, w in free[i]}:
                    pairs.setdefault((e, w), []).append(i)
    risky = {}
    for (e, w), rows in pairs.items():
        different, n_entity = len({texts[i] for i in rows}), sum(e in x for x in entities)
        pmi = math.log2(n * len(rows) / (sum(any(w == x for _, _, x in own) for own in words) * n_entity))
        ic, nats = math.log2(n / n_entity), pmi * math.log(2)
        if different >= support and ic > 0 and pmi / ic >= generalise and different * (nats - 1 + math.exp(-nats)) >= math.log(len(pairs) / chance):
            risky[e, w] = pmi / ic >= remove
    return [sorted({(s, e): any(risky.get((x, w), False) for x in own) for s, e, w in f if any((x, w) in risky for x in own)}.items()) for f, own in zip(free, entities, strict=True)]


def test_terms_equal_pmi_by_plain_counting(spark):
    rng = random.Random(4)
    names = [f"Name{k}," for k in range(6)]
    found = 0
    for seed in range(3):
        texts = [None, "", "x"] * 2
        for _ in range(260):
            w = [rng.choice(["the", "of", f"w{rng.randrange(4000)}", f"v{rng.randrange(40)}"]) for _ in range(rng.randrange(2, 30))]
            for k in range(6):
                if rng.random() < 0.04:
                    w.insert(rng.randrange(len(w)), f"u{k}@host.example.org")
                    if rng.random() < 0.97:
                        w.insert(rng.randrange(len(w)), names[k] if rng.random() < 0.7 else names[k].upper())
                elif rng.random() < 0.003 * seed:
                    w.append(names[k])
            texts.append(" ".join(w))
        texts += rng.choices(texts[6:], k=20)
        frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
        got = {r.doc_id: [((x.start, x.stop), x.removed) for x in r.terms] for r in privacy.find_spans(frame).collect()}
        want = plain_terms(texts)
        assert [got[i] for i in range(len(texts))] == want
        found += sum(map(len, want))
    assert found > 100
