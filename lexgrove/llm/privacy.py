"""Personal data: patterns, and information-theoretic sanitisation of the terms that give protected entities away.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers that patterns find (base spans). For
each entity c and each term t that stands in a document of c, the corpus gives probabilities over documents, which are
rows, and PMI(t; c) = log2 p(t, c) / (p(t) p(c)) says how many of the IC(c) = -log2 p(c) bits about c the term discloses.
Terms that disclose at least ``generalise`` of IC(c) are added as spans wherever they stand in a document that has c; in
sanitised text they are generalised to their shape (``[TERM]`` for words, ``[NUMBER]`` if they have digits), and from
``remove`` on they are removed. An estimate needs ``support`` different texts with the pair, so copies of one document
count once for it and a rare word that stands beside an address once is left alone. As whole documents have many terms,
some meet an entity often by chance: by Chernoff's bound of a Poisson variable, the odds of a pair's ``support`` texts are
at most exp(-support (PMI - 1 + exp(-PMI))), PMI in nats, and all pairs that were counted together may have at most
``chance`` such ones.

A term is a word without punctuation at its edges that no base span touches; it is compared in lower case.

How it runs: one scan finds base spans and entities, which are written to the shared folder with the texts that have any;
pairs of these texts are counted, of entities with enough texts only; p(t) comes from a second scan of all documents,
which emits only the terms in a bitmap of fixed size (1 MB) that is set from the candidate pairs; false positives of the
bitmap drop out in the join that follows. A scan of the texts with entities then emits the places of the pairs in another
bitmap, that of the disclosing pairs, for an exact join.

Null and empty texts have no spans. Repeated rows and rows without an id are each reported. Entities are compared in lower case, numbers by
their digits. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import arrow_text as at
from .shared_folder import written

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match always begins with its run of digits, so other places need not be tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
EDGE = ".,;:!?()[]{}<>\"'`"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Bits of the bitmap of candidate terms.
BITS = 23


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    found: list[tuple[str, int, int]] = []
    if not text:
        return found
    # an address has one @; its name is the run of name characters before it that no earlier address has taken
    done, at_sign = 0, text.find("@")
    while at_sign >= 0:
        start = at_sign
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at_sign and (m := DOMAIN.match(text, at_sign + 1)):
            found.append(("email", start, m.end()))
            done = m.end()
        at_sign = text.find("@", at_sign + 1)
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def _entity(text: str, span: tuple[str, int, int]) -> int:
    """A code of a base span's entity."""
    kind, start, end = span
    name = kind + ":" + (text[start:end].lower() if kind in ("email", "ip") else _digits(text[start:end]))
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


SPAN = "struct<kind: string, start: long, stop: long>"
TERMS = "array<struct<start: long, stop: long, removed: boolean>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    for batch in at.slices(batches, "text"):
        spans, entities, texts = [], [], []
        for text in batch.column("text").to_pylist():
            own = base_spans(text)
            spans.append([{"kind": k, "start": s, "stop": e} for k, s, e in own])
            entities.append(sorted({_entity(text, x) for x in own}))
            texts.append(text if own else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(spans, kind), pa.array(entities, pa.list_(pa.int64())), pa.array(texts, pa.string())], ["doc_id", "text_key", "base", "entities", "text"])


def _edges(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without punctuation at their edges."""
    edge = np.zeros(256, bool)
    edge[[ord(c) for c in EDGE]] = True
    starts, ends = starts.copy(), ends.copy()
    open_ = np.arange(len(starts))
    while len(open_ := open_[(starts[open_] < ends[open_])]) and len(open_ := open_[edge[raw[starts[open_]]]]):
        starts[open_] += 1
    open_ = np.arange(len(starts))
    while len(open_ := open_[(starts[open_] < ends[open_])]) and len(open_ := open_[edge[raw[ends[open_] - 1]]]):
        ends[open_] -= 1
    return starts, ends


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts, the terms' codes and their rows; bytes of the texts in lower case, and the terms' starts and ends there."""
    raw, offsets = at.flat(pa.compute.utf8_lower(column))
    starts, ends, first = at.word_bounds(raw, offsets, at.SPACE)
    starts, ends = _edges(raw, starts, ends)
    row = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    ok = ends > starts
    starts, ends, row = starts[ok], ends[ok], row[ok]
    return at.word_codes(raw, starts, ends), row, raw, starts, ends


def _places(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text, the codes of the terms that no base span touches, and their starts and ends in code points."""
    codes, row, raw, starts, ends = _words(batch.column("text"))
    # lower case keeps the number of code points, if not of bytes
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
    lengths = pa.compute.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False)
    begin = np.concatenate(([0], np.cumsum(lengths)))
    for i, spans in enumerate(batch.column("base").to_pylist()):
        own = slice(bounds[i], bounds[i + 1])
        a, b = points[starts[own]] - begin[i], points[ends[own]] - begin[i]
        touched = np.zeros(int(lengths[i]) + 1, np.int64)
        for x in spans:
            touched[x["start"]] += 1
            touched[x["stop"]] -= 1
        upto = np.concatenate(([0], np.cumsum(np.cumsum(touched) > 0)))
        free = upto[a] == upto[b]
        yield codes[own][free], a[free], b[free]


def _pair_codes(entity: int, terms: np.ndarray) -> np.ndarray:
    return at.mix(terms ^ at.mix(np.array([entity], np.int64).view(np.uint64)))


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text, its entities with their numbers of rows, and its distinct terms: all pairs."""
    for batch in at.slices(batches, "text"):
        for (codes, _, _), own in zip(_places(batch), batch.column("own").to_pylist(), strict=True):
            terms = np.unique(codes)
            for x in own if len(terms) else ():
                n = len(terms)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, x["entity"])), pa.array(terms.view(np.int64)), pa.array(_pair_codes(x["entity"], terms).view(np.int64)), pa.array(np.full(n, x["n"]))], ["entity", "term", "pair", "n"])


def _mark(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Places of the pairs whose bit is set."""
    for batch in at.slices(batches, "text"):
        for (codes, a, b), own, row in zip(_places(batch), batch.column("own").to_pylist(), batch.column("row").to_pylist(), strict=True):
            for entity in own:
                pair = _pair_codes(entity, codes)
                on = np.flatnonzero(bitmap[(pair & np.uint64((1 << BITS) - 1)).astype(np.int64)])
                if len(on):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), row)), pa.array(pair[on].view(np.int64)), pa.array(a[on]), pa.array(b[on])], ["row", "pair", "start", "stop"])


def _count_terms(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(term, documents that have it) for the terms whose bit is set; partial counts, which are added up
    over the slices of a task in bounded memory."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def added() -> tuple[np.ndarray, np.ndarray]:
        terms, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(terms, kind="stable")
        turn = np.flatnonzero(np.concatenate(([True], terms[order][1:] != terms[order][:-1])))
        return terms[order][turn], np.add.reduceat(n[order], turn)

    for batch in at.slices(batches, "text"):
        codes, row, *_ = _words(batch.column("text"))
        ok = np.flatnonzero(bitmap[(codes & np.uint64((1 << BITS) - 1)).astype(np.int64)])
        if not len(ok):
            continue
        pairs = np.unique(np.stack((codes[ok], row[ok].astype(np.uint64)), 1), axis=0)
        terms, count = np.unique(pairs[:, 0], return_counts=True)
        held.append((terms, count))
        if sum(len(x) for x, _ in held) > 1 << 20:
            held[:] = [added()]
            if len(held[0][0]) > 1 << 19:
                yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1], pa.int64())], ["term", "n"])
                held.clear()
    if held:
        terms, count = added()
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(count, pa.int64())], ["term", "n"])


def _bitmap(codes: DataFrame, code: str) -> np.ndarray:
    bits = np.zeros(1 << BITS, bool)
    position = F.col(code).bitwiseAND((1 << BITS) - 1) + 1  # from 1, as the bitmap functions count
    for r in codes.select(position.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect():  # at most 256 rows
        own = np.unpackbits(np.frombuffer(r.m, np.uint8), bitorder="little").astype(bool)
        bits[(r.k - 1) * 32768 + np.flatnonzero(own)] = True
    return bits


def find_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", support: int = 3, generalise: float = 0.8, remove: float = 0.95, chance: float = 0.05) -> DataFrame:
    """For each row: doc_id, text_key (a hash of the text), base (spans by kind, then start) and terms (spans of disclosing
    terms with ``removed``, by start)."""
    spark = docs.sparkSession
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed = read.withColumn("text_key", F.xxhash64("text"))
    scanned = keyed.mapInArrow(_find, f"doc_id long, text_key long, base array<{SPAN}>, entities array<long>, text string")
    found = written(scanned.withColumn("row", F.monotonically_increasing_id()), "private-spans")  # ids may repeat or be null
    private = found.where(F.col("text").isNotNull()).select("row", "text", "base")
    n_docs = float(max(1, found.count()))
    near = found.select("row", "text_key", F.explode("entities").alias("entity"))
    entities = near.groupBy("entity").agg(F.count("*").alias("n_entity"), F.count_distinct("text_key").alias("n_texts")).where(F.col("n_texts") >= support).select("entity", "n_entity")
    entities = written(entities, "private-entities")
    # equal texts have the same pairs: one row of each is read, and counts for all
    once = near.join(entities, "entity").groupBy("entity", "text_key").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    owners = once.groupBy("row").agg(F.collect_list(F.struct("entity", "n")).alias("own"))
    pairs = private.join(owners, "row").select("text", "base", "own").mapInArrow(_count_pairs, "entity long, term long, pair long, n long")
    tested = Observation()
    counts = pairs.groupBy("entity", "term", "pair").agg(F.count("*").alias("support"), F.sum("n").alias("both")).observe(tested, F.count(F.lit(1)).alias("n"))
    candidates = written(counts.where(F.col("support") >= support), "private-pairs")
    nothing = F.array().cast(TERMS)
    # p(t) is at least p(t, c), so PMI is at most IC: pairs without enough evidence at that need no count of their term
    most = F.log(F.lit(n_docs) / F.col("n_entity"))
    enough = math.log(max(1, tested.get["n"]) / chance)
    candidates = candidates.join(entities, "entity").where(F.col("support") * (most - 1 + F.exp(-most)) >= enough - 1e-6)
    terms_of = _bitmap(candidates, "term")
    if not terms_of.any():
        return found.select("doc_id", "text_key", "base", nothing.alias("terms"))
    bitmap = spark.sparkContext.broadcast(terms_of)
    counted = read.mapInArrow(lambda batches: _count_terms(batches, bitmap.value), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    bits_of = lambda c: F.log2(F.lit(n_docs) / c)
    pmi = F.log2(F.lit(n_docs) * F.col("both") / (F.col("n_term") * F.col("n_entity")))
    share = F.when(bits_of(F.col("n_entity")) > 0, pmi / bits_of(F.col("n_entity"))).otherwise(0.0)
    nats = pmi * math.log(2)
    evidence = F.col("support") * (nats - 1 + F.exp(-nats))
    likely = evidence >= enough
    risky = candidates.join(counted, "term").withColumn("share", share).where((F.col("share") >= generalise) & likely)
    risky = written(risky.select("entity", "pair", (F.col("share") >= remove).alias("removed")), "private-terms")
    marked = spark.sparkContext.broadcast(_bitmap(risky, "pair"))
    owners = near.join(risky.select("entity").distinct(), "entity").groupBy("row").agg(F.collect_list("entity").alias("own"))
    places = private.join(owners, "row").select("row", "text", "base", "own").mapInArrow(lambda batches: _mark(batches, marked.value), "row long, pair long, start long, stop long")
    hit = places.join(risky.select("pair", "removed"), "pair")
    terms = hit.groupBy("row", "start", "stop").agg(F.max("removed").alias("removed")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "removed"))).alias("terms"))
    return found.select("row", "doc_id", "text_key", "base").join(terms, "row", "left").select("doc_id", "text_key", "base", F.coalesce("terms", nothing).alias("terms"))


def digest(spans: DataFrame) -> DataFrame:
    """For each row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base, then terms)."""
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))
    base = F.array_join(F.transform("base", text), ",")
    terms = F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["start"].cast("string"), x["stop"].cast("string")))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.array_join(F.concat(F.transform("base", text), terms), ",").alias("spans"))


def redact(text: str | None, base: list[tuple[str, int, int]], terms: list[tuple[int, int, bool]]) -> str | None:
    """The text with each base span as its kind in brackets, and disclosing terms generalised or removed. Of spans that
    overlap, the union takes the first one's name."""
    if not text or not (base or terms):
        return text
    marks = [(s, e, f"[{k.upper()}]") for k, s, e in base] + [(s, e, "" if gone else "[NUMBER]" if re.search("[0-9]", text[s:e]) else "[TERM]") for s, e, gone in terms]
    out, upto = [], 0
    for start, end, name in sorted(marks, key=lambda m: (m[0], -m[1])):
        if start >= upto:
            out += [text[upto:start], name]
        upto = max(upto, end)
    return "".join([*out, text[upto:]])


def sanitise(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with sanitised text; all columns stay. Rows without spans are passed on as they are."""
    spans = find_spans(docs, doc_id=doc_id, text=text, **options).where((F.size("base") > 0) | (F.size("terms") > 0))
    found = spans.dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.struct("base", "terms").alias("_spans"))

    joined = docs.join(found, F.col(doc_id).cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64(F.col(text).cast("string")) == F.col("_key")), "left")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in at.slices(batches, text):
            marks = batch.column("_spans").to_pylist()
            column = batch.column(text)
            if any(marks):
                texts = column.to_pylist()
                new = [t if m is None else redact(t, [(x["kind"], x["start"], x["stop"]) for x in m["base"]], [(x["start"], x["stop"], x["removed"]) for x in m["terms"]]) for t, m in zip(texts, marks, strict=True)]
                column = pa.array(new, column.type)
            yield pa.RecordBatch.from_arrays([column if f.name == text else batch.column(f.name) for f in batch.schema if f.name != "_spans"], schema=pa.schema([f for f in batch.schema if f.name != "_spans"]))

    return joined.select(*docs.columns, "_spans").mapInArrow(clean, docs.schema)
