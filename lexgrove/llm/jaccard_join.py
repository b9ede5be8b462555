"""N-gram Jaccard join by a token-group matrix.

A document's set is its distinct word shingles; two documents link when 100 |A and B| >= ``percent`` |A or B|. The result has each
document's component, so links between copies need not be listed, and no link between different sets is lost:

1. Tokens (shingle codes) are dealt to buckets; a token that one set has alone can be in no intersection. A document goes
   on only if tokens that other sets share make up ``percent`` of its own, and only one document of each set goes on.
2. Similar documents are partitioned into groups. Documents with a common minimum of one of ``probes`` hash orders meet in
   cells of at most ``group_rows`` documents (and ``group_tokens`` tokens); in a cell the most central documents are compared with all that
   are not of their component yet, until every document is settled. Components are groups; a document without links is of the
   group of the one that is nearest to it, so near copies that miss the threshold stand in one group all the same.
3. Token-group matrix: which groups have which tokens. Links that are still unknown lead from one component to another, so
   only tokens in several components count (a bitmap of fixed size leaves most others out before an exact join). A query and a
   member that link have one of the rarest tokens of each in common, as many as it may miss and one more; so the matrix
   holds these alone, and groups that have one of the query's and whose members' sizes fit are its candidates. A size fits
   only if the tokens that either has in several components can make up the share, so near copies about a common passage that
   is too short for a link are no candidates of each other. Of two components the smaller one asks. Each candidate group's token union is stored; the query's overlap with it bounds what any
   member can have. Only groups in which a query reaches ``percent`` are opened: then the query's
   overlap with every member is counted, and linked components join.

Step 3 takes every document as a query and is exact, whatever step 2 has found: step 2 only makes it cheap.

Null and wordless texts have empty sets and no links. Fewer than ``words`` words are one shingle. Rows that repeat an id
are kept apart by their text. Rows without an id have no links and no component. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrow_text as at
from . import repeats as r
from .components import components
from .shared_folder import Scratch

TOKENS, META, SHARED = 10, 11, 12
#: Bits of the bitmap of tokens in several components; where it fills up, an exact join has more to do.
BITS = 26


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle codes of each text."""
    raw, offsets = at.flat(texts)
    raw = at.LOWER[raw]
    starts, ends, first = at.word_bounds(raw, offsets, at.SPACE)
    runs = at.Runs(at.word_codes(raw, starts, ends))
    count = np.diff(first)
    number = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    begin = np.repeat(first[:-1], number) + at.expand(np.zeros(len(number), np.int64), number)
    codes = runs.codes(begin, begin + np.repeat(np.minimum(count, words), number))
    bounds = np.concatenate(([0], np.cumsum(number))).tolist()
    return [np.unique(codes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _scan(batches: Iterator[pa.RecordBatch], words: int, buckets: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows get numbers, which stay the same if the task runs again. Rows without an id only say what they are."""
    metas: list[pa.RecordBatch] = []

    def numbered() -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, rows = batch.column("doc_id"), batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.compute.fill_null(ids, 0), ids.is_valid(), batch.column("text"), batch.column("text_key"), pa.array(np.arange(n, n + rows))], ["doc_id", "known", "text", "own_key", "text_key"])
            n += rows

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        """A document's place is its number."""
        sets = shingle_sets(batch.column("text"), words)
        meta, name = _meta(batch, sets, buckets)
        metas.append(meta)
        sets = [x if known else x[:0] for x, known in zip(sets, batch.column("known").to_pylist(), strict=True)]
        size = np.array([len(x) for x in sets], np.int64)
        names = np.array([int.from_bytes(x[:8], "little") for x in name], np.uint64)
        return np.arange(len(sets) + 1), [np.repeat(np.arange(len(sets)), size), np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(names, size)]

    for stretch in r.stretches(numbered(), read, limit):
        yield from metas
        metas.clear()
        yield stretch.table(buckets)
        doc, (code, name) = stretch.place, stretch.fields
        if not len(code):
            continue
        # of equal sets, the first document's tokens
        turn = r.runs_of(doc)
        order = np.argsort(name[turn], kind="stable")
        lead = order[r.runs_of(name[turn][order])]
        stays = np.zeros(len(stretch.ids), bool)
        stays[doc[turn[lead]]] = True
        on = stays[doc]
        code, doc = code[on], doc[on]
        # tokens that several sets of the stretch share are settled, and travel once
        order = np.argsort(code, kind="stable")
        runs = r.runs_of(code[order])
        many = np.diff(np.append(runs, len(code))) > 1
        shared, send = np.zeros(len(code), bool), np.ones(len(code), bool)
        shared[order] = r.spread(many, runs, len(code))
        send[shared] = False
        send[order[runs[many]]] = True
        if shared.any():
            own = r.stretch_buckets(np.array([stretch.number]), buckets)
            yield r.packed(SHARED, buckets, np.repeat(own, shared.sum()), stretch, doc[shared], codes=code[shared])
        yield r.packed(TOKENS, buckets, (code[send] % np.uint64(buckets)).astype(np.int64), stretch, doc[send], codes=code[send])


def _meta(batch: pa.RecordBatch, sets: list[np.ndarray], buckets: int) -> tuple[pa.RecordBatch, list[bytes]]:
    """A packed row for the slice's documents, and the sets' names (16 zero bytes: empty)."""
    names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else bytes(16) for s in sets]
    known = batch.column("known").to_numpy(zero_copy_only=False)
    row = {"ids": batch.column("doc_id").to_numpy(), "keys": batch.column("own_key").to_numpy(), "codes": batch.column("text_key").to_numpy(), "counts": np.array([len(s) for s in sets], np.int64), "places": known.astype(np.int8)}
    return r.rows_of(1, kind=pa.array([META], pa.int32()), bucket=pa.array([int(row["keys"][0]) % buckets], pa.int32()), stretch=pa.array([-1]), marks=pa.array([b"".join(names)], pa.binary()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in row.items()}), names


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of the packed ones."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, keys, nodes, counts = (at.joined(batch.column(c), np.int64) for c in ("ids", "keys", "codes", "counts"))
        known = at.joined(batch.column("places"), np.int8).astype(bool)
        names = pa.Array.from_buffers(pa.binary(16), len(ids), [None, pa.py_buffer(at.joined(batch.column("marks"), np.uint8))]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(keys), pa.array(nodes), pa.compute.if_else(pa.array(counts > 0), names, None), pa.array(counts)], ["doc_id", "text_key", "node", "set_key", "n_shingles"])


def _gather(table: pa.Table) -> pa.Table:
    """The sorted shared tokens of each document of a stretch."""
    _, nodes, _, rows = r.tables_and(table)
    doc, code = r.together(r.numbers(rows["places"])), at.joined(rows["codes"], np.int64)
    order = np.lexsort((code, doc))
    order = order[r.runs_of(doc[order], code[order])]
    turn = r.runs_of(doc[order])
    lists = pa.ListArray.from_arrays(pa.array(np.append(turn, len(order)).astype(np.int32)), pa.array(code[order]))
    return pa.Table.from_arrays([pa.array(nodes[doc[order[turn]]]), lists], ["node", "tokens"])


def _share(table: pa.Table) -> pa.Table:
    """The tokens of a bucket that several stretches have, for their documents; other rows pass."""
    kinds = table["kind"].to_numpy()
    out = [table.filter(pa.array(kinds != TOKENS))]
    own = table.filter(pa.array(kinds == TOKENS))
    if own.num_rows:
        code, parts = at.joined(own["codes"], np.uint64), r.numbers(own["places"])
        order = np.argsort(code, kind="stable")
        runs = r.runs_of(code[order])
        shared = np.zeros(len(code), bool)
        shared[order] = r.spread(np.diff(np.append(runs, len(code))) > 1, runs, len(code))
        row, doc, code = r.row_numbers(parts)[shared], r.together(parts)[shared], code[shared]
        turn = r.runs_of(row)
        bounds = np.append(turn, len(row))
        numbers = own["stretch"].to_numpy()[row[turn]]
        out.append(pa.Table.from_batches([r.rows_of(len(turn), kind=pa.array(np.full(len(turn), SHARED, np.int32)), bucket=pa.array(np.zeros(len(turn), np.int32)), stretch=pa.array(numbers), places=r.planes(doc, bounds), codes=r.cut(code, bounds))]))
        del code, order, runs, shared, row, doc
        at.release()
    return pa.concat_tables(out)


def _minima(batches: Iterator[pa.RecordBatch], probes: int) -> Iterator[pa.RecordBatch]:
    """The least token in each of some hash orders."""
    for batch in batches:
        if not batch.num_rows:
            continue
        token, bounds = _flat(batch.column("tokens"))
        found = [np.minimum.reduceat(at.mix(token.view(np.uint64) ^ at.BYTE_CODES[p]), bounds[:-1]).view(np.int64) for p in range(probes)]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * probes), pa.array(np.stack(found, 1).reshape(-1) if found else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "n", "tokens")), lists], ["node", "n", "tokens", "minima"])


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a column of lists, and the lists' bounds."""
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().to_numpy(), bounds - bounds[0]


class Postings:
    """Which of some documents have each token."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        self.n = len(counts)
        of = np.repeat(np.arange(self.n), counts)
        order = np.argsort(tokens, kind="stable")
        turn = r.runs_of(tokens[order])
        self.union, self.bounds, self.of = tokens[order][turn], np.append(turn, len(order)), of[order]
        self.often = np.diff(self.bounds)

    def overlaps(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the distinct tokens each document has."""
        place = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        place = place[self.union[place] == tokens]
        return np.bincount(self.of[at.expand(self.bounds[place], self.often[place])], minlength=self.n)


def _cells(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each cell in a table: its number, its rows, all their tokens, and how many each has."""
    cell = table["cell"].to_numpy()
    token, bounds = _flat(table["tokens"].combine_chunks())
    order = np.argsort(cell, kind="stable")
    turn = r.runs_of(cell[order])
    for rows in np.split(order, turn[1:]):
        count = bounds[rows + 1] - bounds[rows]
        yield int(cell[rows[0]]), rows, token[at.expand(bounds[rows], count)], count


def _settle(n: np.ndarray, tokens: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Components of a cell's documents (each by one of its documents), and for a document without links the nearest other
    one (-1: none has half of ``percent``). The most central document comes first; who is of its component needs no look."""
    index = Postings(tokens, counts)
    first = np.concatenate(([0], np.cumsum(counts)))
    often = index.often[np.searchsorted(index.union, tokens)]
    central = np.add.reduceat(often, first[:-1]) / n
    label, near = np.arange(len(n)), np.full(len(n), -1)
    for p in np.argsort(-central, kind="stable").tolist():
        if (label == label[0]).all():
            break
        own = slice(first[p], first[p + 1])
        both = index.overlaps(tokens[own][often[own] > 1])
        both[p] = 0
        all_ = n + n[p] - both
        linked = np.unique(label[(100 * both >= percent * all_) & (label != label[p])])
        if len(linked):
            label[np.isin(label, linked)] = label[p]
        best = int(np.argmax(both / all_))
        if 200 * both[best] >= percent * all_[best]:
            near[p] = best
    alone = np.bincount(label, minlength=len(n))[label] == 1
    return label, np.where(alone, near, -1)


def _within(table: pa.Table, percent: int) -> pa.Table:
    """Links of the documents in each cell, to one of their component; and what a document without links is nearest to."""
    a, b, linked = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    nodes, sizes = table["node"].to_numpy(), table["n"].to_numpy()
    for _, rows, tokens, counts in _cells(table):
        if len(rows) > 1:
            label, near = _settle(sizes[rows], tokens, counts, percent)
            for who, to, link in ((np.flatnonzero(label != np.arange(len(rows))), label, True), (np.flatnonzero(near >= 0), near, False)):
                a.append(nodes[rows[who]])
                b.append(nodes[rows[to[who]]])
                linked.append(np.full(len(who), link))
    at.release()
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "linked": np.concatenate(linked)})


def _by_label(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Tokens with their components, packed; each pair once for some batches."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        label, token = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((token, label))
        order = order[r.runs_of(label[order], token[order])]
        label, token = label[order], token[order]
        nowhere = r.Stretch(0, label, label, label, label, [])
        yield r.packed(TOKENS, buckets, (token.view(np.uint64) % np.uint64(buckets)).astype(np.int64), nowhere, np.zeros(len(label), np.int64), ids=label, codes=token)

    for batch in batches:
        lists = batch.column("tokens")
        held.append((np.repeat(batch.column("label").to_numpy(), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()))
        if sum(len(x) for x, _ in held) > 1 << 20:
            yield from flush()
    if sum(len(x) for x, _ in held):
        yield from flush()


def _cross(table: pa.Table) -> pa.Table:
    """The tokens that several components have."""
    token, label = at.joined(table["codes"], np.int64), r.entry_ids(table)
    order = np.argsort(token, kind="stable")
    runs = r.runs_of(token[order])
    several = np.minimum.reduceat(label[order], runs) != np.maximum.reduceat(label[order], runs)
    return pa.table({"token": token[order][runs][several]})


def _bitmap(tokens: DataFrame) -> np.ndarray:
    """A bit for each token's low bits; at most 2048 rows of 4 KB come to the driver."""
    bits = np.zeros(1 << BITS - 3, np.uint8)
    place = F.col("token").bitwiseAND((1 << BITS) - 1) + 1
    for row in tokens.select(place.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect():
        bits[(row.k - 1) * 4096 : row.k * 4096] = np.frombuffer(row.m, np.uint8)  # Spark's maps have the low bit first, too
    return bits


def _crossing(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Documents with enough tokens whose bit is set, and only those tokens."""
    for batch in batches:
        if not batch.num_rows:
            continue
        token, bounds = _flat(batch.column("tokens"))
        place = token & ((1 << BITS) - 1)
        on = (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        count = np.concatenate(([0], np.cumsum(on)))[bounds]
        keep = 100 * np.diff(count) >= percent * batch.column("n").to_numpy()
        new = pa.ListArray.from_arrays(pa.array(count.astype(np.int32)), pa.array(token[on]))
        yield pa.RecordBatch.from_arrays([new if f.name == "tokens" else batch.column(f.name) for f in batch.schema], schema=batch.schema).filter(pa.array(keep))


def _unions(table: pa.Table) -> pa.Table:
    """The token union of each cell."""
    cells, unions = [], []
    for cell, _, tokens, _ in _cells(table):
        cells.append(cell)
        unions.append(np.unique(tokens))
    return pa.table({"cell": pa.array(cells, pa.int64()), "tokens": pa.array(unions, pa.list_(pa.int64()))})


ASKS = ["cell", "home", "node", "n", "label", "tokens"]


def _bound(unions: pa.Table, asks: pa.Table, percent: int) -> pa.Table:
    """The queries whose overlap with the cell's token union is large enough."""
    keep = np.zeros(asks.num_rows, bool)
    if asks.num_rows and unions.num_rows:
        known = {cell: tokens for cell, _, tokens, _ in _cells(unions)}
        n = asks["n"].to_numpy()
        for cell, rows, tokens, counts in _cells(asks):
            union = known[cell]
            place = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
            both = np.add.reduceat((union[place] == tokens).astype(np.int64), np.cumsum(counts) - counts)
            keep[rows] = 100 * both >= percent * n[rows]
    return asks.select(ASKS).filter(pa.array(keep))


def _open(members: pa.Table, asks: pa.Table, percent: int) -> pa.Table:
    """Counts the queries' overlaps with all members of their cells: the components that link."""
    links: set[tuple[int, int]] = set()
    if members.num_rows and asks.num_rows:
        index = {cell: (rows, Postings(tokens, counts)) for cell, rows, tokens, counts in _cells(members)}
        of, size = members["label"].to_numpy(), members["n"].to_numpy()
        label, n = asks["label"].to_numpy(), asks["n"].to_numpy()
        for cell, rows, tokens, counts in _cells(asks):
            own, postings = index[cell]
            ends = np.cumsum(counts)
            for row, end, count in zip(rows.tolist(), ends.tolist(), counts.tolist(), strict=True):
                both = postings.overlaps(tokens[end - count : end])
                hit = (100 * both >= percent * (size[own] + n[row] - both)) & (of[own] != label[row])
                links.update((int(label[row]), x) for x in np.unique(of[own[hit]]).tolist())
        del index, own, postings
        at.release()
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75, probes: int = 4, group_rows: int = 1000, group_tokens: int = 1 << 19, query_rows: int = 500, stretch: int = r.STRETCH_BYTES // 2, counted: list[int] | None = None) -> DataFrame:
    """For each row: doc_id, text_key (hash of the text), n_shingles, set_key (hash of the set; null if empty),
    component_id (the smallest doc_id of its component) and label (a number of the component; null if the row has no id
    or no words). counted: gets the number of pairs of a query and a candidate group."""
    read, scratch = r.prepared(docs, doc_id, text), Scratch()
    written = scratch.written
    buckets = r.bucket_count(read)
    scanned = written(read.mapInArrow(lambda b: _scan(b, words, buckets, stretch), r.ROW).groupBy("bucket").applyInArrow(_share, r.ROW), "shingles")
    meta = scanned.where(F.col("kind") == META).mapInArrow(_numbers, "doc_id long, text_key long, node long, set_key binary, n_shingles long")
    linkable = F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()
    sets = meta.where(linkable).groupBy("set_key").agg(F.min("node").alias("node"), F.max("n_shingles").alias("n"), F.min("doc_id").alias("least"))
    shared = scanned.where(F.col("kind").isin(SHARED, r.TABLE)).groupBy("stretch").applyInArrow(_gather, "node long, tokens array<long>")
    enough = shared.join(sets.select("node", "n", "least"), "node").where(100 * F.size("tokens") >= percent * F.col("n"))
    near = written(enough.select("node", "n", "tokens").mapInArrow(lambda b: _minima(b, probes), "node long, n long, tokens array<long>, minima array<long>"), "near")
    total = near.agg(F.sum(F.size("tokens"))).first()[0] or 0
    deals = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * max(1, probes) // group_tokens))
    deal = F.pmod(F.xxhash64("cell"), F.lit(deals)).alias("deal")
    size = F.size("tokens")
    parts = lambda rows, s: F.ceil(F.greatest(F.count("*") / rows, F.sum(s) / group_tokens)).cast("int").alias("parts")
    part_of = lambda *c: F.xxhash64(*c, F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")))

    # groups: documents that have a minimum in common, in cells of bounded size
    minima = near.select("node", size.alias("size"), F.posexplode("minima").alias("probe", "minimum"))
    met = written(minima.groupBy("probe", "minimum").agg(F.count("*").alias("rows"), parts(group_rows, "size")).where(F.col("rows") > 1).drop("rows"), "minima")
    cells = minima.join(met, ["probe", "minimum"]).select("node", F.xxhash64("probe", "minimum", F.pmod(F.xxhash64("node", "probe"), F.col("parts"))).alias("cell"))
    pairs = written(cells.join(near.select("node", "n", "tokens"), "node").select("*", deal).groupBy("deal").applyInArrow(lambda t: _within(t, percent), "a long, b long, linked boolean"), "within")
    linked = components(pairs.where("linked").select("a", "b"))
    nearest = pairs.where(~F.col("linked")).groupBy("a").agg(F.min("b").alias("b")).join(linked.select(F.col("node").alias("b"), "label"), "b", "left").select(F.col("a").alias("node"), F.coalesce("label", "b").alias("home"))
    found = near.select("node").join(linked, "node", "left").join(nearest, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.coalesce("label", "home", "node").alias("group"))
    labelled = written(near.select("node", "n", "tokens").join(found, "node"), "groups")
    found = labelled.select("node", "label")

    # tokens in several components, and the documents that have enough of them
    cross = written(labelled.select("label", "tokens").mapInArrow(lambda b: _by_label(b, buckets), r.ROW).groupBy("bucket").applyInArrow(_cross, "token long"), "cross-tokens")
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(cross))  # of fixed size
    some = labelled.mapInArrow(lambda b: _crossing(b, bitmap.value, percent), labelled.schema)
    places = some.select("node", "n", "label", "group", F.explode("tokens").alias("token")).join(cross, "token", "left_semi")
    open_ = written(places.groupBy("node", "n", "label", "group").agg(F.array_sort(F.collect_list("token")).alias("tokens")).where(100 * size >= percent * F.col("n")), "open")
    members = written(open_.groupBy("label").agg(F.count("*").alias("members")), "component-sizes")
    # of two components the smaller one asks; of equal ones, the one with the smaller hash
    rank = (F.shiftleft("members", 20) + F.xxhash64("label").bitwiseAND((1 << 20) - 1)).alias("rank")
    chunks = written(open_.groupBy("group").agg(parts(group_rows, size)), "group-sizes")
    grouped = written(open_.join(members, "label").join(chunks, "group").select("node", "n", "label", rank, part_of("group").alias("cell"), "tokens"), "grouped")

    # the matrix, and each document's rarest tokens in it: two that link have one of these in common, as the rarest token
    # of their intersection stands among the rarest of either, as many as it may miss and one more
    # an intersection is no larger than what either has of such tokens, so it tells how large a set it may link with
    partner = (F.floor(F.lit(100 + percent) * size / percent) - F.col("n")).alias("partner")
    places = grouped.select("node", "n", "label", "rank", "cell", size.alias("size"), partner, F.explode("tokens").alias("token"))
    spread = places.groupBy("token", "cell").agg(F.lit(1).alias("one")).groupBy("token").agg(F.count("*").alias("groups"))
    may_miss = F.col("size") - F.ceil(F.col("n") * percent / 100) + 1
    rare = written(places.join(spread, "token").withColumn("_r", F.row_number().over(W.partitionBy("node").orderBy("groups", "token"))).where(F.col("_r") <= may_miss).select("node", "n", "label", "rank", "cell", "partner", "token"), "rarest")
    matrix = rare.groupBy("token", "cell").agg(F.min("n").alias("least"), F.max("n").alias("largest"), F.max("partner").alias("reaches"), F.max("rank").alias("top"), F.min("label").alias("low"), F.max("label").alias("high"))
    fits = (F.col("least") <= F.col("partner")) & (F.col("reaches") >= F.col("n")) & (100 * F.col("largest") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("least")) & (F.col("top") >= F.col("rank")) & ((F.col("low") != F.col("label")) | (F.col("high") != F.col("label")))
    wanted = rare.select("node", "n", "label", "rank", "partner", "token").join(matrix, "token").where(fits).select("node", "cell").distinct()
    candidates = written(wanted.join(grouped.select("node", "n", "label", "tokens"), "node"), "candidates")
    if counted is not None:
        counted.append(candidates.count())
    if not candidates.isEmpty():
        asked = written(candidates.groupBy("cell").agg(parts(query_rows, size)), "asked")
        split = candidates.join(asked, "cell").select(F.col("cell").alias("home"), part_of("cell").alias("cell"), "node", "n", "label", "tokens")
        unions = written(grouped.join(asked, "cell", "left_semi").select("cell", "tokens", deal).groupBy("deal").applyInArrow(_unions, "cell long, tokens array<long>"), "unions")
        copies = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        dealt = unions.join(asked, "cell").select("cell", "tokens", copies).select(F.xxhash64("cell", F.col("part").cast("long")).alias("cell"), "tokens")
        asks = "cell long, home long, node long, n long, label long, tokens array<long>"
        both = lambda x, y, f, schema: x.select("*", deal).groupBy("deal").cogroup(y.select("*", deal).groupBy("deal")).applyInArrow(lambda m, q: f(m, q, percent), schema)
        bounded = written(both(dealt, split, _bound, asks), "bounded")
        opened = grouped.select(F.col("cell").alias("home"), "label", "n", "tokens").join(bounded.groupBy("home", F.col("cell").alias("own")).agg(F.count("*").alias("asks")), "home").select(F.col("own").alias("cell"), "label", "n", "tokens")
        joined = components(both(opened, bounded, _open, "a long, b long").distinct())
        found = found.join(joined.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    labels = written(sets.select("set_key", "node", "least").join(found, "node", "left").select("set_key", "least", F.coalesce("label", "node").alias("label")), "labels")
    least = written(labels.groupBy("label").agg(F.min("least").alias("component_id")), "components")
    scratch.drop(docs, *(n for n in list(scratch.paths) if n not in ("shingles", "labels", "components")))
    own = meta.where(linkable).join(labels.join(least, "label").select("set_key", "label", "component_id"), "set_key")
    columns = ["doc_id", "text_key", "n_shingles", "set_key"]
    alone = meta.where(~linkable).select(*columns, F.when(F.col("set_key").isNull(), F.col("doc_id")).alias("component_id"), F.lit(None).cast("long").alias("label"))
    return own.select(*columns, "component_id", "label").unionByName(alone)


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component, the least by id, then text_key; documents without words and rows without an id all
    stay. Of rows that repeat both id and text, one stays. All columns are kept."""
    near = near_duplicates(docs, doc_id=doc_id, text=text, **options)
    firsts = near.where(F.col("doc_id") == F.col("component_id")).where(F.col("label").isNotNull()).groupBy(F.col("label").alias("_l"), F.col("doc_id").alias("_id")).agg(F.min("text_key").alias("_key"))
    keyed = docs.withColumns({"_id": F.col(doc_id).cast("long"), "_key": r.text_key(F.col(doc_id), F.col(text))})
    free = F.col("_id").isNull() | ~F.coalesce(F.col(text).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    keyed = keyed.withColumn("_row", F.when(free, F.monotonically_increasing_id()))
    kept = keyed.join(firsts.select("_id", "_key", F.lit(True).alias("_first")), ["_id", "_key"], "left").where(F.col("_row").isNotNull() | F.col("_first"))
    return kept.dropDuplicates(["_id", "_key", "_row"]).select(*docs.columns)
