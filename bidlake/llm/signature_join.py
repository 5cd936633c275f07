"""N-gram Jaccard join with signature trees.

1. Equal shingle sets are one class, known by two hashes of the set.
2. Tokens in the lower half of the hash space (all tokens of small sets) are counted over the corpus in
   packed arrays. A set of n tokens that links needs 3/4 of them in another set, so at most n/4 of
   those counted may be unshared; every other class is settled here. The bound is exact.
3. For the classes left, the n/4 + 1 rarest tokens of a linked pair share one token (prefix filter in
   order of frequency), so chains over such tokens give cells which no link leaves. A cell is cut
   into blocks by size.
4. Blocks are joined by dual traversal of signature trees: a node holds the OR of its members' token
   bitmaps, their size range and the fewest bits of a member. For x under A and y under B at least
   (fewest bits in A) - (common bits) tokens of x are not in y, which bounds the overlap; pairs of
   nodes that cannot reach 3/4 are cut off. Every pair of sets that is left is intersected whole. A
   block pair returns a spanning forest of its links and each member's number of links in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlake.llm.common import SMALL_STEP_BYTES, components, local_roots, mixed, ranges, stage, text_steps, tidy
from bidlake.llm.shingles import shingle_sets

PERCENT = 75
SMALL_SET = 64  # sets below this are judged by all their tokens
BUCKET_TOKENS = 1_500_000
BLOCK_SETS = 512
LEAF_SETS = 4
BITMAP_BITS = 2048
_HALF = np.uint64(1 << 63)


class SignatureTree:
    """A binary hierarchy over sets; node 0 is the root, a node's children are larger numbers."""

    def __init__(self, sets: list[np.ndarray], order: np.ndarray):
        self.sets, self.order = sets, order
        bits = np.zeros((len(sets), BITMAP_BITS), bool)
        for i, s in enumerate(sets):
            bits[i, (s % np.uint64(BITMAP_BITS)).astype(np.int64)] = True
        self.size = np.array([len(s) for s in sets])
        few = bits.sum(axis=1)
        packed = np.packbits(bits, axis=1).view(np.uint64)
        self.nodes: list[tuple] = []  # bitmap, least size, largest size, fewest bits, first, last, left, right
        self._grow(packed, few, 0, len(sets))

    def _grow(self, packed: np.ndarray, few: np.ndarray, first: int, last: int) -> int:
        members = self.order[first:last]
        here = len(self.nodes)
        sizes = self.size[members]
        self.nodes.append((np.bitwise_or.reduce(packed[members], axis=0), int(sizes.min()), int(sizes.max()),
                           int(few[members].min()), first, last, -1, -1))
        if last - first > LEAF_SETS:
            middle = (first + last) // 2
            left, right = self._grow(packed, few, first, middle), self._grow(packed, few, middle, last)
            self.nodes[here] = (*self.nodes[here][:6], left, right)
        return here


def _reaches(a: tuple, b: tuple) -> bool:
    """Whether some pair under two nodes may link."""
    common = int(np.bitwise_count(a[0] & b[0]).sum())
    for x, y in ((a, b), (b, a)):
        missing = max(x[3] - common, 0)
        # overlap o <= n_x - missing, and 175 o >= 75 (n_x + n_y)
        if 100 * x[2] - (100 + PERCENT) * missing < PERCENT * y[1]:
            return False
    return True


def join_trees(one: SignatureTree, two: SignatureTree) -> tuple[np.ndarray, np.ndarray]:
    """All links between sets of ``one`` and of ``two``, found by dual traversal; ``two`` may be ``one``,
    whose links are then met once each."""
    same = one is two
    near = np.zeros((len(one.sets), len(two.sets)), bool)
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        a, b = one.nodes[i], two.nodes[j]
        if not (same and i == j) and not _reaches(a, b):
            continue
        if a[6] < 0 and b[6] < 0:
            near[np.ix_(one.order[a[4]:a[5]], two.order[b[4]:b[5]])] = True
        elif same and i == j:
            todo += [(a[6], a[7]), (a[7], a[7]), (a[6], a[6])]
        elif b[6] < 0 or (a[6] >= 0 and a[5] - a[4] >= b[5] - b[4]):
            todo += [(a[6], j), (a[7], j)]
        else:
            todo += [(i, b[6]), (i, b[7])]
    if same:
        near = np.triu(near | near.T, 1)
    near &= 100 * np.minimum.outer(one.size, two.size) >= PERCENT * np.maximum.outer(one.size, two.size)
    words, place = np.unique(np.concatenate(two.sets), return_inverse=True)
    first = np.cumsum(two.size) - two.size
    held = np.zeros(len(words), np.int32)
    found1, found2 = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in np.flatnonzero(near.any(axis=1)):
        q, x = np.flatnonzero(near[p]), one.sets[p]
        at = np.minimum(np.searchsorted(words, x), len(words) - 1)
        at = at[words[at] == x]
        held[at] = 1
        n = two.size[q]
        overlap = np.add.reduceat(held[place[ranges(first[q], n)]], np.cumsum(n) - n)
        held[at] = 0
        q = q[100 * overlap >= PERCENT * (len(x) + n - overlap)]
        found1.append(np.full(len(q), p))
        found2.append(q)
    return np.concatenate(found1), np.concatenate(found2)


def _tree(table: pa.Table) -> tuple[np.ndarray, np.ndarray, SignatureTree]:
    """Members of a block in the order of their least tokens, so that alike sets are neighbours."""
    ids = table.column("id").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
    least = np.array([s[0] for s in sets])
    return ids, table.column("copies").to_numpy(), SignatureTree(sets, np.lexsort((ids, least)))


_LINKS = "a long, b long, links long"


def _linked(ids: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """A spanning forest of the links (a, b) between members, without a number, and the links of each
    linked member as a loop; a link to a class counts its copies."""
    root = local_roots(len(ids), a, b)
    far = np.flatnonzero(root != np.arange(len(ids)))
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    some = np.flatnonzero(links)
    return pa.table({"a": pa.array(np.concatenate([ids[far], ids[some]]), pa.int64()),
                     "b": pa.array(np.concatenate([ids[root[far]], ids[some]]), pa.int64()),
                     "links": pa.array(np.concatenate([np.zeros(len(far), np.int64), links[some]]), pa.int64())})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links per row of ``docs`` (doc_id, text).

    Texts without words, and null texts, have no shingles and link with nothing. Every row is a node,
    also where rows share a doc_id: ``component_id`` is the smallest doc_id among the rows that a row
    reaches, and ``n_links`` counts the other rows whose text links with its text. A row with a null
    doc_id has a null component and links with nothing. Other columns are not read. No rows give no rows.
    """
    return _grouped(docs).select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), "n_links")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies, with all their columns, whatever their names.

    Of linked rows, that with the smallest doc_id stays (the smallest hash of the text where one
    doc_id has several texts); of rows that repeat doc_id and text one stays, whichever. Rows
    without words or without a doc_id stay. No rows give no rows.
    """
    rows = stage(_grouped(docs).filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id", "text_key").agg(
        F.count("*").alias("times"), F.first("first").alias("first")), "groups")
    key = [F.col("row.doc_id").cast("long") == F.col("doc_id"), F.xxhash64(F.col("row.text").cast("string")) == F.col("text_key")]
    whole = docs.select(F.struct("*").alias("row"))
    copies = rows.filter("first <> struct(doc_id, text_key)").select("doc_id", "text_key")
    repeated = rows.filter("times > 1 and first = struct(doc_id, text_key)").select("doc_id", "text_key")
    single = whole.join(copies.unionByName(repeated), key, "left_anti")
    # one row of each repeat, cut in every task before the shuffle
    one = whole.join(repeated, key).groupBy("doc_id", "text_key").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(one).select("row.*")


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, first, n_links per row; ``first`` is the least (doc_id, text_key)
    that a row reaches, and ``text_key`` a hash of the text that tells texts of one doc_id apart."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = kept.withColumn("text_key", F.xxhash64("text"))
    rows = stage(kept.mapInArrow(_summary, "doc_id long, text_key long, n long, counted long, h1 long, h2 long"), "sets")
    linkable = rows.filter("n > 0 and doc_id is not null")
    classes = linkable.groupBy("n", "counted", "h1", "h2").agg(
        F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("copies"))
    total = rows.agg(F.coalesce(F.sum("counted"), F.lit(0))).first()[0]
    buckets = max(-(-total // BUCKET_TOKENS), 1)
    shared = kept.filter("doc_id is not null").mapInArrow(
        lambda batches: _deal(batches, buckets), "bucket int, sets binary, tokens binary"
    ).groupBy("bucket").applyInArrow(
        lambda key, table: _shared(table, buckets), "part int, counts binary"
    ).groupBy("part").applyInArrow(_summed, "c1 long, shared long")
    overlap = F.ceil(F.col("n") * PERCENT / 100)
    open_ = classes.join(shared, F.col("h1") == F.col("c1")).filter(
        F.col("shared") >= F.greatest(F.col("counted") - (F.col("n") - overlap), F.lit(1)))
    open_ = open_.select("first", "c1", F.col("h2").alias("c2"), "copies")
    whole = kept.join(open_, (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))).select(
        "text", "first", "c1", "c2", "copies")
    distinct = whole.mapInArrow(_sets, _SETS).dropDuplicates(["c1", "c2", "n"])
    # the numbers are written once, so every later read agrees on them
    sets = stage(distinct.withColumn("id", F.monotonically_increasing_id()), "open_sets")

    tokens = sets.select("id", "n", "tokens").mapInArrow(_token_rows, "id long, n long, token long")
    frequent = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    held = tokens.join(frequent, "token")
    per_set = Window.partitionBy("id")
    # unshared tokens come first in the order of frequency and use up their part of the prefix
    prefix = (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1) - (F.col("n") - F.count("*").over(per_set))
    ranked = held.withColumns({"allowed": prefix, "r": F.row_number().over(per_set.orderBy("df", "token"))})
    chosen = stage(ranked.filter("r <= allowed").select("token", "id"), "prefixes")
    least = chosen.groupBy("token").agg(F.min("id").alias("a"))
    cells = components(chosen.join(least, "token").select("a", F.col("id").alias("b")).distinct())
    order = Window.partitionBy("cell").orderBy("n", "id")
    placed = sets.select("id", "n", "copies", "tokens").join(cells.select("id", F.col("component").alias("cell")), "id").withColumn(
        "block", F.floor((F.row_number().over(order) - 1) / BLOCK_SETS).cast("int"))
    placed = stage(placed, "blocks")
    links = stage(placed.groupBy("cell", "block").applyInArrow(_within, _LINKS).unionByName(_across(placed)), "links")
    counts = links.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    # each linked class with the least row of its component
    linked = components(links).join(sets.select("id", "n", F.col("c1").alias("h1"), F.col("c2").alias("h2"), "first"), "id")
    names = linked.groupBy("component").agg(F.min("first").alias("reached"))
    linked = linked.join(names, "component").join(counts, "id", "left").select("n", "h1", "h2", "reached", "links")
    numbered = classes.join(linked, ["n", "h1", "h2"], "left").select(
        "n", "counted", "h1", "h2", F.coalesce("reached", "first").alias("first"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))

    named = linkable.join(numbered, ["n", "counted", "h1", "h2"]).select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), "first", "n_links")
    alone = rows.filter("n = 0 or doc_id is null").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), F.struct("doc_id", "text_key").alias("first"),
        F.lit(0).cast("long").alias("n_links"))
    return named.unionByName(alone)


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column("tokens").to_pylist()]
        rows = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("n").take(rows), pa.array(
            np.concatenate(sets) if sets else np.zeros(0, np.int64))], ["id", "n", "token"])


def _across(placed: DataFrame) -> DataFrame:
    """Links between blocks of one cell; only blocks of sizes that can link meet."""
    span = placed.groupBy("cell", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    one = span.select("cell", F.col("block").alias("i"), F.col("high").alias("high1"))
    two = span.select(F.col("cell").alias("cell2"), F.col("block").alias("j"), F.col("low").alias("low2"))
    pairs = stage(one.join(two, (F.col("cell") == F.col("cell2")) & (F.col("i") < F.col("j")) & (
        PERCENT * F.col("low2") <= 100 * F.col("high1"))).select("cell", "i", "j"), "pairs")
    left = placed.join(pairs, (placed["cell"] == pairs["cell"]) & (placed["block"] == pairs["i"])).select(
        pairs["cell"].alias("c"), "i", "j", F.col("id").alias("id"), "copies", "tokens")
    other = placed.select(*(F.col(c).alias(c + "_2") for c in ("cell", "block", "id", "copies", "tokens")))
    p2 = pairs.select(*(F.col(c).alias(c + "_2p") for c in ("cell", "i", "j")))
    right = other.join(p2, (F.col("cell_2") == F.col("cell_2p")) & (F.col("block_2") == F.col("j_2p"))).select(
        F.col("cell_2p"), "i_2p", "j_2p", "id_2", "copies_2", "tokens_2")

    def meet(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        ids1, copies1, one_ = _tree(a.select(["id", "copies", "tokens"]))
        ids2, copies2, two_ = _tree(b.select(["id_2", "copies_2", "tokens_2"]).rename_columns(["id", "copies", "tokens"]))
        p, q = join_trees(one_, two_)
        return _linked(np.concatenate([ids1, ids2]), np.concatenate([copies1, copies2]), p, len(ids1) + q)

    return left.groupBy("c", "i", "j").cogroup(right.groupBy("cell_2p", "i_2p", "j_2p")).applyInArrow(meet, _LINKS)


def _within(key: tuple, table: pa.Table) -> pa.Table:
    ids, copies, tree = _tree(table)
    return _linked(ids, copies, *join_trees(tree, tree))


def _hashes(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every set of tokens."""
    sums = np.zeros((2, len(tokens) + 1), np.uint64)
    np.cumsum(mixed(tokens + np.uint64(1)), out=sums[0, 1:])
    np.cumsum(mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1, 1:])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return tuple((s[ends[1:]] - s[ends[:-1]]) for s in sums)


def _counted(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Tokens that are counted over the corpus: the lower half, and all tokens of a set that is small
    or may link to a small one."""
    return (tokens < _HALF) | np.repeat(sizes * PERCENT < SMALL_SET * 100, sizes)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, starts in text_steps(batches, step_bytes=SMALL_STEP_BYTES):
        tokens, sizes = shingle_sets(data, starts)
        h1, h2 = _hashes(tokens, sizes)
        low = np.concatenate([[0], np.cumsum(tokens < _HALF)])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        counted = np.where(sizes < SMALL_SET, sizes, low[ends[1:]] - low[ends[:-1]])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *map(pa.array, (
            sizes.astype(np.int64), counted.astype(np.int64), h1.view(np.int64), h2.view(np.int64)))],
            ["doc_id", "text_key", "n", "counted", "h1", "h2"])


_SET = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("upper", "<u4"), ("count", "<u4")])


def _deal(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Counted tokens (32 bits each) dealt by hash, with the sets they come from. Equal sets of one
    step are dealt once, so that a large group of copies sends little to any bucket."""
    for _, data, starts in text_steps(batches, step_bytes=SMALL_STEP_BYTES):
        tokens, sizes = shingle_sets(data, starts)
        h1, h2 = _hashes(tokens, sizes)
        once = np.zeros(len(sizes), bool)
        once[np.unique(np.stack([h1, h2], axis=1), axis=0, return_index=True)[1]] = True
        keep = _counted(tokens, sizes) & np.repeat(once, sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)[keep]
        # upper-half tokens count only for sets judged by all their tokens
        upper = (tokens[keep] >= _HALF) & (sizes[owner] >= SMALL_SET)
        bucket = (tokens[keep] % np.uint64(buckets)).astype(np.int64)
        short = (tokens[keep] >> np.uint64(31)).astype(np.uint32)
        order = np.lexsort((upper, owner, bucket))
        owner, bucket, short, upper = owner[order], bucket[order], short[order], upper[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[k], cuts[k + 1])
            used, count = np.unique(owner[part], return_counts=True)
            sets = np.zeros(len(used), _SET)
            sets["h1"], sets["h2"], sets["count"] = h1[used].view(np.int64), h2[used].view(np.int64), count
            sets["upper"] = np.bincount(np.searchsorted(used, owner[part]), upper[part], len(used)).astype(np.uint32)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int32()), "sets": pa.array([sets.tobytes()], pa.binary()),
                                              "tokens": pa.array([short[part].tobytes()], pa.binary())})


_COUNT = np.dtype([("h1", "<i8"), ("shared", "<u4")])


def _shared(table: pa.Table, parts: int) -> pa.Table:
    """Per set of a bucket, packed and dealt by its hash, how many of its judged tokens another set holds too. Different tokens
    that agree in 32 bits count as shared, which keeps a class open but settles none wrongly."""
    sets = np.concatenate([np.frombuffer(x, _SET) for x in table.column("sets").to_pylist()])
    tokens = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("tokens").to_pylist()])
    # several steps may have sent equal sets; one of each is enough
    once = np.sort(np.unique(sets[["h1", "h2"]], return_index=True)[1])
    each = sets["count"].astype(np.int64)
    tokens, sets = tokens[ranges((np.cumsum(each) - each)[once], each[once])], sets[once]
    count = sets["count"].astype(np.int64)
    owner = np.repeat(np.arange(len(sets)), count)
    pairs = np.sort((tokens.astype(np.uint64) << np.uint64(32)) | owner.astype(np.uint64))
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] >> np.uint64(32)
    shared = np.unique(pairs[1:][pairs[1:] == pairs[:-1]])
    place = np.searchsorted(shared, tokens)
    hit = shared[np.minimum(place, max(len(shared) - 1, 0))] == tokens if len(shared) else np.zeros(len(tokens), bool)
    # the last ``upper`` tokens of a set here are only for others to meet
    after = np.arange(len(tokens)) - np.repeat(np.cumsum(count) - count, count)
    hit &= after < np.repeat(count - sets["upper"].astype(np.int64), count)
    total = np.bincount(owner, hit, len(sets)).astype(np.int64)
    some = np.flatnonzero(total > 0)
    part = (mixed(np.ascontiguousarray(sets["h1"][some]).view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    some = some[np.argsort(part, kind="stable")]
    part = np.sort(part)
    rows = np.zeros(len(some), _COUNT)
    rows["h1"], rows["shared"] = sets["h1"][some], total[some]
    cuts = np.searchsorted(part, np.arange(parts + 1))
    full = np.flatnonzero(np.diff(cuts))
    out = pa.table({"part": pa.array(full.astype(np.int32)),
                    "counts": pa.array([rows[cuts[k]:cuts[k + 1]].tobytes() for k in full], pa.binary())})
    del tokens, pairs, shared, owner, place, hit, after
    tidy()
    return out


def _summed(key: tuple, table: pa.Table) -> pa.Table:
    """Shared tokens of each set over all buckets. Unlike sets that agree in one hash are summed, which leaves them open."""
    rows = np.concatenate([np.frombuffer(x, _COUNT) for x in table.column("counts").to_pylist()])
    ids, place = np.unique(rows["h1"], return_inverse=True)
    return pa.table({"c1": pa.array(ids, pa.int64()),
                     "shared": pa.array(np.bincount(place, rows["shared"], len(ids)).astype(np.int64))})


_SETS = "first struct<doc_id: long, text_key: long>, c1 long, c2 long, n long, copies long, tokens binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sets of the rows whose class is open (rows that agree in the key of a row may be of other classes)."""
    for batch, data, starts in text_steps(batches, step_bytes=SMALL_STEP_BYTES):
        tokens, sizes = shingle_sets(data, starts)
        h1, h2 = _hashes(tokens, sizes)
        own = (h1.view(np.int64) == batch.column("c1").to_numpy()) & (h2.view(np.int64) == batch.column("c2").to_numpy())
        ends = np.concatenate([[0], np.cumsum(sizes)])
        rows = np.flatnonzero(own)
        taken = {c: batch.column(c).take(pa.array(rows)) for c in ("first", "c1", "c2", "copies")}
        yield pa.RecordBatch.from_pydict({
            "first": taken["first"], "c1": taken["c1"], "c2": taken["c2"], "n": pa.array(sizes[rows].astype(np.int64)),
            "copies": taken["copies"], "tokens": pa.array([tokens[ends[i]:ends[i + 1]].tobytes() for i in rows], pa.binary())})
