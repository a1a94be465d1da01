"""N-gram Jaccard join by PartEnum signatures, and the components of its links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ODD, lists, map_arrow, mix, remove, shingles, sieved, table, written
from .components import components
from .flushes import FLUSH, FLUSH_DOCS, columns, loads, packed, prints, shape, unpacked

#: Parts on which similar sets agree at least: these, and one more for every so many elements they may differ in.
SLACK, MORE = 3, 8
BLOCK = 1024
#: Buckets of so many members at most give their pairs by a join; larger ones are compared in blocks.
SMALL = 8
#: Larger buckets that share their members' least hash are compared in one group, up to about so many members in sum.
GROUP = 1 << 14
#: Rounds in which a node meets the head that shares most of its buckets, before buckets' members are compared.
ROUNDS = 2
#: Rounds at most in which blocks of a bucket name one pair for two components, before they name all.
FORESTS = 4


def band_of(size: int) -> tuple[int, int]:
    """The number of the band that holds a set size, and the band's largest size; bands grow by half."""
    i, low = 0, 1
    while True:
        high = low + low // 2
        if size <= high:
            return i, high
        i, low = i + 1, high + 1


def difference(sizes: int, num: int, den: int) -> int:
    """Most elements in the symmetric difference of two sets with these sizes in sum and Jaccard num/den or more."""
    return sizes * (den - num) // (den + num)


def signatures(found: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int, list[int]]:
    """PartEnum's signatures of a set of hashes, how many of them are the first band's, and what each band needs.

    Sets of one size band that are similar differ in k elements at most. The domain is cut into
    n = k + slack parts by hash, so similar sets agree on slack parts or more, and each part a set
    occupies gives one signature (the first-level subsets of size one, the cheapest setting of the
    enumeration). Parts empty in both sets also agree: a set with slack or more empty parts, which
    is rare, gives those signatures too, so no pair is lost. A set that may be similar to a larger
    one of the next band also gives that band's signatures. A band needs slack signatures, less the
    set's empty parts: with fewer that some other set has too, it is similar to none in that band.
    """
    size = len(found)
    if not size:
        return np.zeros(0, np.uint64), 0, [1, 1]
    out: list[np.ndarray] = []
    needs: list[int] = []
    band, high = band_of(size)
    bands = [(band, high)]
    if size * den // num > high:
        bands.append(band_of(high + 1))
    spread = mix(found + ODD)
    for band, high in bands:
        k = difference(2 * high, num, den)
        slack = SLACK + k // MORE if k else 1
        n = k + slack
        part = ((spread >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sums = np.add.reduceat(spread[order], first)
        own = part[first]
        n_empty = n - len(own)
        if n_empty >= slack:
            empty = np.setdiff1d(np.arange(n, dtype=np.uint64), own)
            own, sums = np.concatenate([own, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
        needs.append(max(1, slack - n_empty))
        out.append(mix(sums + mix(own + np.uint64(band << 32))))
    return np.concatenate(out), len(out[0]), [needs[0], needs[-1]]


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of elements per bit, eight bits an element or more: two sets' sketches, folded to one length, differ in no more bits than the sets in elements."""
    bits = 1 << max(9, (8 * len(found) - 1).bit_length())
    odd = np.bincount((mix(found * ODD) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(sk: np.ndarray, words: int) -> np.ndarray:
    """A sketch as one of fewer words: the parity of each bit's like."""
    return np.bitwise_xor.reduce(sk.reshape(-1, words)) if len(sk) > words else sk


def name_of(found: np.ndarray) -> int:
    """A set's 64-bit name; equal sets have equal names."""
    return int(mix(mix(found ^ ODD).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(found)))[0].astype(np.int64)) if len(found) else 0


MET = "sig long, row long, doc_id long, th long, n long, node long, need int, need_next int"


def met(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Of every document its number (row), id, text hash, set size, set name and needs; and (sig, row) of signatures that two or more have.

    Nearly all signatures stand once and never leave the reducer that meets them. Each task sends its
    signatures as sorted fingerprints in flushes, a few bytes each, dealt by ranges of fingerprints;
    sets that a flush has twice are sent once. row is the flush's number times 2**16, plus twice the
    document's; a signature of the next band adds one.
    """
    low_bytes, ranges = shape(docs)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        flush = (task.partitionId() if task else 0) << 24
        meta: list[tuple] = []
        sigs: list[np.ndarray] = []
        own: list[int] = []
        known: set[int] = set()
        held = 0

        def sent() -> pa.RecordBatch:
            lengths = list(map(len, sigs))
            sig = prints(np.concatenate([*sigs, np.zeros(0, np.uint64)]), low_bytes)
            later = np.arange(len(sig)) - np.repeat(np.cumsum([0, *lengths[:-1]]) if lengths else 0, lengths) >= np.repeat(own, lengths) if lengths else np.zeros(0, bool)
            doc = 2 * np.repeat(np.arange(len(sigs)), lengths) + later
            rows = packed(sig, loads(doc.astype("<u2")), low_bytes, ranges)
            flat = [pa.array([None] * len(rows) + [[m[i] for m in meta]], pa.list_(pa.int64())) for i in range(6)]
            blobs = [pa.array([*(r[i] for r in rows), None], pa.binary()) for i in (1, 2, 3)]
            return pa.RecordBatch.from_arrays([pa.array([*(r[0] for r in rows), flush % ranges], pa.int32()), pa.array([flush] * (len(rows) + 1), pa.int64()), *blobs, *flat], ["range", "flush", "counts", "low", "docs", *names])

        names = ["doc_id", "th", "n", "node", "need", "need_next"]
        for b in batches:
            for doc_id, th, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                found = shingles(text, words)
                node, (sig, split, need) = name_of(found), signatures(found, num, den)
                meta.append((doc_id, th, len(found), node, *need))
                if node in known:
                    sig = sig[:0]
                known.add(node)
                sigs.append(sig)
                own.append(split)
                held += len(sig)
                if held >= FLUSH or len(meta) >= FLUSH_DOCS:
                    yield sent()
                    meta, sigs, own, known, held, flush = [], [], [], set(), 0, flush + 1
        if meta:
            yield sent()

    kinds = "range int, flush long, counts binary, low binary, docs binary, doc_id array<long>, th array<long>, n array<long>, node array<long>, need array<long>, need_next array<long>"
    flushes = map_arrow(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), first, kinds)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["sig", "row", *(x.split()[0] for x in MET.split(", ")[2:])]
        kinds = [pa.int64()] * 6 + [pa.int32()] * 2
        now, held = -1, []

        def shared() -> Iterator[pa.RecordBatch]:
            sig, row = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(sig, kind="stable")
            sig, row = sig[order], row[order]
            same = sig[1:] == sig[:-1]
            keep = np.r_[False, same] | np.r_[same, False]
            sig, row = sig[keep].view(np.int64), row[keep]
            for a in range(0, len(sig), 1 << 16):
                n = len(sig[a : a + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(sig[a : a + n]), pa.array(row[a : a + n]), *(pa.nulls(n, t) for t in kinds[2:])], fields)

        for b in batches:
            for r, flush, counts, low, doc, *meta in zip(*(b.column(i).to_pylist() for i in range(11))):
                if r != now:
                    if held:
                        yield from shared()
                    now, held = r, []
                if counts is None:
                    n = len(meta[0])
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array((flush << 16) + 2 * np.arange(n)), *(pa.array(m, t) for m, t in zip(meta, kinds[2:]))], fields)
                else:
                    sig, load = unpacked(r, counts, low, doc, low_bytes, 2)
                    held.append((sig, (flush << 16) + columns(load, "<u2")[0].astype(np.int64)))
        if held:
            yield from shared()

    return map_arrow(flushes.repartition("range").sortWithinPartitions("range"), second, MET)


def sketched(texts: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sketch(shingles(t, words)) for t in b.column(2).to_pylist()]
            flat = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lists(flat, np.array(list(map(len, found)), np.int64))], ["node", "n", "text", "sketch"])

    return map_arrow(texts.select("node", "n", "text"), run, "node long, n long, text string, sketch array<long>")


def near(pairs: DataFrame, small: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (head, node) whose sizes and sketches (small: node, n, sketch) allow a link."""
    one = small.select(F.col("node").alias("head"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = small.select("node", F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(one, "head").join(two, "node").filter(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(2).to_numpy() + b.column(3).to_numpy()
            (x, at_x), (y, at_y) = (words_of(b.column(i)) for i in (4, 5))
            keep = []
            for k in range(len(n)):
                p, q = x[at_x[k] : at_x[k + 1]], y[at_y[k] : at_y[k + 1]]
                w = min(len(p), len(q))
                keep.append(int(np.bitwise_count(folded(p, w) ^ folded(q, w)).sum()) * (den + num) <= n[k] * (den - num))
            kept = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["head", "node"])

    return map_arrow(both.select("head", "node", "na", "nb", "sa", "sb"), run, "head long, node long")


def words_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values as one array, and where each row's begin and end."""
    at = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False).view(np.uint64), at


def verified(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, str]:
    """Those of pairs (head, node) whose sets have den * intersection >= num * union, and their table's path.

    Sketches rule out most of the others; what is left is checked by the sets themselves. A head's
    text goes to the group of its pairs once, and each other text once a pair. A head with many pairs
    is salted, so no group grows with it.
    """
    kept, at_kept = written(near(pairs, texts.select("node", "n", "sketch"), num, den), "kept")
    counted = kept.groupBy("head").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))
    full = texts.select("node", "text")
    heads = counted.join(full.withColumnRenamed("node", "head"), "head").select("head", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("node"), "text")
    members = kept.join(counted, "head").select("head", F.pmod(F.xxhash64("node", F.lit(7)), F.col("salts")).cast("int").alias("salt"), "node").join(full, "node").select("head", "salt", "node", "text")
    dealt = heads.unionByName(members).repartition("head", "salt").sortWithinPartitions("head", "salt", F.col("node").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros(0, np.uint64)
        for b in batches:
            out = []
            for head, node, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                t = shingles(text, words)
                if node is None:
                    s = t
                    continue
                both = len(np.intersect1d(s, t, assume_unique=True))
                if den * both >= num * (len(s) + len(t) - both):
                    out.append((head, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["head", "node"])

    links, at_links = written(map_arrow(dealt.select("head", "node", "text"), run, "head long, node long"), "links")
    remove(pairs.sparkSession, at_kept)
    return links, at_links


def across(rows: DataFrame, sketches: DataFrame, num: int, den: int, forest: bool = False) -> DataFrame:
    """Pairs (sig, head, node) of different components in a bucket; sig is null for small buckets.

    rows: sig, m (the bucket's size), lead (its members' least hash), node, root; sketches: node, n, sketch.
    Of small buckets all such pairs come out, a few a member. A larger one is compared by sketches in
    blocks of BLOCK members, each pair of blocks in one task's group, so no group grows with the
    bucket, and only pairs that may be linked come out. Like buckets mostly have one lead: they share
    a group, to which a node's sketch goes once, with the buckets that hold it, and each is compared
    alone there. As a forest a bucket's blocks give only pairs that would join all their components
    that may be linked, if they were links: fewer than they have members, while all pairs are as many
    as their square.
    """
    few = rows.filter(F.col("m") <= SMALL).select("sig", "node", "root")
    other = few.select("sig", F.col("node").alias("far"), F.col("root").alias("far_root"))
    joined = few.join(other, "sig").filter("node > far and root <> far_root").select(F.lit(None).cast("long").alias("sig"), F.col("far").alias("head"), "node").distinct()
    large = rows.filter(F.col("m") > SMALL).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    # Rows here are fewer than those of large by GROUP, as the others have one part.
    parts = large.groupBy("lead", "blocks").agg(F.ceil(F.count("*") / F.lit(GROUP) / F.col("blocks")).cast("int").alias("parts")).filter("parts > 1")
    part = F.pmod(F.xxhash64("sig", F.lit(3)), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    placed = large.join(F.broadcast(parts), ["lead", "blocks"], "left").select("lead", "blocks", part, "node", "root", "sig").repartition("node")
    once = placed.groupBy("lead", "blocks", "part", "node", "root").agg(F.collect_list("sig").alias("sigs")).join(sketches, "node")
    own = F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int")
    spread = once.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["lead", "blocks", "part", "i", "j"]
    keyed = spread.select("lead", "blocks", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "n", "sketch", "sigs")
    dealt = keyed.repartition(*key).sortWithinPartitions(*key, "node")  # by node, so that forests of like buckets have like pairs

    def compare(own: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, sk: list[np.ndarray]) -> Iterator[np.ndarray]:
        two = own.min() != own.max()
        root = root.copy()
        length = np.array(list(map(len, sk)))
        for w in np.unique(length).tolist():
            more = np.flatnonzero((length >= w) & (length <= 4 * w))  # of sizes further apart none are similar
            flat = np.stack([folded(sk[y], w) for y in more])
            for x in np.flatnonzero(length == w).tolist():
                y = more[(root[more] != root[x]) & ((length[more] > w) | (more > x)) & ((own[more] != own[x]) | (not two))]
                y = y[np.minimum(n[y], n[x]) * den >= np.maximum(n[y], n[x]) * num]
                if len(y):
                    apart = np.bitwise_count(flat[np.searchsorted(more, y)] ^ sk[x]).sum(1, dtype=np.int64)
                    may = apart * (den + num) <= (n[y] + n[x]) * (den - num)
                    y, apart = y[may], apart[may]
                    if forest and len(y):  # the likest of each component, which then counts as x's own
                        y = y[np.argsort(apart / (n[y] + n[x]), kind="stable")]
                        y = y[np.unique(root[y], return_index=True)[1]]
                        root[np.isin(root, root[y])] = root[x]
                    yield np.stack([np.minimum(node[y], node[x]), np.maximum(node[y], node[x])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(t: pa.Table) -> pa.RecordBatch:
            out = [np.zeros((3, 0), np.int64)]
            if t.num_rows:
                b = t.combine_chunks().to_batches()[0]
                key = [b.column(c).to_numpy() for c in range(5)]
                group = np.cumsum(np.r_[False, np.logical_or.reduce([k[1:] != k[:-1] for k in key])])
                own, node, root, n = (b.column(c).to_numpy() for c in range(5, 9))
                flat, at = words_of(b.column(9))
                sigs, ends = words_of(b.column(10))
                sigs, of = sigs[ends[0] : ends[-1]].view(np.int64), np.repeat(np.arange(b.num_rows), np.diff(ends))
                order = np.lexsort((sigs, group[of]))  # stable: a bucket's rows stay in order
                sigs, of = sigs[order], of[order]
                cut = np.flatnonzero(np.r_[True, (sigs[1:] != sigs[:-1]) | (group[of[1:]] != group[of[:-1]])])
                for a, e in zip(cut.tolist(), [*cut[1:].tolist(), len(sigs)]):
                    y = of[a:e]
                    if key[3][y[0]] == key[4][y[0]] or own[y].min() != own[y].max():
                        pairs = compare(own[y], node[y], root[y], n[y], [flat[at[k] : at[k + 1]] for k in y.tolist()])
                        out += [np.concatenate([np.full((1, p.shape[1]), sigs[a]), p]) for p in pairs]
            found = np.unique(np.concatenate(out, axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["sig", "head", "node"])

        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            same = np.logical_and.reduce([(k := t.column(c).to_numpy()) == k[-1] for c in range(5)]) if t.num_rows else np.zeros(0, bool)
            last = int(np.argmax(same)) if len(same) else 0  # the open group waits
            yield done(t.slice(0, last))
            held = t.slice(last)
        if held is not None:
            yield done(held)

    return joined.union(map_arrow(dealt, run, "sig long, head long, node long"))


def jaccard_components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text), and th, the text's xxhash64, and root, its component's name.

    Equal sets are one node. Nodes meet in buckets of equal signatures. A node that shares fewer of a
    band's signatures with others than similar sets must share has no link there; and of those it
    shares, all but the last need - 1 in an order that puts large buckets last will do, since similar
    sets then still share one.

    In each of a few rounds every bucket with several components names a head, and each node is
    checked against the head that it shares most buckets with; components grow between rounds. Then
    members of buckets that still hold several components are compared, across components alone, by
    sketches that never rule out a link. What passes is checked by the sets: first, while that finds
    links, one pair for two components of a block, so that a large group of linked texts is joined by
    as many pairs as it has members; at last every pair that is left between components. So no link
    between components is lost.

    A null, empty or blank text has an empty set and is linked with nothing: its component_id is its
    own doc_id. Rows with a null doc_id take part; component_id is the least id that isn't null.
    Repeated rows come out each; other columns are ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    all_, at_all = written(met(docs, words, num, den), "met")
    meta = all_.filter("n is not null").drop("sig")
    pairs = all_.filter("n is null").select("sig", "row")
    later = F.col("row").bitwiseAND(F.lit(1)) == 1
    place = F.col("row").bitwiseAND(F.lit(-2))
    seen = pairs.select("sig", later.alias("later"), place.alias("row")).join(meta.select("row", "node", "need", "need_next"), "row")
    seen = seen.select("sig", "node", "later", F.when(F.col("later"), F.col("need_next")).otherwise(F.col("need")).alias("need")).distinct()
    seen, at_seen = written(seen, "seen")
    held = seen.groupBy("sig").agg(F.count("*").alias("m")).filter("m > 1")
    of_node = Window.partitionBy("node", "later")
    ranked = seen.join(held, "sig").withColumn("c", F.count("*").over(of_node)).withColumn("place", F.row_number().over(of_node.orderBy("m", "sig")))
    # A window's rows are one set's signatures.
    ranked = ranked.filter("place <= c - need + 1").select("sig", "node").distinct()
    ranked, at_ranked = written(ranked, "ranked")
    # Buckets of the same members are one, which counts as many.
    names = [F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]
    of_sig = ranked.groupBy("sig").agg(F.count("*").alias("m"), *names).filter("m > 1")
    unlike = of_sig.groupBy("m", "h1", "h2").agg(F.min("sig").alias("sig"), F.count("*").alias("weight")).select("sig", "weight")
    buckets, at_buckets = written(ranked.join(unlike, "sig"), "buckets")
    remove(spark, at_seen, at_ranked)

    wanted = meta.join(buckets.select("node").distinct(), "node").groupBy("node").agg(F.min(F.struct("th", F.coalesce("doc_id", F.lit(-1)).alias("id"), "n")).alias("x")).select("node", "x.*")
    wanted, at_wanted = written(wanted, "wanted")
    name = F.xxhash64("th", "id").alias("name")
    source = sieved(docs.select(F.xxhash64("text").alias("th"), F.coalesce(F.col("doc_id"), F.lit(-1)).alias("id"), "text").select("*", name), "name", wanted.select(name))
    # By the join's own keys, so that texts aren't moved again; a text has one node.
    texts, at_texts = written(sketched(source.join(wanted, ["th", "id"]).dropDuplicates(["th", "id"]), words), "texts")
    remove(spark, at_wanted)

    found = Found(spark)

    def opened() -> DataFrame:
        placed = found.placed(buckets)
        several = placed.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m"), F.min(F.xxhash64("node", F.lit(11))).alias("lead")).filter("lo < hi").select("sig", "m", "lead")
        return placed.join(several, "sig")

    def checked(pairs: DataFrame) -> bool:
        pairs, at_pairs = written(pairs, "pairs")
        return found.add(pairs, at_pairs, *verified(pairs, texts, words, num, den))

    for r in range(ROUNDS):
        live, at_live = written(opened(), "open") if r else (found.placed(buckets), "")
        head = live.groupBy("sig").agg(F.min_by(F.struct("node", "root"), F.xxhash64("node", F.lit(r))).alias("h"))
        ask = live.join(head, "sig").filter("root <> h.root").groupBy("node", F.col("h.node").alias("head")).agg(F.sum("weight").alias("m"))
        one = found.untried(ask).groupBy("node").agg(F.max_by("head", F.struct("m", "head")).alias("head")).select("head", "node")
        more = checked(one)
        if r:
            remove(spark, at_live)
        if not more:
            break
    more, rest = True, opened()
    for forest in [True] * FORESTS + [False]:
        if not forest or more:
            live, at_live = written(rest, "open")
            named, at_named = written(across(live, texts.select("node", "n", "sketch"), num, den, forest), "across")
            more = checked(found.untried(named.select("head", "node").distinct()))
            found.paths.append(at_named)
            remove(spark, at_live)
            # Small buckets have named all pairs, and a bucket without any has none later either.
            rest = opened().join(named.filter("sig is not null").select("sig").distinct(), "sig", "left_semi")
    remove(spark, at_buckets, at_texts)

    named = meta.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = found.placed(named)
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    per_node = rooted.join(classes, "root").select("node", "root", "component_id")
    rows = meta.select("doc_id", "th", "n", "node")
    full = rows.filter("n > 0").join(per_node, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "th", "root")
    lone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "th", F.lit(None).cast("long").alias("root"))
    out, _ = written(full.unionByName(lone), "classes")
    found.close()
    remove(spark, at_all)
    return out


class Found:
    """What rounds of checks have found: roots of linked nodes, and the pairs that were tried."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []
        self.at_roots: list[str] = []
        self.roots: DataFrame | None = None
        self.tried: DataFrame | None = None

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows with the root of their node."""
        if self.roots is None:
            return rows.withColumn("root", F.col("node"))
        return rows.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def untried(self, pairs: DataFrame) -> DataFrame:
        """pairs (head, node, ...) less those that were tried, either way round."""
        if self.tried is None:
            return pairs
        return pairs.withColumn("lo", F.least("head", "node")).withColumn("hi", F.greatest("head", "node")).join(self.tried, ["lo", "hi"], "left_anti")

    def add(self, pairs: DataFrame, at_pairs: str, links: DataFrame, at_links: str) -> bool:
        """Note pairs (head, node) as tried, and join components by links (head, node), if there are any."""
        tried = pairs.select(F.least("head", "node").alias("lo"), F.greatest("head", "node").alias("hi"))
        self.tried = tried if self.tried is None else self.tried.unionByName(tried)
        self.paths.append(at_pairs)
        more = not links.isEmpty()
        if more:
            ends = self.placed(links.select(F.col("head").alias("node"), F.col("node").alias("other"))).select(F.col("root").alias("a"), F.col("other").alias("node"))
            joined, at_joined = components(self.placed(ends).select("a", F.col("root").alias("b")))
            if self.roots is None:
                self.roots, self.at_roots = joined, at_joined
            else:
                moved = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
                old = self.roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
                roots, at_roots = written(old.unionByName(joined.join(self.roots.select("node"), "node", "left_anti")), "roots")
                remove(self.spark, *at_joined, *self.at_roots)
                self.roots, self.at_roots = roots, [at_roots]
        remove(self.spark, at_links)
        return more

    def close(self) -> None:
        remove(self.spark, *self.paths, *self.at_roots)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("th", "root")
