"""N-gram Jaccard join by parity sketches.

A text is the set of its distinct k-word shingles (a text of fewer words is one
shingle, a text without words or a null text the empty set). Two texts link if
``den * |A and B| >= num * |A or B|`` and neither is empty.

Method. Each shingle flips one bit of a bit sketch, so the sketch is the XOR of
its shingles and the Hamming distance of two sketches is at most the size of
the symmetric difference D. A linked pair has ``D <= (|A|+|B|)(den-num)/(den+num)``.
Sizes fall into bands such that linked sizes lie in one band or in neighbours;
each set takes part in the group of its own band and in that of the next. For a
group with at most d differing bits the sketch is cut into ``d + 1 + s`` blocks:
at least ``s + 1`` blocks agree (pigeonhole), so each set may drop the s blocks
that come first in a fixed order of block contents (lightest first) and still
share a kept block with each partner. Equal kept blocks meet in a shuffle on
the block's key.

Texts with the same set (equal 64-bit fingerprint of it) are one node from the
start, and a task signs each node once, so copies cost nothing beyond their own
profiles. Keys that hold the same nodes are one bucket. A bucket isn't expanded
into all pairs: first its hub (smallest under one of `HUB_SEEDS` hashes) is
verified against its members and components are joined. Buckets whose members
then still lie in different components are searched exhaustively inside numpy, on
the sketches: of the pairs of different components that pass the length bound and
the Hamming bound a spanning forest comes out of each bucket, to be verified on
the full shingle sets (64-bit hashes). Buckets without any such pair are done.
The others are searched once more for all such pairs that are still between
components, without those that were verified before. So each link between
different components is found, and what comes out as rows stays near the number
of nodes.

Hot keys. Keys that a sample of at most about `SAMPLE_NODES` nodes shows to hold
many nodes are dealt to as many tasks as they need; what is hot but isn't found
so is only dealt less evenly. A bucket of more than `TILE` nodes is searched in
tiles: nodes outside its largest component are compared with the nodes of each
tile. Hubs are pre-aggregated minima, joined back.

Only nodes that a pair names have their sets made and shuffled: a bit set of at
most `FILTER_BITS` bits tells which. Tables go as soon as nothing reads them.

Edge cases: each row is a document of its own, linked by its own text, also where
rows share an id; a row with a null id links with nothing and gets a null
component; null and empty texts have no shingles and are their own component;
repeated rows are one node and are returned as often as they came; a very long
text is one set; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connect
from .store import Workspace
from .words import NOT_SPACE, Words, chunks, list_column, map_texts, mix, text_bytes

HUB_SEEDS = 8
BLOCK_BITS = 16
#: Bits of a key; keys that fall together only propose more. Above them a hot key has
#: its salt, and the bit HOT.
KEY_BITS, MOST_SALTS, HOT = 48, 1 << 13, 1 << 62
SAMPLE_NODES, HOT_SAMPLES, SALT_ROWS = 4_000, 20, 5_000
TILE = 2_048
FILTER_BITS = 1 << 27
#: Nodes that a task remembers to have signed.
SIGNED = 200_000


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes sorted within each text, and their text numbers."""
    h = w.hashes()
    g, at = w.grams(k, h)
    text = w.text[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        with np.errstate(over="ignore"):
            whole = np.array([_whole(h[w.first[t] : w.first[t + 1]]) for t in short], np.uint64)
        g, text = np.concatenate([g, whole]), np.concatenate([text, short])
    order = np.lexsort((g, text))
    g, text = g[order], text[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
    return g[new], text[new]


def _whole(h: np.ndarray) -> int:
    out = np.full(1, len(h) + 1000, np.uint64)
    for x in h:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + x)
    return out[0]


def band_edges(num: int, den: int, most: int) -> np.ndarray:
    """Lower edges of the size bands: linked sizes lie in one band or in neighbours."""
    edges = [1, 2]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, (edges[-1] - 1) * den // num + 1))
    edges.append(max(edges[-1] + 1, (edges[-1] - 1) * den // num + 1))
    edges.append(max(edges[-1] + 1, (edges[-1] - 1) * den // num + 1))
    return np.array(edges, np.int64)


def blocks_of_group(edges: np.ndarray, group: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks to keep (most differing bits + 1) and blocks to drop, per group."""
    largest = edges[group + 1] - 1
    keep = 2 * largest * (den - num) // (den + num) + 1
    return keep, np.where(keep > 1, np.maximum(1, (keep + 3) // 4), 0)


def block_keys(g: np.ndarray, text: np.ndarray, size: np.ndarray, group: np.ndarray, edges: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the kept blocks of each text, and the texts' numbers."""
    has = size > 0
    keep, drop = blocks_of_group(edges, group, num, den)
    blocks = np.where(has, keep + drop, 0)
    base = np.concatenate([[0], np.cumsum(blocks)])
    # one bit of the sketch per shingle: block by the high half of its hash, bit by the low half
    x = mix(g ^ np.uint64(0x5851F42D4C957F2D))
    block = ((x >> np.uint64(32)) * blocks[text].astype(np.uint64)) >> np.uint64(32)
    bit = np.sort(((base[text].astype(np.uint64) + block) << np.uint64(BLOCK_BITS)) | (x & np.uint64((1 << BLOCK_BITS) - 1)))
    # a bit flipped an even number of times is off again
    edge = np.flatnonzero(np.concatenate([[True], bit[1:] != bit[:-1]])) if len(bit) else np.zeros(0, np.int64)
    odd = (np.diff(np.concatenate([edge, [len(bit)]])) & 1).astype(bool)
    bit = bit[edge[odd]]
    where = (bit >> np.uint64(BLOCK_BITS)).astype(np.int64)
    content = np.zeros(base[-1], np.uint64)
    weight = np.bincount(where, minlength=base[-1]).astype(np.int64)
    if len(bit):
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        content[where[first]] = np.bitwise_xor.reduceat(mix((bit & np.uint64((1 << BLOCK_BITS) - 1)) + np.uint64(77)), first)
    owner = np.repeat(np.arange(len(size)), blocks)
    number = np.arange(base[-1]) - base[:-1][owner]
    with np.errstate(over="ignore"):
        key = mix(content ^ mix((group[owner].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64)))
    order = np.lexsort((key, -weight, owner))
    rank = np.arange(len(order)) - base[:-1][owner[order]]
    kept = order[rank < keep[owner[order]]]
    return key[kept], owner[kept]


def sketch_words(size: np.ndarray) -> np.ndarray:
    """Sketch length in 64-bit words: a power of two, at least 4 and 2 to 4 bits a shingle."""
    return np.int64(1) << np.maximum(2, np.ceil(np.log2(np.maximum(size, 1) / 32)).astype(np.int64))


def parity_sketch(g: np.ndarray, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits flipped an odd number of times: words of all texts, and words per text."""
    words = sketch_words(size)
    base = np.concatenate([[0], np.cumsum(words)])
    x = mix(g ^ np.uint64(0x2545F4914F6CDD1D))
    at = base[text] * 64 + (x & (words[text].astype(np.uint64) * np.uint64(64) - np.uint64(1))).astype(np.int64)
    on = (np.bincount(at, minlength=base[-1] * 64) & 1).astype(np.uint8)
    return np.packbits(on, bitorder="little").view(np.int64), words


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch (rows of words) as it would be at a smaller power of two."""
    while sketch.shape[1] > words:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def _profile(k: int):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(*text_bytes(batch.column(1)), NOT_SPACE)
        g, text = shingle_sets(w, k)
        size = np.bincount(text, minlength=w.texts).astype(np.int64)
        sk, words = parity_sketch(g, text, size)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size), pa.array(fingerprint(g, text, size)), list_column(sk, words, pa.int64())], ["id", "h", "n", "fp", "sketch"])

    return fn


def fingerprint(g: np.ndarray, text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each text's set and of its size."""
    sums = np.zeros((2, len(size)), np.uint64)
    at = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        for i, salt in enumerate((0x1234567, 0xABCDEF)):
            if len(at):
                sums[i, text[at]] = np.add.reduceat(mix(g ^ np.uint64(salt)), at)
        return mix(mix(sums[0]) * np.uint64(0x9E3779B97F4A7C15) + sums[1] + mix(size.astype(np.uint64))).view(np.int64)


def _signatures(k: int, num: int, den: int):
    """Keys of texts, each different set once a task."""
    signed: set[int] = set()

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(*text_bytes(batch.column(0)), NOT_SPACE)
        g, text = shingle_sets(w, k)
        size = np.bincount(text, minlength=w.texts).astype(np.int64)
        fp = fingerprint(g, text, size)
        if len(signed) > SIGNED:
            signed.clear()
        new = np.zeros(w.texts, bool)
        for i, x in enumerate(fp.tolist()):
            if size[i] and x not in signed:
                signed.add(x)
                new[i] = True
        of_new = new[text]
        g, text, size = g[of_new], text[of_new], np.where(new, size, 0)
        edges = band_edges(num, den, int(size.max(initial=1)))
        band = np.searchsorted(edges, np.maximum(size, 1), side="right") - 1
        parts = [block_keys(g, text, size, band + step, edges, num, den) for step in (0, 1)]
        keys = np.concatenate([x[0] for x in parts]) & np.uint64((1 << KEY_BITS) - 1)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fp[np.concatenate([x[1] for x in parts])])], ["key", "fp"])

    return fn


def _filter_places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    x = mix(h.view(np.uint64))
    return [((x >> np.uint64(s)) % np.uint64(bits)).astype(np.int64) for s in (0, 31)]


def bit_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit set (two bits each) that the longs of `ids` are in, made in pieces of 4 kB."""

    def places(batches):
        for b in batches:
            at = np.concatenate(_filter_places(b.column(0).to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(at))], ["at"])

    at = ids.mapInArrow(places, "at long")
    pieces = at.groupBy(F.expr("bitmap_bucket_number(at + 1)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at + 1))").alias("b")).toArrow()
    out = np.zeros(-(-bits // 32_768) * 4_096, np.uint8)
    for n, b in zip(pieces["n"].to_pylist(), pieces["b"].to_pylist(), strict=True):
        out[(n - 1) * 4_096 : n * 4_096] = np.frombuffer(b, np.uint8)
    return out


def _maybe_in(h: np.ndarray, held: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(h), bool)
    for at in _filter_places(h, bits):
        out &= (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def _sets(k: int, held, bits: int):
    """Sets of the texts whose ids the bit set may hold."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(_maybe_in(batch.column(0).to_numpy(), held.value, bits)))
            for part in chunks(batch, "text"):
                w = Words(*text_bytes(part.column(1)), NOT_SPACE)
                g, text = shingle_sets(w, k)
                size = np.bincount(text, minlength=w.texts).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(fingerprint(g, text, size)), list_column(g.view(np.int64), size, pa.int64())], ["fp", "shingles"])

    return run


def near_pairs(n: np.ndarray, component: np.ndarray, sketches: list[np.ndarray], num: int, den: int, forest: bool, asks: np.ndarray, tile: np.ndarray, here: int) -> tuple[list[int], list[int]]:
    """Pairs of different components within both bounds: a spanning forest of them, or all.

    Rows that ask are compared with the rows of tile `here`; of two rows that both
    ask only one does, so that a pair is compared once over all tiles.
    """
    words = min(len(x) for x in sketches)
    by_words: dict[int, list[int]] = {}
    for i, x in enumerate(sketches):
        by_words.setdefault(len(x), []).append(i)
    level = np.zeros((len(n), words), np.int64)
    for rows in by_words.values():
        level[rows] = folded(np.stack([sketches[i] for i in rows]), words)
    level = level.view(np.uint64)  # numpy counts the bits of a signed number's absolute value
    c = component.copy()
    rank = np.where(tile == here, np.arange(len(n)), np.where(tile < here, -1, len(n)))
    left, right = [], []
    for i in np.flatnonzero(asks):
        j = np.flatnonzero((c != c[i]) & (tile == here) & (~asks | (rank > rank[i])) & (den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i])))
        j = j[np.bitwise_count(level[j] ^ level[i]).sum(axis=1, dtype=np.int64) <= (n[j] + n[i]) * (den - num) // (den + num)]
        if not len(j):
            continue
        if forest:
            joined, first = np.unique(c[j], return_index=True)
            j = j[first]
            c[np.isin(c, joined)] = c[i]
        left += [int(i)] * len(j)
        right += j.tolist()
    return left, right


def _search(num: int, den: int, forest: bool):
    """Near pairs of each bucket and tile; rows come sorted by (bucket, here)."""

    def run(batches):
        held: list = []
        key = None

        def done() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            component = rows["component"].to_numpy()
            a = b = np.zeros(0, np.int64)
            if (component != component[0]).any():
                fp = rows["fp"].to_numpy()
                sketches = rows["sketch"].combine_chunks()
                flat, off = sketches.flatten().to_numpy(), sketches.offsets.to_numpy() - sketches.offsets[0].as_py()
                each = [flat[x:y] for x, y in zip(off[:-1], off[1:], strict=True)]
                i, j = near_pairs(rows["n"].to_numpy(), component, each, num, den, forest, rows["asks"].to_numpy(), rows["tile"].to_numpy(), key[1])
                a, b = fp[i].astype(np.int64), fp[j].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), key[0], np.int64)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["bucket", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(x).to_numpy() for x in range(2)]
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1
            cuts = [0, *cut.tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                here = tuple(int(x[lo]) for x in keys)
                if held and here != key:
                    yield done()
                    held = []
                key = here
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield done()

    return run


def hot_keys(base: DataFrame, nodes: int, k: int, num: int, den: int) -> DataFrame:
    """(key, salts): keys that many nodes hold, by a sample, and into how many parts
    to deal them. The sample's size bounds the rows."""
    share = max(1, nodes // SAMPLE_NODES)
    sample = base.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select("text")
    seen = map_texts(sample, _signatures(k, num, den), "key long, fp long").distinct().groupBy("key").agg(F.count("*").alias("n"))
    return seen.where(F.col("n") >= HOT_SAMPLES).select("key", F.least(F.ceil(F.col("n") * share / SALT_ROWS), F.lit(MOST_SALTS)).cast("int").alias("salts")).where("salts > 1")


def buckets(work: Workspace, base: DataFrame, nodes: int, k: int, num: int, den: int) -> DataFrame:
    """(bucket, fp): nodes that share a key, each combination of nodes once."""
    sig = map_texts(base.select("text"), _signatures(k, num, den), "key long, fp long")
    if nodes > SALT_ROWS:
        hot = work.table(hot_keys(base, nodes, k, num, den), "hot")
        salted = F.col("key") + F.shiftleft(F.pmod(F.xxhash64("fp"), F.col("salts")), KEY_BITS) + F.lit(HOT)
        sig = sig.join(F.broadcast(hot), "key", "left").select(F.when(F.col("salts").isNull(), F.col("key")).otherwise(salted).alias("key"), "fp")
    over = Window.partitionBy("key")
    held = sig.select("key", "fp", (F.col("key") >= HOT).alias("hot"), F.min("fp").over(over).alias("low"), F.max("fp").over(over).alias("high"), F.bit_xor(F.xxhash64("fp")).over(over).alias("all")).where("hot or low < high")
    return held.select(F.when(F.col("hot"), F.col("key").bitwiseAND(F.lit((1 << KEY_BITS) - 1))).otherwise(F.xxhash64("low", "high", "all")).alias("bucket"), "fp").distinct()


def jaccard_classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, n_shingles, component_id (smallest id reachable by
    links), n_links (links of the row's set that were verified; links implied by a
    common component aren't looked for) and text_hash (xxhash64 of the text)."""
    spark = docs.sparkSession
    work = Workspace(spark, "parity")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = base.where("id is not null")
    hashed = base.select("id", "text", F.xxhash64("text").alias("h"))
    profile = work.table(map_texts(hashed, _profile(k), "id long, h long, n long, fp long, sketch array<long>"), "profile")
    rows = profile.count()
    own = profile.where("n > 0 and id is not null")
    # one node for each distinct set
    nodes = work.table(own.groupBy("fp").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes", 8 * rows)
    of_rows = work.table(profile.select("id", "h", "n", "fp"), "rows", rows)
    work.drop(profile)
    n_nodes = nodes.count()
    members = work.table(buckets(work, known, n_nodes, k, num, den), "members")
    order = F.xxhash64("fp", F.pmod("bucket", F.lit(HUB_SEEDS)))
    hubs = members.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "fp")).alias("h"), F.count("*").alias("size")).where("size > 1")
    hubs = work.table(hubs.select("bucket", F.col("h.fp").alias("hub"), "size"), "hubs", n_nodes)

    def verified(pairs: DataFrame) -> DataFrame:
        """Of node pairs (a, b), those that link."""
        n_pairs = pairs.count()
        if not n_pairs:
            return pairs
        ends = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
        wanted = nodes.join(ends, "fp", "left_semi").select("id")
        bits = min(FILTER_BITS, max(1 << 15, 1 << (32 * n_pairs).bit_length()))
        held = spark.sparkContext.broadcast(bit_filter(wanted, bits))
        sets = known.mapInArrow(_sets(k, held, bits), "fp long, shingles array<long>").dropDuplicates(["fp"])
        sets = work.table(sets.join(ends, "fp", "left_semi"), "sets")
        both = pairs.join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("set_b")), "b").join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("set_a")), "a")
        common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
        out = work.table(both.where(common * den >= (F.size("set_a") + F.size("set_b") - common) * num).select("a", "b"), "links", 40 * n_pairs)
        work.drop(sets)
        held.destroy()
        return out

    # stars
    star = members.join(hubs, "bucket").where("fp <> hub").select(F.least("hub", "fp").alias("a"), F.greatest("hub", "fp").alias("b")).distinct()
    left = nodes.select(F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    right = nodes.select(F.col("fp").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    # linked sizes differ by less than a factor of two, so one fold levels two sketches
    half = "if(size({0}) > size({1}), zip_with(slice({0}, 1, size({0}) div 2), slice({0}, size({0}) div 2 + 1, size({0}) div 2), (x, y) -> x ^ y), {0})"
    apart = F.expr(f"aggregate(zip_with({half.format('sketch_a', 'sketch_b')}, {half.format('sketch_b', 'sketch_a')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    near = F.expr(f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)")
    tried = star.join(left, "a").join(right, "b").where(near).where(apart <= F.expr(f"(n_a + n_b) * {den - num} div {den + num}")).select("a", "b")
    tried = work.table(tried, "tried", 8 * n_nodes)
    links = verified(tried)
    labels = connect(work, links)

    # what stars leave open: buckets of more than a pair that hold several components
    open_ = hubs.where("size > 2").select("bucket", "size")
    for forest in (True, False):
        placed = members.join(open_, "bucket").join(labels.withColumnRenamed("id", "fp"), "fp", "left").select("bucket", "size", "fp", F.coalesce("component", "fp").alias("component"))
        # one of two different components isn't the bucket's largest: its rows ask, in all tiles
        by_part = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
        apart_ = by_part.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("bucket", F.col("main.component").alias("main"))
        tiles = F.ceil(F.col("size") / TILE).cast("int")
        placed = placed.join(apart_, "bucket").withColumns({"tiles": tiles, "asks": F.col("component") != F.col("main")}).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
        placed = placed.select("bucket", "fp", "component", "asks", "tile", F.explode(F.expr("if(asks, sequence(0, tiles - 1), array(tile))")).alias("here"))
        dealt = placed.join(nodes.select("fp", "n", "sketch"), "fp").select("bucket", "here", "tile", "asks", "fp", "n", "component", "sketch").repartition("bucket", "here").sortWithinPartitions("bucket", "here", "fp")
        found = work.table(dealt.mapInArrow(_search(num, den, forest), "bucket long, a long, b long"), "found")
        if found.isEmpty():
            break
        more = verified(work.table(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs", 8 * n_nodes))
        # a bucket without a near pair of different components is done
        open_ = open_.join(found.select("bucket").distinct(), "bucket", "left_semi")
        if forest:
            tried = work.table(tried.union(found.select("a", "b")).distinct(), "tried", 8 * n_nodes)
        if not more.isEmpty():
            links = links.union(more)
            labels = connect(work, more, labels)
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    found = labels.withColumnRenamed("id", "fp").join(degree, "fp", "left")
    placed = of_rows.where("n > 0 and id is not null").join(found, "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    classes = work.table(placed.groupBy("fp", "component", "n_links").agg(F.min("id").alias("id")), "classes", rows)
    least = classes.groupBy("component").agg(F.min("id").alias("component_id"))
    classes = classes.join(least, "component").select("fp", "component_id", "n_links")
    out = of_rows.withColumn("fp", F.when(F.expr("n > 0 and id is not null"), F.col("fp"))).join(classes, "fp", "left")
    out = work.table(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("h").alias("text_hash")), "out", rows)
    work.drop(nodes, members, hubs, tried, of_rows)
    return out
