"""MinHash near-duplicates with odd sketches.

Documents with equal shingle sets collapse into one class before anything is paired. Classes meet in LSH bands; each is
paired with the first of its bucket only, and the pair is judged by odd sketches: parity bitmaps of the MinHash samples,
whose XOR population count estimates a high Jaccard similarity closely. Pairs that may be somewhat alike tie classes into
families. A family is cut into blocks of bounded size; a task holds two blocks, where the odd sketches pick the candidates
of a class among those it isn't united with yet, the full sets confirm them, and the task returns links that span what it
has found. A family of several blocks is first held against a few of its own classes, its pivots: each block meets them in
one task. Classes that are united by then needn't meet, so that only those outside of the family's largest component (none,
in a family of copies of one text) go on to meet all blocks. So all pairs of a family are decided, and none is ever a row.

Defined results: null or empty text has an empty set and is linked with nothing; fewer words than a shingle make one
shingle of the whole text; repeated rows each get a row; a null doc_id is its own document, and reaches the smallest
non-null doc_id of its component. Ties need no rule, as a component's id is a minimum. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import WordHashes, cut, give_back, mix, releasing, windows

SKETCH_BITS = 512
#: A pair is confirmed on full sets while its estimate is above the threshold less this: five standard deviations at 160 samples.
MARGIN = 0.15
#: Classes belong to one family while their estimate is above the threshold less this. A link is lost only if a class this
#: far from both its ends comes first in each of the buckets they share (14 of 32 on average at 0.85).
FAMILY_MARGIN = 0.45
#: Families are first made from this share of the bands; the rest pairs only classes that are still apart.
FIRST_BANDS = 4
#: Bytes of shingles in a block of a family, about.
BLOCK_BYTES = 4 << 20
#: Classes that a family of several blocks is held against before its blocks meet.
PIVOTS = 16
EDGES_A_TASK = 200_000
#: Classes of families (about 150 bytes each) up to which they are broadcast to the documents.
BROADCAST_CLASSES = 50_000
#: The block of pivots.
PIVOT = -1
_WORDS = WordHashes()


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; ASCII letters are lower-cased, words end at ASCII blanks."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = _WORDS.of(words)
    return np.unique(windows(h, k)) if len(words) >= k else windows(h, len(words)) ^ np.uint64(len(words))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of a*x+b over the set, for each hash function; long sets go in blocks."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        np.minimum(least, (a[:, None] * shingles[None, i : i + 4096] + b[:, None]).min(axis=1), out=least)
    return least


def odd_sketch(signatures: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples of each row, as 64-bit words."""
    n, k = signatures.shape
    at = (mix(signatures ^ (np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(64 - 9)).astype(np.int64)
    odd = np.bincount((at + np.arange(n)[:, None] * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, SKETCH_BITS), axis=1).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    a, b = _coefficients(bands * rows)
    for batch in batches:
        texts = batch.column(0)
        for at in range(0, len(texts), 512):
            sizes, keys, sigs = [], [], []
            for t in texts[at : at + 512].to_pylist():
                s = shingle_set(t, k)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s, a, b))
            sig = np.array(sigs)
            band = sig.reshape(len(sig), bands, rows)
            acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), band.shape[:2]).copy()
            for i in range(rows):
                acc = mix(acc + band[:, :, i])
            listed = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.int64()))
            carried = [c[at : at + 512] for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([*carried, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), listed(acc.view(np.int64)), listed(odd_sketch(sig))], [*batch.schema.names[1:], "n_shingles", "set_key", "bands", "sketch"])


def estimates(sketch: np.ndarray, sketches: np.ndarray, samples: int) -> np.ndarray:
    """Similarity of one odd sketch to each of several."""
    differ = np.bitwise_count((sketches ^ sketch).view(np.uint64)).sum(axis=1, dtype=np.int64)  # of unsigned words: NumPy counts the bits of absolute values
    return 1 + np.log(np.maximum(1 - 2 * differ / SKETCH_BITS, 1e-9)) * (SKETCH_BITS / (4 * samples))


def _links(table: pa.Table, k: int, num: int, den: int, samples: int) -> pa.Table:
    """Links (u, v) that span the components of two blocks (or one): texts of the classes of blocks lo and hi.

    Classes of one part are united already. Block PIVOT, as lo, meets itself as well.
    """
    seen: dict[int, tuple] = {}
    rows = zip(*(table[c].to_pylist() for c in ("node", "block", "part", "set_key", "text")), table["sketch"].to_pylist(), strict=True)
    for node, block, part, key, text, sketch in rows:
        s = shingle_set(text, k)
        if node not in seen and xxhash.xxh3_128_digest(s.tobytes()) == key:  # else a row repeated, or another text under the doc_id
            seen[node] = (block, s, sketch, part)
    nodes = np.array(sorted(seen), np.int64)
    lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
    block = np.array([seen[n][0] for n in nodes.tolist()])
    sets = [seen[n][1] for n in nodes.tolist()]
    sketches = np.array([seen[n][2] for n in nodes.tolist()], np.int64).reshape(len(nodes), -1)
    label = np.unique(np.array([seen[n][3] for n in nodes.tolist()], np.int64), return_inverse=True)[1]
    del seen
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    _, flat = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_inverse=True)
    mark = np.zeros(len(flat) + 1, bool)
    within = np.array([lo == hi or lo == PIVOT and b == PIVOT for b in block], bool)
    out = []
    for x in np.flatnonzero(block == lo):
        others = np.flatnonzero((label != label[x]) & np.where(within, np.arange(len(nodes)) > x, block == hi))
        others = others[(np.minimum(sizes[others], sizes[x]) * den >= np.maximum(sizes[others], sizes[x]) * num)]  # a smaller set cannot hold enough
        others = others[estimates(sketches[x], sketches[others], samples) >= num / den - MARGIN]
        if not len(others):
            continue
        mine = flat[starts[x] : starts[x] + sizes[x]]
        mark[mine] = True
        if len(others) > 8:
            common = np.add.reduceat(mark[flat], starts, dtype=np.int64)[others]
        else:
            common = np.array([mark[flat[starts[y] : starts[y] + sizes[y]]].sum() for y in others])
        mark[mine] = False
        for y in others[common * den >= (sizes[x] + sizes[others] - common) * num]:
            if label[y] != label[x]:
                out.append((nodes[x], nodes[y]))
                label[label == label[y]] = label[x]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    del sets, sketches, flat, mark
    if table.nbytes > 1 << 20:
        give_back()
    return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node each node of the edges (u, v) reaches, by alternating large and small stars until only stars are left."""
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while True:
        side = lambda x: e.select(F.col(x).alias("node"), F.lit(int(x == "u")).alias("up"), F.lit(x == "v").alias("down"))  # noqa: E731, B023
        per = side("u").unionByName(side("v")).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        n, more = per.agg(F.coalesce(F.sum("up"), F.lit(0)), F.coalesce(F.max((F.col("up") > 1) | (F.col("up") > 0) & F.col("down")), F.lit(False))).first()
        e = e.coalesce(1 + n // EDGES_A_TASK)
        if not more:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        down = large.where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        e = cut(small.where("u <> v").distinct())


def _families(classes: DataFrame, bands: int, num: int, den: int, samples: int) -> DataFrame:
    """(node, label): families of classes that share buckets with a hub that is somewhat alike."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"))
    differ = sum((F.bit_count(F.col("su")[i].bitwiseXOR(F.col("sv")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    share = 1 - 2 * differ / F.lit(float(SKETCH_BITS))
    estimate = F.when(share > 0, 1 + F.log(share) * (SKETCH_BITS / (4.0 * samples))).otherwise(0.0)
    labels, edges = None, None
    for first, n in ((1, FIRST_BANDS), (1 + FIRST_BANDS, bands - FIRST_BANDS)):
        own = classes.select("node", F.slice("bands", first, n).alias("bands"))
        own = own.withColumn("label", F.col("node")) if labels is None else own.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        members = own.select("node", "label", F.explode("bands").alias("bucket"))
        hubs = members.groupBy("bucket").agg(F.min(F.struct("label", "node")).alias("x"), F.max("label").alias("high")).where("x.label < high").select("bucket", F.col("x.node").alias("u"), F.col("x.label").alias("of_hub"))
        pairs = members.join(hubs, "bucket").where("label <> of_hub").select("u", F.col("node").alias("v")).distinct()
        near = pairs.join(side("v"), "v").join(side("u"), "u").where(estimate >= num / den - FAMILY_MARGIN).select("u", "v")
        edges = near if labels is None else near.union(labels.select(F.col("node").alias("u"), F.col("label").alias("v")))
        labels = cut(components(edges))
    return labels


def _confirmed(classes: DataFrame, families: DataFrame, docs: DataFrame, k: int, num: int, den: int, samples: int) -> DataFrame:
    """Links (u, v) between classes, enough to span the components of every family."""
    own = classes.select("node", "set_key", "sketch", "n_shingles", F.col("doc_id").alias("rep"), "rep_key").join(families, "node")
    own = cut(_blocks(own, "block", "blocks"))
    n, most = own.agg(F.count("*"), F.max("blocks")).first()
    texts = lambda rows: docs.join(F.broadcast(rows) if n <= BROADCAST_CLASSES else rows, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.xxhash64("text") == F.col("rep_key")))
    meet = lambda meets: meets.groupBy("label", "lo", "hi").applyInArrow(lambda t: _links(t, k, num, den, samples), "u long, v long")
    shipped = lambda rows, lo, hi, block="block": texts(rows).select("label", lo.alias("lo"), hi.alias("hi"), "node", F.col(block).alias("block"), "part", "set_key", "sketch", "text")
    upto = lambda first, last: F.explode(F.sequence(F.lit(first), last - 1))

    own = own.withColumn("part", F.col("node"))
    if (most or 1) == 1:
        return meet(shipped(own, F.col("block"), F.col("block")))
    large = own.where("blocks > 1")
    pivots = cut(large.groupBy("label", F.pmod(F.xxhash64("node", F.lit(PIVOTS)), F.lit(PIVOTS))).agg(F.min("node").alias("node")).select("node"))
    to_all = own.join(pivots, "node", "left_semi").withColumn("other", upto(0, F.col("blocks"))).withColumn("block", F.lit(PIVOT))
    rest = own.join(pivots, "node", "left_anti")
    first = shipped(rest, F.when(F.col("blocks") > 1, PIVOT).otherwise(F.col("block")), F.col("block"))
    links = cut(meet(first.unionByName(shipped(to_all, F.lit(PIVOT), F.col("other")))))

    parts = components(links).select("node", F.col("label").alias("joined"))
    large = cut(large.join(parts, "node", "left").withColumn("part", F.coalesce("joined", "part")).drop("joined"))
    weights = large.groupBy("label", "part").agg(F.sum("n_shingles").alias("weight"))
    main = weights.groupBy("label").agg(F.max_by("part", F.struct("weight", "part")).alias("main"))
    large = large.join(main, "label")
    apart = cut(_blocks(large.where("part <> main"), "block", "apart"))  # classes outside of their family's largest component
    if apart.isEmpty():
        return links
    counts = apart.groupBy("label").agg(F.max("apart").alias("apart"))
    held = large.where("part = main").join(counts, "label").withColumn("block", F.col("apart") + F.col("block")).withColumn("other", upto(0, F.col("apart")))
    loose = apart.withColumn("other", upto(0, F.col("apart") + F.col("blocks")))
    both = loose.unionByName(held.select(*loose.columns))
    return links.unionByName(meet(shipped(both, F.least("block", "other"), F.greatest("block", "other"))))


def _blocks(own: DataFrame, block: str, blocks: str) -> DataFrame:
    """own with the number of blocks that its family (label) is cut into, and the block of each class."""
    sizes = own.groupBy("label").agg(F.ceil(F.sum("n_shingles") * 8 / BLOCK_BYTES).cast("int").alias(blocks))
    return own.join(sizes, "label").withColumn(block, F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int"))


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: tuple[int, int] = (80, 100), bands: int = 32, rows: int = 5, keys: tuple[str, ...] = ("doc_id",), labelled: bool = False) -> DataFrame:
    """keys, n_shingles, component_id (smallest doc_id reachable), kept, for each row of docs (keys, of which doc_id is one, and text).

    Two documents are linked when threshold[1] * intersection >= threshold[0] * union of their shingle sets. With
    labelled also label, one number for the rows of a component and null for rows without words.
    """
    num, den = threshold
    docs = docs.select(F.col("text").cast("binary").alias("text"), *(F.col(k).cast("long").alias(k) for k in keys))
    named_keys = ", ".join(f"`{k}` long" for k in (*keys, "rep_key"))
    each = cut(docs.withColumn("rep_key", F.xxhash64("text")).mapInArrow(releasing(_sketches, k=shingle, bands=bands, rows=rows), f"{named_keys}, n_shingles long, set_key binary, bands array<long>, sketch array<long>"))
    filled = each.where("set_key is not null")
    best = F.min_by(F.struct("n_shingles", "bands", "sketch", "rep_key"), F.coalesce("doc_id", F.lit(2**63 - 1)))
    classes = filled.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), best.alias("x")).select("set_key", "doc_id", "x.*")
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))

    samples = bands * rows
    families = _families(classes, bands, num, den, samples)
    labels = components(_confirmed(classes, families, docs.select("doc_id", "text"), shingle, num, den, samples))
    named = classes.select("set_key", "doc_id", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "label").select("set_key", "component_id", "label")
    out = each.select(*keys, "n_shingles", "set_key").join(named, "set_key", "left")
    of = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(*keys, "n_shingles", of.alias("component_id"), F.col("doc_id").eqNullSafe(of).alias("kept"), *["label"] * labelled)
