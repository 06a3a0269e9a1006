"""SimHash near-dedup with a bit-sliced Hamming search.

Fingerprints: 64 majority bits over the XXH64 values of all word shingles of the whole text.
Search, exact for every pair: two fingerprints within ``radius`` 2 agree on at least one of three
blocks of bits, so distinct fingerprints are grouped by (block, its bits). In a group the
fingerprints are laid out as bit planes (64 candidates to a machine word); a query's bits are
compared with the planes one after the other, carry-save counters hold 64 distances at a time,
and a block of 64 candidates is abandoned once all its counters exceed the radius.

Groups above ``max_bucket`` fingerprints take another exact way that gathers nothing: each
fingerprint stands for the 65 values at distance 0 or 1, and two fingerprints share one of these
exactly if they differ in 2 bits or fewer, so a minimum per value (combined map-side) links them.

``keep_one``, the pipeline's stage, links texts whose sets of distinct five-word shingles are alike
to 0.8 (Jaccard), and verifies every link on the whole sets. Candidates come in two steps:

1. Prefix filter, complete at any size of the table: shingles are ordered by how often they occur
   (a sketch of fixed size, exact order whatever its noise), rarest first; of sets of n shingles
   alike to 0.8 the first n - ceil(0.8 n) + 1 share one. So a passage that many documents share
   stands last and joins nothing, unless it is most of a text.
2. In each such bucket 256-bit SimHash fingerprints are compared bit-sliced, within a radius of
   WIDE_RADIUS: 5 standard deviations above the mean of pairs at 0.8 (a pair at exactly 0.8 is lost
   with a chance of 3e-7; 7e-4 in the extreme of 4 shingles against 5). Buckets above
   ``max_bucket`` are compared block against block, each two blocks a task of their own.

The components of step 2 are clusters; a cluster's texts meet once (large clusters in pairs of
blocks bounded by their shingles) and are linked there by exact counts of common shingles.

Defined results: null or word-less text has fingerprint zero, which links like any other (and all
such texts are copies of one another for ``keep_one``); very long texts are read whole, one at a
time, and weigh by their shingles when blocks are dealt; equal rows share a component; repeated
doc_ids give one row each; of ties for a component's name the least doc_id wins, a null one sorts
after all others; an empty table gives an empty result; other columns are ignored by
``near_duplicates`` and kept by ``keep_one``. Shingles and sets are named by 64-bit hashes.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import digest, discard, materialize, read, row_mark, slices, take_rows, tidied

RADIUS = 2
WIDE_RADIUS = 68
#: counters of the shingle sketch, 2 ** bits: what the driver and the tasks hold of it is 256 KiB
SKETCH_BITS = 18
_ONE = np.uint64(1)


def fingerprint(data: bytes, width: int = 3) -> int:
    """SimHash of one UTF-8 text; bytes.lower() changes A-Z only, bytes.split() cuts at ASCII white space."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, 42) for s in shingles], np.uint64)
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 255):  # so many ones fit a byte
        bits = np.unpackbits(h[k : k + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """Every document as a struct ``doc`` beside ``fp``, the 64 bits as a signed long."""
    packed = docs.select(F.struct(*docs.columns).alias("doc"))
    kind = packed.schema["doc"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            doc = batch.column(0)
            texts = doc.field("text").cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(x or b"", width) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([doc, pa.array(fp)], names=["doc", "fp"])

    return packed.mapInArrow(tidied(run), f"doc {kind}, fp long")


def _near(values: np.ndarray, starts: np.ndarray, radius: int, units: int):
    """Index pairs (query, candidate), query > candidate, within ``radius`` inside each group, for
    ``units`` queries against 64 candidates at a time.

    values: uint64, group after group, in rows of several for longer fingerprints; starts: first
    index of each group, with the end last."""
    values = values.reshape(len(values), -1)
    width = 64 * values.shape[1]
    sizes = np.diff(starts)
    blocks = -(-sizes // 64)
    first = np.concatenate([[0], np.cumsum(blocks)])
    # lane of each value: its block and the place in it
    group = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values)) - starts[group]
    block, lane = first[group] + place // 64, (place % 64).astype(np.uint64)
    planes = np.zeros((width, int(first[-1])), np.uint64)
    edge = np.flatnonzero(np.diff(block, prepend=-1))
    for b in range(width):
        planes[b] = np.bitwise_or.reduceat(((values[:, b // 64] >> np.uint64(b % 64)) & _ONE) << lane, edge)
    valid = np.bitwise_or.reduceat(_ONE << lane, edge)
    # units of work: a query against each block of its group up to its own
    per = place // 64 + 1
    query = np.repeat(np.arange(len(values)), per)
    against = first[group[query]] + (np.arange(len(query)) - np.repeat(np.cumsum(per) - per, per))
    for k in range(0, len(query), units):
        q, c = query[k : k + units], against[k : k + units]
        # in the query's own block, only candidates before it
        live = valid[c] & np.where(c == block[q], (_ONE << lane[q]) - _ONE, ~np.uint64(0))
        levels = [np.zeros(len(q), np.uint64) for _ in range(max(1, radius.bit_length()))]
        over = ~live
        for b in range(width):
            carry = planes[b][c] ^ (np.uint64(0) - ((values[q, b // 64] >> np.uint64(b % 64)) & _ONE))
            for n, level in enumerate(levels):
                levels[n], carry = level ^ carry, level & carry
            over |= carry
            if b % 8 == 7:
                far = over | _above(levels, radius)
                on = far != ~np.uint64(0)
                if not on.all():  # the others' blocks are abandoned
                    q, c, over, levels = q[on], c[on], over[on], [x[on] for x in levels]
                if not len(q):
                    break
        if len(q):
            near = ~(over | _above(levels, radius))
            bits = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            u, at = np.nonzero(bits)
            yield q[u], starts[group[q[u]]] + (c[u] - first[group[q[u]]]) * 64 + at


def bit_sliced_links(values: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``_near``."""
    found = list(_near(values, starts, radius, 1 << 18))
    none = np.zeros(0, np.int64)
    return (np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])) if found else (none, none)


def bit_sliced_roots(values: np.ndarray, starts: np.ndarray, radius: int) -> np.ndarray:
    """Least index that chains of ``_near`` pairs reach from each; holds few pairs at a time."""
    root = np.arange(len(values))
    for a, b in _near(values, starts, radius, 1 << 13):
        a, b = root[a], root[b]
        if (a != b).any():
            root = roots(len(values), a[a != b], b[a != b])[root]
    return root


def _above(levels: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter, least significant level first, is above ``radius``."""
    above, equal = np.zeros_like(levels[0]), ~np.zeros_like(levels[0])
    for n in reversed(range(len(levels))):
        if radius >> n & 1:
            equal &= levels[n]
        else:
            above |= equal & levels[n]
            equal &= ~levels[n]
    return above


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n nodes over the edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _masks(parts: int) -> list[int]:
    edges = [64 * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linker(radius: int):
    """Reads rows (fp, m, bits) sorted by bucket and gives each bucket's links as a star (u, v)."""

    def flush(fp, m, bits):
        cut = np.flatnonzero((m[1:] != m[:-1]) | (bits[1:] != bits[:-1])) + 1
        root = roots(len(fp), *bit_sliced_links(fp.view(np.uint64), np.concatenate([[0], cut, [len(fp)]]), radius))
        moved = np.flatnonzero(root != np.arange(len(fp)))
        u, v = fp[moved], fp[root[moved]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            held = got if held is None else [np.concatenate(x) for x in zip(held, got)]
            if len(held[0]) < 1 << 16:
                continue
            fp, m, bits = held
            # the last bucket may go on in the next batch
            before = np.flatnonzero((m != m[-1]) | (bits != bits[-1]))
            if len(before):
                end = int(before[-1]) + 1
                yield flush(fp[:end], m[:end], bits[:end])
                held = [x[end:] for x in held]
        if held is not None and len(held[0]):
            yield flush(*held)

    return run


def links(distinct: DataFrame, max_bucket: int = 512) -> DataFrame:
    """Edges (u, v), u > v as longs, that connect exactly the fingerprints ``fp`` of ``distinct``
    which chains of distances up to RADIUS connect."""
    keyed = distinct.select(
        "fp", F.explode(F.array(*(F.struct(F.lit(k).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("bits")) for k, mask in enumerate(_masks(RADIUS + 1))))).alias("b")
    ).select("fp", "b.m", "b.bits")
    sizes = materialize(keyed.groupBy("m", "bits").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    members = keyed.join(sizes, ["m", "bits"])

    sliced = (
        members.where(F.col("n") <= max_bucket)
        .select("fp", "m", "bits")
        .repartition("m", "bits")
        .sortWithinPartitions("m", "bits", "fp")
        .mapInArrow(_linker(RADIUS), "u long, v long")
    )
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << b)) for b in range(64)))
    ball = members.where(F.col("n") > max_bucket).select("fp").distinct().select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    least = ball.groupBy("near").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    dense = ball.join(least, "near").where("fp > v").select(F.col("fp").alias("u"), "v")
    return sliced.unionByName(dense).distinct()


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ z >> np.uint64(30)) * _M1
    z = (z ^ z >> np.uint64(27)) * _M2
    return z ^ z >> np.uint64(31)


def shingle_hashes(data: bytes, width: int = 5) -> np.ndarray:
    """64-bit hashes of the distinct word shingles of one text, ascending; a text of fewer words is
    one shingle, one without words none."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(h))
    n = len(h) - span + 1
    s = h[:n]
    for k in range(1, span):
        s = _mixed(s + np.uint64(k * _STEP % (1 << 64))) ^ h[k : k + n]
    return np.unique(_mixed(s + np.uint64(span)))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """256 majority bits over shingle hashes, as four words."""
    z = np.stack([_mixed(h + np.uint64(k * _STEP % (1 << 64))) for k in range(1, 5)], axis=1)
    total = np.zeros(256, np.int64)
    for k in range(0, len(h), 255):  # so many ones fit a byte
        bits = np.unpackbits(z[k : k + 255].view(np.uint8).reshape(-1, 32), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)


def _ratio(similarity: float) -> tuple[int, int]:
    f = Fraction(str(similarity))
    return f.numerator, f.denominator


def prefix_keys(h: np.ndarray, levels: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest shingles of a set, as many as alike sets cannot all miss: two sets alike to
    ``similarity`` share at least ceil(similarity * n) of either's n. A key is the shingle's level
    of frequency before bits of its hash, so keys order all sets' shingles alike."""
    p, q = _ratio(similarity)
    keys = levels[(h & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58) | h >> np.uint64(6)
    n = len(h) + (-len(h) * p // q) + 1
    return np.partition(keys, n - 1)[:n] if len(h) else keys


def _texts(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def shingle_levels(docs: DataFrame, width: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Per counter of the sketch the logarithm of how many (document, shingle) pairs fall on it.
    All documents count; the result has 2 ** bits bytes, whatever their number."""

    def run(batches):
        counts = np.zeros(1 << bits, np.int64)
        for batch in slices(batches):
            found = [shingle_hashes(x, width) for x in _texts(batch.column(0))]
            counts += np.bincount((np.concatenate(found) & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["counter", "n"])

    sums = docs.select("text").mapInArrow(tidied(run), "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    levels = np.zeros(1 << bits, np.uint8)
    levels[sums.column("counter").to_numpy()] = np.log2(sums.column("n").to_numpy()).astype(np.uint8)
    return levels


_WORDS = ["s0", "s1", "s2", "s3"]


def shingle_sets(docs: DataFrame, levels: np.ndarray, width: int, similarity: float) -> DataFrame:
    """doc_id, digest, id of the set, its size, fingerprint (s0..s3) and keys; keys only where a
    task meets a set first."""

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            ids, sizes, words, keys = [], [], [], []
            for x in _texts(batch.column("text")):
                h = shingle_hashes(x, width)
                ident = xxhash.xxh3_64_intdigest(h.tobytes())
                ids.append(ident)
                sizes.append(len(h))
                words.append(wide_fingerprint(h))
                keys.append([] if ident in seen else prefix_keys(h, levels, similarity).view(np.int64))
                seen.add(ident)
            bits = np.stack(words).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(np.array(sizes, np.int32))]
                + [pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4)]
                + [pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "digest", "id", "size", *_WORDS, "keys"],
            )

    slim = docs.select("doc_id", digest(F.col("text")).alias("digest"), "text")
    return slim.mapInArrow(tidied(run), f"doc_id {dict(docs.dtypes)['doc_id']}, digest string, id long, size int, {', '.join(f'{w} long' for w in _WORDS)}, keys array<long>")


def _whole_groups(batches, columns: int, work):
    """Calls ``work`` with columns of rows sorted by their first, whole groups of it at a time."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        got = [batch.column(k).to_numpy() for k in range(columns)]
        held = got if held is None else [np.concatenate(x) for x in zip(held, got)]
        if len(held[0]) < 1 << 16 or held[0][0] == held[0][-1]:
            continue
        end = int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on in the next batch
        yield from work(*(x[:end] for x in held))
        held = [x[end:] for x in held]
    if held is not None:
        yield from work(*held)


def _dealt(rows: DataFrame, key: str, blocks: DataFrame) -> DataFrame:
    """``rows`` with a group ``g``: rows of one ``key`` are dealt to its ``blocks``, and each two
    blocks are a group; a key of one block is a group by itself."""
    met = rows.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: x != F.col("block"))
    met = met.withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(others)))
    return met.withColumn("g", F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other"))).drop("block", "blocks", "other")


def candidate_links(sets: DataFrame, max_bucket: int = 2048) -> DataFrame:
    """Edges (u, v) that connect the sets which chains of fingerprints within WIDE_RADIUS and with a
    common key connect."""

    def work(g, ident, *words):
        starts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
        root = bit_sliced_roots(np.stack(words, axis=1).view(np.uint64), starts, WIDE_RADIUS)
        moved = np.flatnonzero(root != np.arange(len(g)))
        a, b = ident[moved], ident[root[moved]]
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    keyed = sets.select(F.explode("keys").alias("key"), "id")
    shared = keyed.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("key")
    members = materialize(keyed.join(shared, "key", "left_semi").distinct(), "simhash-members")
    blocks = members.groupBy("key").agg(F.ceil(F.count("*") / max_bucket).cast("long").alias("blocks"))
    prints = sets.where(F.size("keys") > 0).groupBy("id").agg(*(F.first(w).alias(w) for w in _WORDS))
    rows = _dealt(members, "key", blocks).select("g", "id").join(prints, "id").select("g", "id", *_WORDS)
    found = rows.repartition("g").sortWithinPartitions("g", "id").mapInArrow(lambda batches: _whole_groups(batches, 6, work), "u long, v long")
    out = materialize(found.distinct(), "simhash-candidates")
    discard(members)
    return out


def set_links(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Least index that chains of pairs alike to ``similarity`` reach from each set. Common shingles
    are counted exactly, one set against all before it over the places that hold its shingles."""
    p, q = _ratio(similarity)
    size = np.array([len(h) for h in sets], np.int64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)
    _, shingle, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = owner[np.argsort(shingle, kind="stable")]
    begin = np.cumsum(times) - times
    own = np.cumsum(size) - size
    root = np.arange(len(sets))
    for k in range(1, len(sets)):
        mine = shingle[own[k] : own[k] + size[k]]
        n = times[mine]
        if n.sum() == len(mine):
            continue
        at = np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(place[at], minlength=len(sets))[:k]
        alike = np.flatnonzero((common * (p + q) >= p * (size[:k] + size[k])) & (root[:k] != root[k]))
        if len(alike):
            met = np.unique(np.append(root[alike], root[k]))
            root[np.isin(root, met)] = met[0]
    return root


def verified_links(docs: DataFrame, sets: DataFrame, clusters: DataFrame, width: int, similarity: float, block_shingles: int = 1_000_000) -> DataFrame:
    """Edges (u, v) between sets of one cluster (id, root) that connect what chains of pairs alike
    to ``similarity`` connect. One text of each set moves, once for each pair of blocks it is in."""

    def links(ids, held):
        ids, root = np.array(ids, np.int64), set_links(held, similarity)
        moved = np.flatnonzero(root != np.arange(len(ids)))
        a, b = ids[moved], ids[root[moved]]
        return np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1)

    def batch_of(found):
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    def run(batches):
        at, ids, held, found = None, [], [], []
        for batch in slices(batches):
            for g, ident, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2))):
                if g != at:
                    if len(ids) > 1:
                        found.append(links(ids, held))
                    at, ids, held = g, [], []
                if not ids or ids[-1] != ident:  # rows may repeat
                    ids.append(ident)
                    held.append(shingle_hashes(x, width))
            if len(found) > 1000:
                yield batch_of(found)
                found = []
        if len(ids) > 1:
            found.append(links(ids, held))
        yield batch_of(found)

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("k")
    named = materialize(sets.join(clusters, "id").groupBy("id", "root").agg(first, F.max("size").alias("size")), "simhash-clustered")
    blocks = named.groupBy("root").agg(F.ceil(F.sum("size") / block_shingles).cast("long").alias("blocks"))
    mark = row_mark({"doc_id": F.col("k.doc_id").cast("string"), "digest": F.col("k.digest")})
    spread = _dealt(named.withColumn("mark", mark), "root", blocks).select("mark", "g", "id")
    texts = docs.select(row_mark({"doc_id": F.col("doc_id").cast("string"), "digest": digest(F.col("text"))}).alias("mark"), "text")
    met = texts.join(spread, "mark").select("g", "id", "text").repartition("g").sortWithinPartitions("g", "id")
    out = materialize(met.mapInArrow(tidied(run), "u long, v long"), "simhash-links")
    discard(named)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of ``edges`` (u, v): root is the least node of its component."""
    edges = materialize(edges.select("u", "v").where("u != v").distinct(), "simhash-edges")
    mark = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    before = mark(edges)
    while before["n"]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, "simhash-large")
        discard(edges)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = materialize(small, "simhash-small")
        discard(large)
        after = mark(edges)
        if after == before:
            break
        before = after
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return ends.unionByName(ends.select(F.col("root").alias("id"), "root").distinct())


def near_duplicates(docs: DataFrame, width: int = 3, max_bucket: int = 512) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    fps = materialize(fingerprints(docs.select("doc_id", "text"), width).select("doc.doc_id", "fp"), "simhash-fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    comp = materialize(components(links(distinct.select("fp"), max_bucket)), "simhash-components")
    named = distinct.join(comp, distinct["fp"] == comp["id"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_classes(docs: DataFrame, width: int = 5, similarity: float = 0.8, max_bucket: int = 2048, block_shingles: int = 1_000_000) -> DataFrame:
    """doc_id, digest and ``root``, the name of the group of near copies, of every document."""
    sets = materialize(shingle_sets(docs, shingle_levels(docs, width), width, similarity), "simhash-sets")
    near = candidate_links(sets, max_bucket)
    clusters = materialize(components(near), "simhash-clusters")
    discard(near)
    sure = verified_links(docs, sets.select("doc_id", "digest", "id", "size"), clusters, width, similarity, block_shingles)
    comp = materialize(components(sure), "simhash-components")
    discard(clusters, sure)
    return sets.select("doc_id", "digest", "id").join(comp, "id", "left").select("doc_id", "digest", F.coalesce("root", "id").alias("root"))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, max_bucket: int = 2048, block_shingles: int = 1_000_000) -> DataFrame:
    """One document of each group of near copies - texts whose sets of distinct ``width``-word
    shingles have a Jaccard similarity of ``similarity`` or more, and what chains of such texts
    connect: the one with the least doc_id (a null doc_id last), with all its columns; of rows that
    repeat this doc_id the one with the least text digest, once."""
    rows = shingle_classes(docs, width, similarity, max_bucket, block_shingles)
    same = rows.groupBy("root", "doc_id", "digest").agg(F.count("*").alias("m"))
    first = same.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "m")).alias("k"))
    return take_rows(docs, first.select("k.doc_id", "k.digest", "k.m", F.lit(1).cast("long").alias("copies")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
