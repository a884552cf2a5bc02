"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set where over half of its shingles' XXH64 values have it.  Two fingerprints link at
``BITS`` (3) or fewer differing bits.  Split into two segments of 32 bits, a linked pair differs by one bit at most in one of
them, so enumerating a ball of radius one around each segment value meets every pair in a table of segment values.  One of
two segment values that differ in one bit has it set, so clearing set bits enumerates the half of the ball that is needed.
Other radii take ``bits // 2 + 1`` segments, two at least, of nearly equal width, by the same argument;
more segments are shorter and their buckets fuller.  Matches are verified on all 64 bits.

Texts whose five-word shingles are alike by 0.8 differ in about 0.15 of their bits, ten of 64 in the median, which no small ball reaches.
``without_near_copies`` therefore takes wide fingerprints (``LANES`` words of 64 bits, from one XXH64 value per shingle and
mixtures of it): of ``PARTS`` segments of 16 bits one differs by one bit at most in nearly every such pair, and complete
distances are verified over all bits (``WIDE_BITS``).  Each bucket yields a spanning forest of its nearest links, and the shingles
of both texts of such a link are compared in full (``SIMILAR``).  A pair that differs by two bits or more in every segment is
not met: README has the measured share.  A segment's buckets grow with the number of fingerprints; beyond some 10^9 of them
segments have to be wider.

Documents of equal fingerprint are one node, whatever their number.  A bucket (segment, value) holds nodes and probes; the
task that has it compares its table entries with its probes in vectors and emits a spanning forest of the links it finds, so
dense groups yield as many rows as members, not as pairs.  Components follow from these links; no cap is set anywhere.
Work in a bucket is entries times probes; buckets hold distinct 64-bit values that agree in 31 of 32 bits.

Defined cases: null and blank texts have fingerprint zero and link like any other; fewer words than a shingle make one
shingle of all; repeated rows share a node; a null id has the component of its node, null if no row there has an id; an empty
table gives no rows; extra columns are ignored by ``classes`` and pass through ``one_of_each`` and ``without_near_copies``, also where they
are named like the keys in here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import row_key, shuffle_partitions, text_of
from tidewatch.llm.components import components
from tidewatch.session import materialize

SHINGLE = 3
BITS = 3
SEGMENTS = 2  # at least
SEED = 42
_CHUNK = 1 << 16


def fingerprint(data: bytes, width: int = SHINGLE) -> int:
    """Unsigned fingerprint of UTF-8 text; bytes.lower and bytes.split touch ASCII only, as the definition of words asks."""
    words = data.lower().split()
    if not words:
        return 0
    shingles = zip(*[words[i:] for i in range(width)], strict=False) if len(words) >= width else [words]
    count = max(1, len(words) - width + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(s), SEED) for s in shingles), dtype=">u8", count=count)
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, count, _CHUNK):
        bits += np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > count).tobytes(), "big")


def fingerprints_of(width: int = SHINGLE):
    """Column function: text to fingerprint as a signed long."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t.as_buffer().to_pybytes(), width) for t in texts), dtype=np.uint64, count=len(texts))
        return pa.array(found.view(np.int64))

    return of


def as_hex(fp: str) -> Column:
    """Sixteen lower-case hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def segments(bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of segments of which one differs in one bit at most when ``bits`` differ in all."""
    if not 0 <= bits < 64:
        raise ValueError(f"a radius of {bits} bits is not within 0 to 63")
    count = max(SEGMENTS, bits // 2 + 1)
    cuts = [64 * i // count for i in range(count + 1)]
    return [(low, high - low) for low, high in zip(cuts, cuts[1:], strict=False)]


def probes(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(key, fp, own): each segment's value (own) and its neighbours with one set bit cleared.  key holds segment and value."""
    def keys(number: int, value: Column, wide: int) -> Column:
        tag = F.lit(number << 32).cast("bigint")
        set_bits = F.filter(F.array(*[F.lit(1 << i).cast("bigint") for i in range(wide)]), lambda bit: value.bitwiseAND(bit) != 0)
        cleared = F.transform(set_bits, lambda bit: F.struct((value - bit + tag).alias("key"), F.lit(False).alias("own")))
        return F.concat(F.array(F.struct((value + tag).alias("key"), F.lit(True).alias("own"))), cleared)

    every = [keys(n, F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << wide) - 1)), wide) for n, (low, wide) in enumerate(segments(bits))]
    return nodes.select("fp", F.explode(F.concat(*every)).alias("k")).select("k.key", "fp", "k.own")


def _forest(fps: np.ndarray, own: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Spanning links of a bucket: every entry is compared with every probe on the whole fingerprint."""
    label = np.arange(len(fps))
    for i in np.flatnonzero(own):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= bits)
        roots = np.unique(label[near])
        if len(roots) > 1:
            label[np.isin(label, roots[1:])] = roots[0]
    return [(i, r) for i, r in enumerate(label.tolist()) if i != r]


def _links(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def resolve(fps, own, starts, ends):
            left, right = [], []
            mine = np.add.reduceat(own.astype(np.int64), starts) if len(starts) else []
            for s, e, m in zip(starts, ends, mine, strict=True):
                if m and e - s > 1:
                    f = fps[s:e]
                    for i, r in _forest(f.view(np.uint64), own[s:e], bits):
                        left.append(f[i])
                        right.append(f[r])
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

        key, held = None, []  # the last bucket, which may go on in the next batch
        for batch in batches:
            keys, fps, own = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "fp", "own"))
            if not len(keys):
                continue
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            if held and keys[0] == key and not len(cuts):
                held.append((fps, own))
                continue
            begin = 0
            if held:
                begin = (cuts[0] if len(cuts) else len(keys)) if keys[0] == key else 0
                whole = [np.concatenate(x) for x in zip(*held, (fps[:begin], own[:begin]), strict=True)]
                yield resolve(*whole, np.array([0]), np.array([len(whole[0])]))
            last = int(cuts[-1]) if len(cuts) else 0
            last = max(last, begin)
            starts = np.concatenate([[begin], cuts[(cuts > begin) & (cuts < last)]]).astype(np.int64) if last > begin else np.array([], dtype=np.int64)
            ends = np.concatenate([starts[1:], [last]]).astype(np.int64) if len(starts) else starts
            yield resolve(fps, own, starts, ends)
            key, held = keys[last], [(fps[last:].copy(), own[last:].copy())]
        if held:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            yield resolve(*whole, np.array([0]), np.array([len(whole[0])]))

    return run


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): fingerprints that are linked, directly or through others of the same bucket."""
    found = probes(nodes, bits).repartition(max(2, shuffle_partitions(nodes)), "key").sortWithinPartitions("key")
    return found.mapInArrow(_links(bits), "a bigint, b bigint").distinct()


def signed(docs: DataFrame, id_col: str, text: str, width: int = SHINGLE) -> DataFrame:
    """Written table (id, __k0, __k1, fp): one short row per document."""
    rows = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text), fingerprints_of(width)(text_of(text)).alias("fp"))
    return materialize(rows, "fingerprints")


def node_components(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, component_id): the smallest id reachable from each fingerprint."""
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(nodes.select("fp"), bits))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "nodes")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id", "root")


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(id, fingerprint, component_id), one row per document."""
    rows = signed(docs, id_col, text, width)
    joined = rows.select("id", "fp").join(node_components(rows, bits).select("fp", "component_id"), "fp")
    return joined.select(F.col("id").alias(id_col), as_hex("fp").alias("fingerprint"), "component_id")


def _first_of_each(docs: DataFrame, rows: DataFrame, rooted: DataFrame, id_col: str, text: str) -> DataFrame:
    """Of each component (fp, root) the row with the smallest id stays (nulls last; among repeated ids the smallest key), repeated rows once."""
    keyed = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("i"), "__k0", "__k1")
    per_node = rows.groupBy("fp").agg(F.min(keyed).alias("first"))
    chosen = per_node.join(rooted, "fp").groupBy("root").agg(F.min("first").alias("first"))
    chosen = materialize(chosen.select(F.col("first.__k0").alias("__k0"), F.col("first.__k1").alias("__k1")), "chosen")
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *row_key(id_col, text)).join(chosen, ["__k0", "__k1"], "left_semi")
    once = F.row_number().over(Window.partitionBy("__k0", "__k1").orderBy("__k0"))
    return kept.withColumn("__n", once).where("__n = 1").select("__row.*")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The documents without near-duplicates: one row of each component."""
    rows = signed(docs, id_col, text, width)
    return _first_of_each(docs, rows, node_components(rows, bits).select("fp", "root"), id_col, text)


# --- near copies: wide fingerprints ------------------------------------------------

#: Words of a shingle, 64-bit words of a fingerprint, its differing bits at most, and the segments of 16 bits that are probed.
NEAR_SHINGLE = 5
LANES = 4
WIDE_BITS = 52
PARTS = 12
#: Similarity of a link: shingles in common of all shingles of both texts.
SIMILAR = 0.8
#: Buckets up to this size are compared many at once.
SMALL_BUCKET = 64
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # fixed values of the splitmix64 generator


def _lanes(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """(hash, lane): the value itself, then the generator's outputs that follow it."""
    out = np.empty((len(hashes), lanes), dtype=np.uint64)
    out[:, 0] = hashes
    with np.errstate(over="ignore"):
        for k in range(1, lanes):
            z = hashes + np.uint64(k * _MIX[0] & (1 << 64) - 1)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX[1])
            z = (z ^ (z >> np.uint64(27))) * np.uint64(_MIX[2])
            out[:, k] = z ^ (z >> np.uint64(31))
    return out


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of the different shingles of lower-case words; of no words there are none."""
    if not words:
        return np.array([], dtype=np.uint64)
    shingles = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64, count=len(shingles))


def wide_fingerprint(data: bytes, width: int = NEAR_SHINGLE, lanes: int = LANES) -> bytes:
    """Bits that over half of the different shingles have, lane by lane, highest first."""
    words = data.lower().split()
    if not words:
        return bytes(8 * lanes)
    hashes = _hashes(words, width)
    bits = np.zeros(64 * lanes, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = _lanes(hashes[at : at + _CHUNK], lanes).astype(">u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * bits > len(hashes)).tobytes()


def _wide_probes(parts: int):
    """(key, fp, own) of fingerprints: each segment's value, and its neighbours with one set bit cleared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = np.uint16(1) << np.arange(16, dtype=np.uint16)
        for batch in batches:
            fps = batch.column("fp")
            values = np.frombuffer(b"".join(fps.to_pylist()), dtype=">u2").reshape(len(fps), -1)[:, :parts].astype(np.int64)
            for part in range(parts):
                row, place = np.nonzero(values[:, part, None] & bit)
                keys = np.concatenate([values[:, part], values[row, part] - (1 << place)]) + (part << 16)
                rows = np.concatenate([np.arange(len(fps)), row])
                own = np.arange(len(rows)) < len(fps)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), fps.take(pa.array(rows)), pa.array(own)], names=["key", "fp", "own"])

    return run


def _small_pairs(fps: np.ndarray, own: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """(bucket, distance, entry, probe) of the links within small buckets, each entry against every probe of its bucket, all buckets at once."""
    bucket = np.repeat(np.arange(len(starts)), sizes)
    places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    entries, of = places[own[places]], bucket[own[places]]
    found = []
    for at in range(0, len(entries), _CHUNK // SMALL_BUCKET):
        mine, b = entries[at : at + _CHUNK // SMALL_BUCKET], of[at : at + _CHUNK // SMALL_BUCKET]
        n = sizes[b]
        i = np.repeat(mine, n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[b], n)
        far = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int64)
        near = (far <= bits) & (far > 0)
        found.append((np.repeat(b, n)[near], far[near], i[near], j[near]))
    return tuple(np.concatenate([np.array([], dtype=np.int64), *[f[k] for f in found]]) for k in range(4))


def _nearest_of_pairs(bucket: np.ndarray, far: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[int]]:
    """Of each bucket's links the nearest that span it."""
    left, right, up = [], [], {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    order = np.lexsort((j, i, far, bucket))
    last = -1
    for k in order.tolist():
        if bucket[k] != last:
            up.clear()
            last = bucket[k]
        a, b = root(int(i[k])), root(int(j[k]))
        if a != b:
            up[a] = b
            left.append(int(i[k]))
            right.append(int(j[k]))
    return left, right


def _nearest_forest(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest links that span a large bucket, one member after another, in time of the square and memory of its size."""
    n = len(fps)
    far, near, out = np.full(n, 1 << 30), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    left, right = [], []
    for _ in range(n):
        k = int(np.argmin(np.where(out, far, 1 << 31)))
        out[k] = False
        if 0 < far[k] <= bits:
            left.append(k)
            right.append(int(near[k]))
        d = np.bitwise_count(fps ^ fps[k]).sum(axis=1, dtype=np.int64)
        closer = d < far
        far[closer], near[closer] = d[closer], k
    return np.asarray(left, dtype=np.int64), np.asarray(right, dtype=np.int64)


def _wide_links(bits: int, small: int = SMALL_BUCKET):
    def resolve(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        keys, own, fps = table.column("key").to_numpy(), table.column("own").to_numpy(), table.column("fp").combine_chunks()
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        sizes = np.diff(np.append(starts, len(keys)))
        words = np.frombuffer(b"".join(fps.to_pylist()), dtype=np.uint64).reshape(len(fps), -1)
        some = (sizes > 1) & (np.add.reduceat(own.astype(np.int64), starts) > 0)
        few = some & (sizes <= small)
        links = [_nearest_of_pairs(*_small_pairs(words, own, starts[few], sizes[few], bits))]
        for s, n in zip(starts[some & ~few], sizes[some & ~few], strict=True):
            # A fingerprint may be entry and probe.
            once = s + np.unique(words[s : s + n], axis=0, return_index=True)[1]
            a, b = _nearest_forest(words[once], bits)
            links.append((once[a], once[b]))
        a, b = (np.concatenate([np.asarray(f[k], dtype=np.int64) for f in links]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([fps.take(pa.array(a)), fps.take(pa.array(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last bucket may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            if held and keys[-1] == held[0].column("key")[0].as_py():
                held.append(batch)
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            if held or last:
                yield resolve([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        if held:
            yield resolve(held)

    return run


def near_links(nodes: DataFrame, bits: int = WIDE_BITS, parts: int = PARTS) -> DataFrame:
    """(a, b): wide fingerprints (fp) within ``bits``, the nearest of each bucket."""
    probed = nodes.select("fp").mapInArrow(_wide_probes(parts), "key bigint, fp binary, own boolean")
    found = probed.repartition(max(2, shuffle_partitions(nodes)), "key").sortWithinPartitions("key")
    pairs = found.mapInArrow(_wide_links(bits), "a binary, b binary")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_links(docs: DataFrame, rows: DataFrame, links: DataFrame, id_col: str, text: str, width: int = NEAR_SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """The links whose texts have ``similar`` of their different shingles in common; texts of one fingerprint stand for each other."""
    ends = links.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    first = rows.groupBy("fp").agg(F.min(F.struct("__k0", "__k1")).alias("k")).join(ends, "fp").select("fp", "k.__k0", "k.__k1")

    @F.arrow_udf("binary")
    def shingles(texts: pa.Array) -> pa.Array:
        """Sorted hashes of the different shingles."""
        return pa.array([np.sort(_hashes(t.as_buffer().to_pybytes().lower().split(), width)).tobytes() for t in texts], pa.binary())

    @F.arrow_udf("boolean")
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
            a, b = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(both >= similar * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    # Repeated rows share their key and their text.
    held = docs.select(*row_key(id_col, text), text_of(text).alias("t")).join(first, ["__k0", "__k1"]).groupBy("fp").agg(F.first("t").alias("t"))
    held = materialize(held.select("fp", shingles("t").alias("s")), "shingles")
    both = links.join(held.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a").join(held.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b")
    return both.where(alike("sa", "sb")).select("a", "b")


def near_components(docs: DataFrame, rows: DataFrame, id_col: str, text: str, width: int = NEAR_SHINGLE, bits: int = WIDE_BITS, parts: int = PARTS, similar: float = SIMILAR) -> DataFrame:
    """(fp, root) of the fingerprints of ``rows``."""
    nodes = rows.select("fp").distinct()
    links = materialize(near_links(nodes, bits, parts), "near-links")
    roots = components(similar_links(docs, rows, links, id_col, text, width, similar)).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def wide_signed(docs: DataFrame, id_col: str, text: str, width: int = NEAR_SHINGLE, lanes: int = LANES) -> DataFrame:
    """Written table (id, __k0, __k1, fp): one short row per document."""

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([wide_fingerprint(t.as_buffer().to_pybytes(), width, lanes) for t in texts], pa.binary())

    return materialize(docs.select(F.col(id_col).alias("id"), *row_key(id_col, text), of(text_of(text)).alias("fp")), "wide-fingerprints")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = NEAR_SHINGLE, lanes: int = LANES, bits: int = WIDE_BITS, parts: int = PARTS,
                        similar: float = SIMILAR) -> DataFrame:
    """The documents, one of each group of near copies."""
    rows = wide_signed(docs, id_col, text, width, lanes)
    return _first_of_each(docs, rows, near_components(docs, rows, id_col, text, width, bits, parts, similar), id_col, text)
