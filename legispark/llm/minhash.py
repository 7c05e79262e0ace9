"""MinHash near-duplicates: banded universal hash minima, verified links, connected components by star contraction.

1. One pass gives each document the digest of its shingle set and its band keys: minima under universal hash functions
   ``(a * x + b) >> 32``, a few rows to a band. With 32 bands of 4 rows a pair at similarity 0.8 shares no band with a
   chance of 5e-8.
2. Documents with equal sets form a class; only its least id goes on. A group of copies, however large, is one row.
3. In each band bucket everyone is compared with the bucket's least id (a star, never all pairs): first by signature,
   then exactly on the full sets. Alternating large-star and small-star steps turn links into components.
4. A star can miss a link between two others. Buckets that still hold several components tie their members into
   families; members of different components of a family are compared in blocks of bounded size, by signature and
   then exactly by products of membership matrices. No pair leaves its block unless it is a link that connects.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legispark.llm.idfilter import id_filter, may_hold
from legispark.llm.storage import drop, materialize
from legispark.llm.words import SPACES, as_bytes, mix64, parts, split

BANDS, ROWS, BLOCK = 32, 4, 512
#: Minima of a verification signature, of which a byte each is kept.
MINIMA = 512
_random = np.random.default_rng(1601)
_A = _random.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The set of each text as sorted 64-bit hashes: runs of ``width`` words, or all words of a shorter text."""
    data, offset = as_bytes(column)
    for a, b in parts(column):
        words = split(data[offset[a] : offset[b]], offset[a : b + 1] - offset[a], SPACES, lower=True)
        n = len(words.hash)
        gram = np.zeros(n, np.uint64)
        for k in range(width):
            gram[: n - k] = gram[: n - k] * np.uint64(0xD1342543DE82EF95) + words.hash[k:]
        gram = mix64(gram)
        first = words.first
        for k in range(b - a):
            low, high = first[k], first[k + 1]
            if high - low >= width:
                yield np.unique(gram[low : high - width + 1])
            elif high > low:
                short = np.uint64(high - low)
                for h in words.hash[low:high]:
                    short = mix64(np.array([short], np.uint64) * np.uint64(0xD1342543DE82EF95) + h)[0]
                yield np.array([short], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def least_agreement(percent: int) -> float:
    """A pair goes on to the full sets if this share of its signature agrees: a pair at ``percent`` fails once in 1e8."""
    p = percent / 100
    return p - 5.6 * (p * (1 - p) / MINIMA) ** 0.5


def signature(shingles: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """The minima of a non-empty set under the first n hash functions, as 32-bit numbers."""
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    x = shingles >> np.uint64(32)
    for at in range(0, len(x), 1024):
        h = _A[:n, None] * x[None, at : at + 1024]
        h += _B[:n, None]
        np.minimum(out, (h.min(axis=1) >> np.uint64(32)).astype(np.uint32), out=out)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    rows = minima[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix64(key * np.uint64(0xD1342543DE82EF95) + rows[:, k])
    return key.view(np.int64)


def _profiles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digest, keys = [], [], []
            for x in shingle_sets(batch.column(1), width):
                size.append(len(x))
                digest.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                keys.append(band_keys(signature(x)).tolist() if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n_shingles", "digest", "keys"])

    return run


def _pack(width: int, wanted: np.ndarray):
    """(id, signature, compressed text) of documents that may be candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(wanted, batch.column(0))))
            minima = [signature(x, MINIMA) if len(x) else None for x in shingle_sets(batch.column(1), width)]
            text = [zlib.compress((t or "").encode(), 1) for t in batch.column(1).to_pylist()]
            short = [None if m is None else m.astype(np.uint8).tobytes() for m in minima]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.binary()), pa.array(text, pa.binary())], names=["id", "signature", "packed"])

    return run


def _verify(width: int, percent: int):
    """Pairs whose signatures agree enough and whose full sets overlap by ``percent``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: tuple[bytes, np.ndarray] | None = None
        for batch in batches:
            keep = []
            columns = [batch.column(k) for k in range(6)]
            for k in range(batch.num_rows):
                sa, sb = (np.frombuffer(columns[c][k].as_py(), np.uint8) for c in (2, 3))
                if (sa == sb).mean() < least_agreement(percent):
                    continue
                left, right = columns[4][k].as_py(), columns[5][k].as_py()
                if memory is None or memory[0] != left:
                    memory = (left, next(shingle_sets(pa.array([zlib.decompress(left).decode()]), width)))
                x, y = memory[1], next(shingle_sets(pa.array([zlib.decompress(right).decode()]), width))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a, b): the least id that is reachable.

    Alternates large-star (each node links its larger neighbours to the least of its neighbourhood) and small-star
    (each node links its smaller neighbours and itself to the least) until nothing changes. A hub has many larger
    neighbours, so the large-star is a grouped minimum, combined before the shuffle, and a join, whose hot keys are
    split at run time. Smaller neighbours are few after that, so the small-star is a window.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(edges)
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        linked = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = materialize(lowest.select(F.inline(linked)).filter("u <> v").distinct(), "stars")
        drop(edges)
        edges, after = small, state(small)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``.

    Links documents whose sets of ``width``-word shingles overlap by at least ``percent`` of their union; component_id
    is the least doc_id reachable, kept whether that is the row's own. Needs doc_id (integer) and text; extra columns
    are not read. A null, empty or wordless text has no set and is linked with nothing. Rows that repeat a doc_id are
    one node: they share a component. A null doc_id cannot be a node: such rows keep a null component and are kept.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profiles = materialize(docs.mapInArrow(_profiles(width), "id long, n_shingles long, digest binary, keys array<bigint>"), "profiles")
    nodes = profiles.filter("id IS NOT NULL AND digest IS NOT NULL")
    # Written down, so that the join meets two plain shuffles and Spark can split a class that holds a third of all rows.
    classes = materialize(nodes.groupBy("digest").agg(F.min("id").alias("rep")), "representatives")
    members = nodes.select("id", "digest").join(classes, "digest").filter("id <> rep").select("id", "rep").distinct()
    members = materialize(members, "classes")

    # One row per class goes on; a repeated id with another text stays another row of the same node.
    sole = nodes.groupBy("digest").agg(F.min_by(F.struct("id", "keys"), F.col("id")).alias("x")).select("x.id", "x.keys")
    banded = sole.select("id", F.explode("keys").alias("key"))
    pivots = banded.groupBy("key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = materialize(banded.join(pivots, "key").select("key", "id", "pivot", "n"), "buckets")
    pairs = materialize(buckets.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    candidates = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    candidates = materialize(candidates, "candidate-ids")
    texts = docs.mapInArrow(_pack(width, id_filter(candidates)), "id long, signature binary, packed binary").filter("signature IS NOT NULL")
    packed = materialize(texts.join(candidates, "id", "left_semi"), "candidates")
    return _finish(profiles, members, buckets, pairs, packed, width, percent)


def _links(pairs: DataFrame, packed: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links among pairs (a, b). Signatures decide first, so that few texts travel."""
    left = packed.select(F.col("id").alias("a"), F.col("signature").alias("sa"), F.col("packed").alias("pa"))
    right = packed.select(F.col("id").alias("b"), F.col("signature").alias("sb"), F.col("packed").alias("pb"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb", "pa", "pb")
    return joined.mapInArrow(_verify(width, percent), "a long, b long")


def _overlaps(sets: list[np.ndarray], rows: int) -> np.ndarray:
    """Sizes of the intersections of the first ``rows`` sets with the others, exactly, by products of membership matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[place] > 1
    column, owner = shared[place[keep]], owner[keep]
    out = np.zeros((rows, len(sets) - rows), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 4096
    for at in range(0, int((count > 1).sum()), width):
        low, high = np.searchsorted(column, (at, at + width))
        member = np.zeros((len(sets), width), np.float32)
        member[owner[low:high], column[low:high] - at] = 1
        out += member[:rows] @ member[rows:].T
    return out


def _block_links(width: int, percent: int):
    """Links between different components within blocks, exactly; rows come sorted by (family, i, j).

    Signatures decide which documents of the block have to be looked at, the full sets which pairs are linked. Only
    links that connect what the block has not connected yet are put out.
    """
    floor = least_agreement(percent)

    def settle(group: tuple | None, rows: list[tuple]) -> pa.RecordBatch:
        a: list[int] = []
        b: list[int] = []
        if group is not None and len(rows) > 1:
            first = [r for r in rows if r[2] == 0]
            second = [r for r in rows if r[2] == 1] if group[1] != group[2] else first
            if first and second:
                left, right = (np.stack([np.frombuffer(r[3], np.uint8) for r in x]) for x in (first, second))
                lc, rc = (np.array([r[1] for r in x]) for x in (first, second))
                near = np.zeros((len(first), len(second)), bool)
                for k in range(len(first)):
                    others = np.nonzero(rc != lc[k])[0]
                    near[k, others] = (right[others] == left[k]).mean(axis=1) >= floor
                if group[1] == group[2]:
                    near = np.triu(near, 1)
                rows_in, columns_in = np.nonzero(near.any(axis=1))[0], np.nonzero(near.any(axis=0))[0]
                if len(rows_in):
                    chosen = [first[k] for k in rows_in] + [second[k] for k in columns_in]
                    sets = list(shingle_sets(pa.array([zlib.decompress(r[4]).decode() for r in chosen]), width))
                    size = np.array([len(x) for x in sets], np.float64)
                    both = _overlaps(sets, len(rows_in)).astype(np.float64)
                    union = size[: len(rows_in), None] + size[None, len(rows_in) :] - both
                    parent: dict[int, int] = {}

                    def root(c: int) -> int:
                        while parent.setdefault(c, c) != c:
                            parent[c] = c = parent[parent[c]]
                        return c

                    for x, y in zip(*np.nonzero((100 * both >= percent * union) & near[np.ix_(rows_in, columns_in)]), strict=True):
                        one, two = chosen[x], chosen[len(rows_in) + y]
                        p, q = root(one[1]), root(two[1])
                        if p != q:
                            parent[p] = q
                            a.append(min(one[0], two[0]))
                            b.append(max(one[0], two[0]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        rows: list[tuple] = []
        for batch in batches:
            for family, i, j, *row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if group != (family, i, j):
                    yield settle(group, rows)
                    group, rows = (family, i, j), []
                rows.append(tuple(row))
        yield settle(group, rows)

    return run


def _finish(profiles: DataFrame, members: DataFrame, buckets: DataFrame, pairs: DataFrame, packed: DataFrame, width: int, percent: int) -> DataFrame:
    links = materialize(_links(pairs, packed, width, percent), "links")
    found = materialize(components(links), "components")

    # Buckets that hold several components tie their members into families, which are compared in blocks.
    tagged = buckets.filter("n > 2").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    tagged = materialize(tagged, "tagged")
    mixed = tagged.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
    stars = materialize(tagged.join(mixed, "key").filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "mixed")
    extra = None
    if not stars.isEmpty():
        families = components(stars).select(F.col("node").alias("id"), F.col("component").alias("family"))
        member = materialize(families.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")), "families")
        sizes = member.groupBy("family").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).filter("x <> y").select("family", "blocks")
        rows = member.join(packed, "id").join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "component", F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "signature", "packed")
        linked = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "id").mapInArrow(_block_links(width, percent), "a long, b long")
        extra = materialize(linked, "more-links")
        extra = None if extra.isEmpty() else extra

    # Members of a class hang on its representative. Only an id that several rows repeat with different texts ties
    # classes together, so only such ids enter the components.
    several = members.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).select("id")
    several = profiles.join(several, "id", "left_semi").groupBy("id").agg(F.count_distinct("digest").alias("_n")).filter("_n > 1").select("id")
    ties = materialize(members.join(several, "id", "left_semi").select(F.col("rep").alias("a"), F.col("id").alias("b")), "ties")
    if extra is not None or not ties.isEmpty():
        links = links.unionByName(ties) if extra is None else links.unionByName(extra).unionByName(ties)
        found = materialize(components(links), "components")
    rep = members.groupBy(F.col("id").alias("_id")).agg(F.min("rep").alias("_rep"))
    out = profiles.select(F.col("id").alias("doc_id"), "n_shingles").join(rep, F.col("doc_id") == F.col("_id"), "left").withColumn("_rep", F.coalesce("_rep", "doc_id"))
    out = out.join(found, F.col("_rep") == F.col("node"), "left")
    component = F.coalesce("component", "_rep")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
