"""Near-duplicate documents by MinHash, with sequential Bayesian verification.

Words are runs without ASCII white space, A-Z lower-cased; a document's set is its distinct 5-word shingles, with fewer words the whole
sequence as one; without words (or with null text) it is empty and linked with nothing. Sets are held as 64-bit hashes.

1. Equal sets become one class (its first row stands for it), so copies never meet as pairs.
2. Classes that share a band of their signatures are candidates. In each bucket all members meet the member with the most neighbours;
   from the confirmed links components are made. Only where members other than that one are still in different components do they meet
   each other, in blocks of bounded size that carry signatures and sets and give back only links that connect components. No link
   between components is lost this way, and no bucket's pairs are written out.
3. Signatures of candidates are compared batch by batch; a pair goes once the posterior chance that its similarity reaches the threshold
   is below `miss`. Survivors are compared exactly on their full sets.

Each row is judged on its own text and linked like others, whatever its doc_id: a doc_id that comes again with another text may be in two
components. component_id is the smallest doc_id that is not null in the row's component, null if there is none; kept is whether it is the
row's own, and of a component without doc_ids its first row is kept. Ties of the threshold (exactly percent) are links. An empty table
gives no rows; columns other than doc_id and text are ignored here and kept by keep_one().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Scratch, broadcast_if_small, components, join_hot, trimmed

WORDS = 5
BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS
MOST_HASHES = 256 * ROWS
BATCH = 20
#: Members of a bucket that meet in one block, and bytes of their sets (a larger set is a block of its own or so).
BLOCK, BLOCK_BYTES = 256, 16 << 20
#: Chance that no band brings a pair at the threshold together.
APART = 1e-6
UPPER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_drawn = np.random.default_rng(20240611)
MULTIPLY = _drawn.integers(1, 1 << 31, MOST_HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _drawn.integers(0, 1 << 32, MOST_HASHES, dtype=np.uint32)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


#: Bytes of text hashed at once; a longer text is cut into pieces at white space.
PIECE = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE_VALUE = _drawn.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_drawn.integers(1 << 61, 1 << 62)) * 8 + 5


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


_powers: list[np.ndarray] = []


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of data: differences of a running polynomial sum, shifted to the word's start."""
    if not _powers or len(_powers[0]) <= len(data):
        n = max(PIECE + 65536, len(data) + 1)
        _powers[:] = [powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)]
    up, down = _powers
    raw = np.frombuffer(data, np.uint8)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[raw] * up[: len(raw)], out=sums[1:])
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = SPACE[raw]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    return starts, mixed((sums[ends] - sums[starts]) * down[starts])


def windows(w: np.ndarray, size: int) -> np.ndarray:
    n = len(w) - size + 1
    h = np.full(max(0, n), size, np.uint64)
    for k in range(size):
        h = mixed(h * M2 + w[k : k + n])
    return h


def pieces(data: bytes):
    """Parts of a long text, cut at white space near every PIECE bytes."""
    at = 0
    while at < len(data):
        to = at + PIECE
        while to < len(data) and not SPACE[data[to]]:
            to += 1
        yield data[at:to]
        at = to


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each whole text. Short texts are hashed together."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)

    def finish(i: int, words: np.ndarray, hashed: np.ndarray) -> None:
        if len(words):
            out[i] = np.unique(hashed) if len(words) >= WORDS else windows(words, len(words))

    def flush(group: list[tuple[int, bytes]]) -> None:
        starts, w = word_hashes(b" ".join(d for _, d in group))
        hashed = windows(w, WORDS)
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(d) + 1 for _, d in group)]))
        for (i, _), lo, hi in zip(group, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            finish(i, w[lo:hi], hashed[lo : max(lo, hi - WORDS + 1)])

    group, size = [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode().translate(UPPER)
        if len(data) > PIECE:
            words = np.concatenate([word_hashes(p)[1] for p in pieces(data)])
            finish(i, words, windows(words, WORDS))
            continue
        if size + len(data) > PIECE:
            flush(group)
            group, size = [], 0
        group.append((i, data))
        size += len(data) + 1
    if group:
        flush(group)
    return out


def bands_for(threshold: float) -> int:
    """So many bands that a pair at the threshold meets in none with a chance of APART at most: 24 for 0.85, 35 for 0.80.

    A threshold that needs more hashes than MOST_HASHES, which is one under about 0.56, is an error: fewer bands would lose links.
    """
    bands = ceil(log(APART) / log(1 - threshold**ROWS)) if threshold < 1 else 1
    if bands * ROWS > MOST_HASHES:
        raise ValueError(f"a threshold of {threshold} needs {bands} bands, and no more than {MOST_HASHES // ROWS} are made")
    return bands


def signature(s: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    out = np.full(hashes, 0xFFFFFFFF, np.uint32)
    low = (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(s), 1024):
        part = low[at : at + 1024, None] * MULTIPLY[:hashes]
        part += ADD[:hashes]
        np.minimum(out, part.min(0), out=out)
    return out


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def set_key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sketcher(hashes: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs = [], [], []
            for s in shingle_sets(_column(batch, "text").to_pylist()):
                n.append(len(s))
                keys.append(set_key(s))
                sigs.append(signature(s, hashes).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([_column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sig"])

    return sketch


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(_column(batch, "text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(map(set_key, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_key", "items"])


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each signature and band."""
    bands = sig.shape[1] // ROWS
    sig = sig.reshape(len(sig), bands, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * M1, sig.shape[:2])
    for k in range(ROWS):
        h = mixed(h * M2 + sig[:, :, k])
    return h.view(np.int64)


def signatures(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.uint32).reshape(len(data), -1)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, bucket) of each band."""
    for batch in batches:
        if len(batch):
            keys = band_keys(signatures(_column(batch, "sig").to_pylist()))
            rep = np.repeat(_column(batch, "rep").to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(keys.ravel())], names=["rep", "bucket"])


def least_matches(threshold: float, miss: float, hashes: int = HASHES) -> list[int]:
    """For each batch of signature values seen: the fewest matches with which a pair stays.

    With a uniform prior, the similarity after m matches of n has a Beta(m + 1, n - m + 1) posterior, whose mass above the threshold is
    the chance of at most m successes among n + 1 draws at the threshold.
    """
    out = []
    for n in range(BATCH, hashes + 1, BATCH):
        mass, m = 0.0, 0
        while m <= n:
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= miss:
                break
            m += 1
        out.append(m)
    return out


def surviving(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of two signature matrices stay after all batches."""
    alive, seen = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, need in enumerate(least):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        seen = seen + (a[alive, cut] == b[alive, cut]).sum(1, dtype=np.int32)
        stay = seen >= need
        alive, seen = alive[stay], seen[stay]
    return alive


def _pruner(least: list[int]):
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = (signatures(_column(batch, c).to_pylist()) for c in ("sig_a", "sig_b"))
            alive = pa.array(surviving(a, b, least))
            yield pa.RecordBatch.from_arrays([_column(batch, c).take(alive) for c in "ab"], names=["a", "b"])

    return prune


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _blocks(least: list[int], percent: int):
    """Links between different components of a bucket, block by block, enough to connect what is linked.

    A pair is looked at in the first band that brings it together, and only while its ends are not yet connected in this block.
    """

    def of(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))  # two blocks at most
        rep, comp, block = (table[c].to_numpy() for c in ("rep", "component", "block"))
        sig = signatures(table["sig"].to_pylist())
        keys, bucket, i, j = band_keys(sig), *(k.as_py() for k in key)
        band = int((keys == bucket).sum(0).argmax())
        sets = table["items"]
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        found = []
        right = np.flatnonzero(block == j)
        for x in np.flatnonzero(block == i).tolist():
            others = right[right > x] if i == j else right
            others = others[(comp[others] != comp[x]) & ~(keys[others, :band] == keys[x, :band]).any(1)]
            if not len(others):
                continue
            own = None
            for y in others[surviving(np.broadcast_to(sig[x], (len(others), sig.shape[1])), sig[others], least)].tolist():
                a, b = find(int(comp[x])), find(int(comp[y]))
                if a == b:
                    continue
                own = np.frombuffer(sets[x].as_buffer(), np.uint64) if own is None else own
                if linked(own, np.frombuffer(sets[y].as_buffer(), np.uint64), percent):
                    root[a] = b
                    found.append((rep[x], rep[y]))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return of


def _exact(percent: int):
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = enumerate(zip(_column(batch, "set_a"), _column(batch, "set_b"), strict=True))
            keep = pa.array([i for i, (x, y) in pairs if linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)], pa.int64())
            yield pa.RecordBatch.from_arrays([_column(batch, c).take(keep) for c in "ab"], names=["a", "b"])

    return exact


def _marked(docs: DataFrame, percent: int, miss: float) -> DataFrame:
    """doc_id, n_shingles, set_key, component (the number of its first row, null without words), component_id, kept for every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    hashes = bands_for(percent / 100) * ROWS
    least = least_matches(percent / 100, miss, hashes)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = keyed.mapInArrow(trimmed(_sketcher(hashes)), "doc_id long, n_shingles long, set_key binary, sig binary").withColumn("row", F.monotonically_increasing_id())
    sketch = scratch.keep(sketch, "sketch")
    first_row = F.min_by(F.struct("row", "sig", "n_shingles"), "row")
    reps = sketch.where("set_key is not null").groupBy("set_key").agg(first_row.alias("r"), F.min("doc_id").alias("low"))
    reps = scratch.keep(reps.select("set_key", F.col("r.row").alias("rep"), F.col("r.sig").alias("sig"), F.col("r.n_shingles").alias("n"), "low"), "classes")
    sigs = reps.select("rep", "sig")

    banded = sigs.mapInArrow(_bands, "rep long, bucket long")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    buckets = scratch.keep(banded.join(shared, "bucket"), "buckets")
    degree = buckets.groupBy("rep").agg(F.sum("members").alias("degree"))
    heads = buckets.join(degree, "rep").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("rep")).alias("minus"))).alias("h")).select("bucket", (-F.col("h.minus")).alias("head"))
    headed = scratch.keep(buckets.join(heads, "bucket").where("rep != head").select("bucket", "rep", "head"), "headed")
    stars = headed.select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct()

    def with_sigs(pairs: DataFrame) -> DataFrame:
        return pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b").select("a", "b", "sig_a", "sig_b")

    def sets_of(ends: DataFrame, name: str) -> DataFrame:
        """(rep, items): a class's set is read from the rows with its smallest doc_id, or from those without doc_id if it has none."""
        ends = scratch.keep(ends.distinct().join(reps.select("rep", "set_key", "low"), "rep"), f"{name}-ends", narrow=True)
        asked = broadcast_if_small(ends.where("low is not null").select(F.col("low").alias("doc_id")).distinct(), 24)
        found = keyed.join(asked, "doc_id", "left_semi").mapInArrow(trimmed(_sets), "set_key binary, items binary")
        if not ends.where("low is null").isEmpty():
            found = found.union(keyed.where("doc_id is null").mapInArrow(trimmed(_sets), "set_key binary, items binary"))
        ours = broadcast_if_small(ends.select("set_key", "rep"), 56)
        return scratch.keep(found.join(ours, "set_key").dropDuplicates(["rep"]).select("rep", "items"), f"{name}-sets")

    first = scratch.keep(with_sigs(stars).mapInArrow(_pruner(least), "a long, b long"), "star-pairs")
    sets = sets_of(first.select(F.col("a").alias("rep")).union(first.select(F.col("b").alias("rep"))), "star")
    both = first.join(sets.select(F.col("rep").alias("a"), F.col("items").alias("set_a")), "a").join(sets.select(F.col("rep").alias("b"), F.col("items").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
    links = scratch.keep(both.mapInArrow(_exact(percent), "a long, b long"), "star-links")
    labels = components(scratch, links)

    # Members that their bucket's head did not bring together. A bucket in one component, but for its head, has nothing left.
    placed = headed.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    placed = scratch.keep(placed, "placed", narrow=True)
    mixed_buckets = placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least != most").select("bucket")
    sized = join_hot(placed, mixed_buckets, ["bucket"], 24).join(reps.select("rep", "n"), "rep")
    sized = scratch.keep(sized, "mixed", narrow=True)
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
    left = join_hot(sized, sized.groupBy("bucket").agg(blocks.alias("n_blocks")), ["bucket"], 24)
    left = left.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    left = scratch.keep(left.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "component"), "rest")
    rest_sets = sets_of(left.select("rep"), "rest")
    rest = left.join(sigs, "rep").join(rest_sets, "rep")
    more = scratch.keep(rest.groupBy("bucket", "i", "j").applyInArrow(_blocks(least, percent), "a long, b long"), "rest-links")
    if not more.isEmpty():
        scratch.drop(labels)
        labels = components(scratch, links.union(more))

    labelled = reps.select("set_key", "rep", "low").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", "low", F.coalesce("component", "rep").alias("component"))
    labelled = scratch.keep(labelled, "labelled")
    lowest = labelled.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = scratch.keep(join_hot(labelled.select("set_key", "component"), lowest, ["component"], 24), "components")
    scratch.drop(buckets, headed, placed, sized, first, sets, left, rest_sets, labelled)
    slim = sketch.select("doc_id", "n_shingles", "set_key", "row")
    linked = join_hot(slim.where("set_key is not null"), classes, ["set_key"], 56)
    own = F.when(F.col("doc_id").isNull(), F.col("component_id").isNull() & (F.col("row") == F.col("component"))).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    linked = linked.select("doc_id", "n_shingles", "set_key", "component", "component_id", own.alias("kept"))
    alone = slim.where("set_key is null").select("doc_id", "n_shingles", "set_key", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.union(alone)


def near_duplicates(docs: DataFrame, percent: int = 85, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; a link has 100 * intersection >= percent * union."""
    return _marked(docs, percent, miss).select("doc_id", "n_shingles", "component_id", "kept")


def key_of(text: Column) -> Column:
    @arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(map(set_key, shingle_sets(texts.to_pylist())), pa.binary())

    return of(text)


def keep_one(docs: DataFrame, percent: int = 85, miss: float = 1e-6) -> DataFrame:
    """The rows of docs, all columns as they are, of which one stays for each component.

    Of rows without words all stay, but one of those that share a doc_id. Rows whose doc_id is null or comes more than once are told apart
    by the keys of their sets.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    marks = scratch.keep(_marked(docs, percent, miss), "marks")
    again = scratch.keep(marks.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again", narrow=True)
    gone = marks.where("not kept and doc_id is not null").select("doc_id").union(again).distinct()
    kept = docs.where("doc_id is not null").join(broadcast_if_small(gone, 40), "doc_id", "left_anti")
    odd = marks.join(broadcast_if_small(again, 24), "doc_id", "left_semi").union(marks.where("doc_id is null"))
    if odd.isEmpty():
        return kept
    key, group = "_bidlake_set_key", F.coalesce(F.col("component").cast("string"), F.concat(F.lit("doc "), F.col("doc_id")))
    stay = odd.where("kept and (component is not null or doc_id is not null)").groupBy(group.alias("g")).agg(F.min(F.struct("doc_id", "set_key")).alias("s"))
    stay = broadcast_if_small(stay.select(F.col("s.doc_id").alias("stay_id"), F.col("s.set_key").alias("stay_key")), 64)
    rows = docs.join(broadcast_if_small(again, 24), "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).withColumn(key, key_of(F.col("text")))
    free = rows.where(F.col("doc_id").isNull() & F.col(key).isNull())
    held = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("stay_id")) & F.col(key).eqNullSafe(F.col("stay_key")), "left_semi")
    return kept.unionByName(held.dropDuplicates(["doc_id", key]).drop(key)).unionByName(free.drop(key))


#: Whole sets of shingles and all pairs that share one, for small tables; components by walking the links.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, g FROM (SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r), met AS (SELECT a.r, b.r AS q, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
half AS (SELECT b.r, b.q FROM met b JOIN n x ON x.r = b.r JOIN n y ON y.r = b.q WHERE 100 * shared >= 85 * (x.n + y.n - shared)), links AS (FROM half UNION SELECT q, r FROM half),
reach AS (SELECT r, r AS q FROM d UNION SELECT k.r, l.q FROM reach k JOIN links l ON l.r = k.q), low AS (SELECT k.r, min(o.doc_id) AS component_id FROM reach k JOIN d o ON o.r = k.q GROUP BY k.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN low ON low.r = d.r LEFT JOIN n ON n.r = d.r
"""
