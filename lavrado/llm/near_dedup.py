"""MinHash near-deduplication with sequential Bayesian verification.

Plan: (1) where the text is: word shingles, their minima under HASHES functions, and a digest of the word
sequence; (2) equal sequences become one node, by a shuffle of digests; (3) the signature's bands give
buckets; in each bucket every node is paired with one pivot, the node that shares most buckets with others;
(4) pairs are compared signature batch by signature batch and dropped once a similarity of the threshold or
more is less likely than `miss`; survivors are compared on their full shingle sets; (5) links give
components; (6) in buckets whose nodes are still in different components, the shingles of the nodes are
counted: one that only one component has can't be shared, one that more than COMMON nodes have is common.
A pair that isn't linked yet needs either enough common shingles on both sides or a shared uncommon one
among the least frequent ones of both (a prefix index); only such pairs follow (4).  All bounds hold for
every pair of the threshold's similarity, so no candidate is left untried; (7) components of all links.
No bucket is collected: pivots are an aggregate, pairs are joins that Spark splits when a bucket is large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from . import hashing
from .components import components
from .shared import documents, dropped, small_batches, staged, utf8

#: A pair of similarity 0.8 shares none of BANDS bands with a probability of (1 - 0.8**ROWS)**BANDS = 6e-7.
BANDS, ROWS = 36, 5
HASHES = BANDS * ROWS
#: Hashes compared before each decision to go on.
BATCH = 36
#: Nodes of open buckets that have a shingle, above which it is common.
COMMON = 64
#: Sides of joins that grow with the input are shuffled at every size, so that a small table has the plan of a large one.
MERGE = "shuffle_merge"


def word_shingles(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    """Distinct runs of k words; of fewer words, the whole sequence as one; of none, none."""
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def _shingle_hashes(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Of each text (lower-case, words split by one space) the distinct shingles' hashes, sorted."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    word = starts < ends  # an empty text leaves an empty place
    h = hashing.spans(data, starts, ends)
    at = 0
    for x in texts:
        n = x.count(b" ") + 1
        own = h[at : at + n] if word[at] else h[:0]
        at += n
        m = max(1, len(own) - k + 1) if len(own) else 0
        total = np.zeros(m, dtype=np.uint64)
        for j in range(min(k, len(own))):
            total = total * np.uint64(0xD6E8FEB86659FD93) + own[j : j + m]
        yield np.unique(hashing.mixed(total))


def _functions() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240607)
    return draw.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def signature(shingles: np.ndarray) -> bytes:
    """The low 16 bits of each function's minimum: two sets with the same minimum agree in them, others by chance once in
    65,536 times, so a pair may look a little more alike than it is, never less."""
    a, b = _functions_once()
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), 512):  # blocks that stay in the cache
        np.minimum(out, (a[:, None] * low[None, i : i + 512] + b[:, None]).min(axis=1), out=out)
    return out.astype("<u2").tobytes()


_functions_once = lru_cache(maxsize=1)(_functions)


def _signed(k: int) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [b" ".join(x.lower().split()) if x else b"" for x in utf8(batch.column("text"))]
            sets = list(_shingle_hashes(texts, k)) if texts else []
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([hashlib.md5(x).digest() if x else None for x in texts], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "digest", "n_shingles", "signature"],
            )

    return run


def _banded(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        raw = batch.column("signature").to_pylist()
        if not raw:
            continue
        sig = np.frombuffer(b"".join(raw), dtype="<u2").reshape(len(raw), BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2])
        for r in range(ROWS):
            key = hashing.mixed(key * np.uint64(0xD6E8FEB86659FD93) + sig[:, :, r])
        node, n = batch.column("node").to_numpy(), batch.column("n_shingles").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64).ravel()), pa.array(np.repeat(node, BANDS)), pa.array(np.repeat(n, BANDS))], ["bucket", "node", "n_shingles"])


def _shingled(k: int) -> Callable:
    """Of each text its shingles' hashes; `piece` tells the texts of one doc_id apart."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [b" ".join(x.lower().split()) if x else b"" for x in utf8(batch.column("text"))]
            sets = list(_shingle_hashes(texts, k)) if texts else []
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]).view(np.int64)
            piece = [int.from_bytes(hashlib.md5(x).digest()[:8], "little", signed=True) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("component"), pa.array(piece, pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["node", "component", "piece", "n", "shingles"])

    return run


def least_matches(threshold: float, miss: float, batch: int = BATCH, hashes: int = HASHES) -> list[tuple[int, int]]:
    """(hashes seen, least matches to go on) after each batch: below it, the posterior of a similarity of at
    least `threshold`, from a uniform prior, is under `miss`."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(batch, hashes + 1, batch):
        least = 0
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(log - log.max())
            if weight[grid >= threshold].sum() / weight.sum() >= miss:
                break
            least = m + 1
        out.append((n, least))
    return out


def _plausible(steps: list[tuple[int, int]]) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, HASHES) for c in ("sa", "sb")]
            left, seen, at = np.arange(len(x[0])), np.zeros(len(x[0]), dtype=np.int64), 0
            for n, least in steps:
                seen[left] += (x[0][left, at:n] == x[1][left, at:n]).sum(axis=1)
                left, at = left[seen[left] >= least], n
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(left)) for c in ("a", "b")], ["a", "b"])

    return run


def _linked(k: int, percent: int) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        @lru_cache(maxsize=64)
        def shingles(text: bytes) -> set:
            return word_shingles(text.lower().split(), k)

        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(utf8(batch.column("ta")), utf8(batch.column("tb")))):
                s, t = shingles(x or b""), shingles(y or b"")
                both = len(s & t)
                if both and 100 * both >= percent * (len(s) + len(t) - both):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good, pa.int64())) for c in ("a", "b")], ["a", "b"])

    return run


def _open(named: DataFrame) -> DataFrame:
    """The rows of buckets with several components, with `main`, the component of most of a bucket's nodes."""
    counts = named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m"))
    mixed = staged(counts.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("m", "component")).alias("x")).where("k > 1").select("bucket", F.col("x.component").alias("main")), "mixed")
    return staged(named.join(mixed, "bucket"), "open")


def _shared(open_: DataFrame, base: DataFrame, k: int, percent: int, close: Callable) -> tuple[DataFrame, DataFrame]:
    """(node, common) of the open nodes that may have a link to another component, common being the number of
    their common shingles; and the pairs (a, b) that share an uncommon shingle of their prefixes."""
    nodes = staged(open_.select(F.col("node").alias("doc_id"), "component").distinct(), "open_nodes")
    texts = base.join(nodes, "doc_id").dropDuplicates(["doc_id", "text"]).select("doc_id", "component", "text")
    rows = staged(texts.mapInArrow(_shingled(k), "node long, component long, piece long, n long, shingles array<bigint>"), "shingles", "lz4")
    each = rows.select("node", "component", "piece", "n", F.explode("shingles").alias("shingle"))
    known = staged(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("shingle", "df"), "known")
    marked = staged(each.join(known.hint(MERGE), "shingle"), "marked", "lz4")
    common = F.col("df") > COMMON
    counts = marked.groupBy("node", "piece", "n").agg(F.sum(common.cast("long")).alias("common"), F.sum((~common).cast("long")).alias("rare"))
    alive = staged(counts.where(100 * (F.col("common") + F.col("rare")) >= percent * F.col("n")), "alive")
    # A pair shares `percent` % of the larger set at least, and of that no more common shingles than either has.
    least = F.greatest(F.lit(1), F.ceil(F.lit(percent) * F.col("n") / 100) - F.col("common"))
    place = F.row_number().over(Window.partitionBy("node", "piece").orderBy("df", "shingle"))
    prefix = marked.where(~common).join(alive.hint(MERGE), ["node", "piece", "n"]).withColumn("place", place).where(F.col("place") <= F.col("rare") - least + 1)
    index = staged(prefix.select("shingle", "node", "component", "n", "common", "rare"), "index")
    l, r = index.alias("l"), index.alias("r")  # noqa: E741
    enough = (100 + percent) * (F.least(F.col("l.common"), F.col("r.common")) + F.least(F.col("l.rare"), F.col("r.rare"))) >= percent * (F.col("l.n") + F.col("r.n"))
    met = l.join(r, (F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.component") < F.col("r.component")) & close(F.col("l.n"), F.col("r.n")) & enough)
    pairs = met.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b"))
    dropped(marked)
    dropped(rows)
    return alive.groupBy("node").agg(F.max("common").alias("common")), pairs


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of df.

    Words are what ASCII white space separates, A-Z lower-cased.  Two documents are linked if their sets of
    distinct `shingle`-word shingles share percent % of their union; component_id is the smallest doc_id
    reachable, kept marks the row that has it.  Texts without words (null, empty, blank) are linked with
    nothing.  Rows that share a doc_id count as one document with the links of all its rows.  A row with a
    null doc_id is linked with nothing, has a null component_id and is kept.  An empty table gives none.
    """
    spark = df.sparkSession
    small_batches(spark)
    base = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = staged(base.mapInArrow(_signed(shingle), "doc_id long, digest binary, n_shingles long, signature binary"), "signatures", "lz4")
    usable = rows.where("digest is not null and doc_id is not null")
    nodes = staged(usable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature")), "classes", "lz4")
    wide, rows = rows, staged(rows.drop("signature"), "rows")
    dropped(wide)
    bands = nodes.select("node", "n_shingles", "signature").mapInArrow(_banded, "bucket long, node long, n_shingles long")
    order = F.xxhash64("node")
    sizes = staged(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")  # written, so that the join has shuffles of its own, of which Spark can split a large bucket's
    members = staged(bands.join(sizes, "bucket").select("bucket", "node", "n_shingles", "size"), "buckets")
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    pivots = staged(members.select("bucket", "node", "n_shingles").join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", order.alias("o"), "node", "n_shingles")).alias("p")).select("bucket", F.col("p.node").alias("pivot"), F.col("p.n_shingles").alias("pivot_n")), "pivots")
    close = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    steps = least_matches(percent / 100, miss)

    def links(pairs: DataFrame) -> DataFrame:
        sig = nodes.select("node", "signature").hint(MERGE)
        with_sig = pairs.join(sig.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a").join(sig.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
        likely = staged(with_sig.select("a", "b", "sa", "sb").mapInArrow(_plausible(steps), "a long, b long").distinct(), "likely")
        wanted = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct()
        texts = staged(base.where("doc_id is not null").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "texts")
        own = texts.hint(MERGE)
        with_text = likely.join(own.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(own.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
        found = staged(with_text.select("a", "b", "ta", "tb").mapInArrow(_linked(shingle, percent), "a long, b long").distinct(), "links")
        dropped(texts)
        dropped(likely)
        return found

    # A doc_id with several texts is one node with several rows: it joins its own classes by itself.
    near = staged(members.join(pivots, "bucket").where((F.col("node") != F.col("pivot")) & close(F.col("n_shingles"), F.col("pivot_n"))).select(*ordered(F.col("node"), F.col("pivot"))).distinct(), "near")
    first = links(near)
    grouped = components(first)
    named = staged(members.select("bucket", "node", "n_shingles").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    dropped(members)
    open_ = _open(named)
    dropped(named)
    bounds, pairs = _shared(open_, base, shingle, percent, close)
    cores = _open(open_.select("bucket", "node", "n_shingles", "component").join(bounds, "node").where(100 * F.col("common") >= percent * F.col("n_shingles")))
    all_ = cores.groupBy("node").agg(F.collect_set("bucket").alias("all"))
    cores = staged(cores.join(all_, "node"), "cores")
    l, r = cores.alias("l"), cores.where("component != main").alias("r")  # noqa: E741
    enough = (100 + percent) * F.least(F.col("l.common"), F.col("r.common")) >= percent * (F.col("l.n_shingles") + F.col("r.n_shingles"))
    once = (F.col("l.component") == F.col("l.main")) | (F.col("l.component") < F.col("r.component"))
    first_met = F.col("l.bucket") == F.array_min(F.array_intersect("l.all", "r.all"))
    across = l.join(r, (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.component") != F.col("r.component")) & once & close(F.col("l.n_shingles"), F.col("r.n_shingles")) & enough & first_met)
    rest = across.select(*ordered(F.col("l.node"), F.col("r.node"))).union(pairs).distinct().join(near, ["a", "b"], "left_anti")
    linked = components(first.union(links(rest)))
    labels = nodes.select("digest", "node").join(linked, "node", "left").select("digest", F.coalesce("component", "node").alias("label"))
    named_rows = rows.select("doc_id", "n_shingles", "digest").join(labels, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return named_rows.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=2)
