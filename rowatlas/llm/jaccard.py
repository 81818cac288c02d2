"""N-gram Jaccard join: all pairs of documents whose five-word shingle sets have a similarity of 0.8 or more.

MinHash banding finds candidates: ``band_plan`` takes the fewest bands whose recall at
0.8 reaches the target for a given number of rows. Documents of one shingle set are a
class and count once. Band hashes are shuffled. The members of a bucket are compared in pairs on
sketches, a byte of each MinHash: pairs that agree in fewer places than similar ones do with near certainty
(``sketch_floor``) are no candidates, so unlike documents are not chained up by chance
collisions. A bucket hands over the edges that connect its candidates, not its pairs; a bucket with
more than ``BUCKET`` members is taken as one group. Connected groups of candidates are then compared
whole: in blocks, in numpy, on full sets of 64-bit shingle hashes. So a group of n near
copies costs n rows for each of its blocks, not a row for each pair, and each
link is still found and counted. Links form the classes that are returned.
Keys that may hold a third of all rows (a bucket, a group, a text with many copies) are never
shuffled: see ``hot``.

Defined cases: null and empty texts, and texts of white space, have no shingles: they
link to nothing and are classes of their own; a text of one to four words has
one shingle, all its words; rows that share a doc_id are one document per
row: each row is returned; a null doc_id sorts first among names of a class; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowatlas.llm import scratch
from rowatlas.llm.components import components
from rowatlas.llm.hot import join_counted

SHARE = (4, 5)
ROWS = 5
RECALL = 0.9999
#: Probability that the sketches of a similar pair agree in fewer places than ``sketch_floor``.
MISS = 1e-8
#: Members of a bucket that are compared in pairs.
BUCKET = 512
#: Documents, and shingles, of a block on average.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Representatives of classes with a candidate (about 60 bytes each) that are broadcast at most, to choose texts; more are joined by a shuffle.
BROADCAST_ROWS = 250_000
#: Narrow rows (``scratch.ROWS_A_FILE``) that one row with band keys and a sketch takes as much space as.
WIDE = 8
#: Words whose hash a worker keeps.
CACHED_WORDS = 200_000
_WHITE = " \t\n\x0b\x0c\r"


def band_plan(rows: int = ROWS, recall: float = RECALL, share: float = SHARE[0] / SHARE[1]) -> int:
    """Bands needed for the recall at that similarity."""
    return math.ceil(math.log(1 - recall) / math.log(1 - share**rows))


def sketch_floor(places: int, share: float = SHARE[0] / SHARE[1], miss: float = MISS) -> int:
    """Places in which the sketches of a pair of that similarity agree at least, but for a probability of ``miss``."""
    seen, k = 0.0, -1
    while seen <= miss:
        k += 1
        seen += math.comb(places, k) * share**k * (1 - share) ** (places - k)
    return k


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of a text."""

    def __init__(self, words: int = 5):
        import xxhash

        self.words, self.cache = words, {}
        self.hash = lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        self.odd = np.random.default_rng(5).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.table = str.maketrans(dict.fromkeys(_WHITE, " "))

    def split(self, text: str) -> list[str]:
        return [w for w in text.translate(self.table).split(" ") if w]

    def __call__(self, text: str | None) -> np.ndarray:
        ws = self.split(text or "")
        if not ws:
            return np.empty(0, np.uint64)
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        cache = self.cache
        for w in set(ws).difference(cache):
            cache[w] = self.hash(w)
        h = np.fromiter(map(cache.__getitem__, ws), np.uint64, len(ws))
        n = min(self.words, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - n + 1, np.uint64(n))
            for k in range(n):  # the order of words counts: each place has its own factor, mixed after each
                out = (out ^ h[k : len(h) - n + 1 + k]) * self.odd[k]
                out ^= out >> np.uint64(29)
        return np.unique(out)


def _signer(rows: int, bands: int, seed: int = 1):
    rng = np.random.default_rng(seed)
    factor = rng.integers(1, 1 << 63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = rng.integers(0, 1 << 63, rows * bands, dtype=np.uint64)
    mix = rng.integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(sh: np.ndarray) -> tuple[np.ndarray, bytes]:
        """A 64-bit key for each band, and a byte of each MinHash."""
        with np.errstate(over="ignore"):
            low = np.full(rows * bands, np.iinfo(np.uint64).max, np.uint64)
            for at in range(0, len(sh), 2048):
                part = sh[at : at + 2048, None]
                part = (part ^ salt[None, :]) * factor[None, :]
                np.minimum(low, part.min(axis=0), out=low)
            sketch = low.astype(np.uint8).tobytes()
            low = low.reshape(bands, rows)
            key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for k in range(rows):
                key = (key ^ low[:, k] ^ (low[:, k] >> np.uint64(31))) * mix[k]
                key ^= key >> np.uint64(32)
        return key.view(np.int64), sketch

    return sign


def _features(rows: int, bands: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sign = Shingler(), _signer(rows, bands)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                uid, keys, sketches = [], [], []
                for text in batch.column("text").to_pylist():
                    sh = shingle(text)
                    uid.append(hashlib.blake2b(sh.tobytes(), digest_size=16).digest() if len(sh) else None)
                    key, sketch = sign(sh) if len(sh) else (np.empty(0, np.int64), None)
                    keys.append(key)
                    sketches.append(sketch)
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), pa.array(uid, pa.binary()), held, pa.array(sketches, pa.binary())], ["doc_id", "tk", "uid", "bands", "sketch"])
        scratch.give_back()

    return run


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingle = Shingler()
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            sets = [shingle(t) for t in batch.column("text").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("root"), batch.column("members"), held], ["id", "root", "members", "sh"])
    scratch.give_back()


def _alike(floor: int):
    """Buckets (rows sorted by key, each with n members) to the edges that connect members whose sketches agree in ``floor`` places."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        key, ids, sketches, u, v = None, [], [], [], []

        def close() -> None:
            if len(ids) > 1:
                x = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(ids), -1)
                for a, b in _forest(len(ids), *_agreeing(x, floor)):
                    u.append(max(ids[a], ids[b]))
                    v.append(min(ids[a], ids[b]))

        for batch in batches:
            for k, i, s in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "sketch")), strict=True):
                if k != key:
                    close()
                    key, ids, sketches = k, [], []
                ids.append(i)
                sketches.append(s)
            if len(u) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)
                u.clear(), v.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)

    return run


def _agreeing(x: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of the rows that are equal in ``floor`` columns."""
    if len(x) == 2:
        return (np.array([0]), np.array([1])) if int((x[0] == x[1]).sum()) >= floor else (np.empty(0, int), np.empty(0, int))
    out = [np.flatnonzero((x[i + 1 :] == x[i]).sum(1) >= floor) + i + 1 for i in range(len(x) - 1)]
    return np.repeat(np.arange(len(x) - 1), [len(o) for o in out]), np.concatenate(out)


def _similar(a: list[np.ndarray], b: list[np.ndarray], same: bool, share: tuple[int, int] = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs with a similarity of ``share`` or more; i < j if ``same``."""
    na, nb = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    if len(a) * len(b) <= 4:
        pairs = [(i, j) for i in range(len(a)) for j in range(i + 1 if same else 0, len(b)) if (c := len(np.intersect1d(a[i], b[j], assume_unique=True))) * share[1] >= (na[i] + nb[j] - c) * share[0]]
        return tuple(np.array(pairs, np.int64).reshape(-1, 2).T)
    left, right = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(left, right)
    ia, ib = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
    count = np.zeros((len(a), len(b)), np.float32)
    if same:  # shingles of one set alone are of no use
        values, n = np.unique(left, return_counts=True)
        shared = values[n > 1]
    ka, kb = np.searchsorted(shared, left), np.searchsorted(shared, right)
    oka, okb = (np.minimum(k, max(len(shared) - 1, 0)) for k in (ka, kb))
    oka, okb = (len(shared) > 0) & (shared[oka] == left) if len(shared) else np.zeros(len(left), bool), (shared[okb] == right) if len(shared) else np.zeros(len(right), bool)
    ia, ka, ib, kb = ia[oka], ka[oka], ib[okb], kb[okb]
    oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
    ia, ka, ib, kb = ia[oa], ka[oa], ib[ob], kb[ob]
    for at in range(0, len(shared), 4096):  # products of dense slices, exact below 2^24 shingles
        wide = min(4096, len(shared) - at)
        sa, sb = slice(*np.searchsorted(ka, [at, at + wide])), slice(*np.searchsorted(kb, [at, at + wide]))
        x, y = np.zeros((len(a), wide), np.float32), np.zeros((len(b), wide), np.float32)
        x[ia[sa], ka[sa] - at] = 1
        y[ib[sb], kb[sb] - at] = 1
        count += x @ y.T
    c = np.rint(count).astype(np.int64)
    ok = c * share[1] >= (na[:, None] + nb[None, :] - c) * share[0]
    if same:
        ok &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
    return np.nonzero(ok)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that suffice to connect what all links connect."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        if (p := root(x)) != (q := root(y)):
            up[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


_FOUND = "id long, links long, other long"


def _comparing(share: tuple[int, int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compared(batches, share)

    return run


def _compared(batches: Iterable[pa.RecordBatch], share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (root, p, q) to link counts (``other`` null) and forest edges (``links`` 0)."""
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])
    group: list[tuple] = []
    key, out = None, []

    def close() -> None:
        p, q = key[1], key[2]
        if p == q:
            side = other = group
        else:
            side, other = [g for g in group if g[0] == p], [g for g in group if g[0] == q]
        if not side or not other:
            return
        i, j = _similar([g[3] for g in side], [g[3] for g in other], p == q, share)
        if not len(i):
            return
        members_a, members_b = np.array([g[2] for g in side]), np.array([g[2] for g in other])
        la, lb = np.zeros(len(side), np.int64), np.zeros(len(other), np.int64)
        np.add.at(la, i, members_b[j])
        np.add.at(lb, j, members_a[i])
        out.extend((g[1], int(n), None) for g, n in zip(side, la, strict=True) if n)
        out.extend((g[1], int(n), None) for g, n in zip(other, lb, strict=True) if n)
        shift = 0 if p == q else len(side)
        names = [g[1] for g in side] + ([] if p == q else [g[1] for g in other])
        out.extend((names[x], 0, names[y]) for x, y in _forest(len(names), i, j + shift))

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], schema.field(k).type) for k in range(3)], schema=schema)
        out.clear()
        return rows

    for batch in batches:
        roots, ps, qs, bs, uids, members = (batch.column(c).to_pylist() for c in ("root", "p", "q", "b", "id", "members"))
        lists = batch.column("sh")
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        for k in range(batch.num_rows):
            now = (roots[k], ps[k], qs[k])
            if now != key:
                if key is not None:
                    close()
                key, group = now, []
            group.append((bs[k], uids[k], members[k], flat[at[k] : at[k + 1]].copy()))
        if len(out) > 5000:
            yield flush()
    if key is not None:
        close()
    yield flush()


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id`` as a number, ``text`` and ``tk``, the digest of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("tk"))


def _candidates(sets: DataFrame, tables: scratch.Tables, places: int, bands: int, share: float) -> tuple[DataFrame, int]:
    """Edges ``u, v`` (numbers of sets) that connect all candidates for a link, and a bound of their number."""
    keys, total = sets.select("id", F.explode("bands").alias("key")), bands * sets.count()
    buckets = tables.write(keys.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "buckets", total)
    held = tables.write(join_counted(keys, buckets, "key", "n", total), "held", total)
    tables.drop("buckets")
    some = held.where(F.col("n") <= BUCKET).select("key", "id").join(sets.select("id", "sketch"), "id")
    near = some.repartition("key").sortWithinPartitions("key").mapInArrow(_alike(sketch_floor(places, share)), "u long, v long")
    return near.unionByName(held.where((F.col("n") > BUCKET) & (F.col("id") != F.col("first"))).select(F.col("id").alias("u"), F.col("first").alias("v"))), held.count()


def _linked(spark: SparkSession, docs: DataFrame, tables: scratch.Tables, rows: int, recall: float, share: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """``doc_id, tk, uid`` of every row, and of every set that has a link or a copy:
    ``uid, members, class_id, n_links`` and ``r``, the smallest (doc_id, tk) of its class."""
    bands = band_plan(rows, recall, share[0] / share[1])
    keyed = _keyed(docs)
    marked = tables.write(keyed.mapInArrow(_features(rows, bands), "doc_id long, tk binary, uid binary, bands array<long>, sketch binary"), "marked")
    # One row per shingle set; its text is found again by the smallest id and the digest of that row.
    sets = marked.where("uid is not null").groupBy("uid").agg(F.count("*").alias("members"), F.min(F.struct("doc_id", "tk")).alias("r"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    # Sets are numbered once, in the written table: numbers are unique and stay.
    sets = tables.write(sets.select(F.monotonically_increasing_id().alias("id"), "uid", "members", "r.doc_id", "r.tk", "bands", "sketch"), "sets", WIDE * marked.count())
    edges, most = _candidates(sets, tables, rows * bands, bands, share[0] / share[1])
    groups = tables.write(components(edges, tables, "candidate-edges", most).withColumnRenamed("node", "id"), "candidate-groups", most)
    tables.drop("candidate-edges", "held")
    near = sets.select("id", "members", F.col("doc_id").alias("_d"), F.col("tk").alias("_t")).join(groups, "id")
    near = tables.write(near, "near", sets.count())
    few = near.count() <= BROADCAST_ROWS
    texts = keyed.join(F.broadcast(near) if few else near, (F.col("tk") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("id", "root", "members", "text")
    full = tables.write(texts.mapInArrow(_sets, "id long, root long, members long, sh array<long>").dropDuplicates(["id"]), "full")
    size = full.groupBy("root").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.size("sh")) / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = join_counted(full, size, "root", "n", full.count()).withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("b", o).alias("p"), F.greatest("b", o).alias("q")))
    dealt = placed.select("root", "b", "id", "members", "sh", F.explode(pair).alias("pq")).select("root", "pq.p", "pq.q", "b", "id", "members", "sh")
    found = dealt.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q").mapInArrow(_comparing(share), _FOUND)
    found = tables.write(found, "found")
    tables.drop("full", "near", "candidate-groups")
    links = found.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(found.where("other is not null").select(F.col("id").alias("u"), F.col("other").alias("v")), tables, "link-edges", found.count())
    # Only sets with a link or with copies can share a class.
    more = tables.write(classes.withColumnRenamed("node", "id").join(links, "id", "left"), "classes", found.count())
    tables.drop("link-edges", "found")
    named = sets.select("id", "uid", "members", F.struct("doc_id", "tk").alias("own")).join(_sized(more), "id", "left").where("root is not null or members > 1")
    named = tables.write(named.withColumn("root", F.coalesce("root", "id")), "named", sets.count())
    names = named.groupBy("root").agg(F.count("*").alias("n"), F.min("own").alias("r"), F.sum("members").alias("class_size")).where("class_size > 1")
    linked = join_counted(named, names, "root", "n", named.count()).select("uid", "members", "r", F.col("r.doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    return marked.select("doc_id", "tk", "uid"), tables.write(linked, "linked", named.count())


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast up to a counted bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def join(spark: SparkSession, docs: DataFrame, rows: int = ROWS, recall: float = RECALL, share: tuple[int, int] = SHARE) -> DataFrame:
    """``doc_id, class_id, n_links`` for every row of ``docs``.

    ``n_links`` is the number of other rows with a similarity of ``share`` (a fraction) or more, equal texts included;
    ``class_id`` is the smallest doc_id that a chain of links reaches.
    """
    marked, linked = _linked(spark, docs, scratch.Tables(spark), rows, recall, share)
    verdicts = linked.select("uid", "members", "class_id", "n_links", F.lit(True).alias("found"))
    out = marked.join(_sized(verdicts), "uid", "left") if verdicts.count() <= BROADCAST_ROWS else join_counted(marked, verdicts, "uid", "members", marked.count(), True)
    return out.select("doc_id", F.when(F.col("found"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(spark: SparkSession, docs: DataFrame, rows: int = ROWS, recall: float = RECALL, share: tuple[int, int] = SHARE) -> DataFrame:
    """``docs`` with one row of each class, that with the smallest doc_id (then digest of its text)."""
    tables = scratch.Tables(spark)
    marked, linked = _linked(spark, docs, tables, rows, recall, share)
    heads = tables.write(linked.select("r.doc_id", F.col("r.tk").alias("_t")).distinct().withColumnRenamed("doc_id", "_d"), "heads", linked.count())
    few = linked.count() <= BROADCAST_ROWS
    of_class = marked.join(F.broadcast(linked.select("uid")), "uid") if few else join_counted(marked, linked.select("uid", "members"), "uid", "members", marked.count())
    away = tables.write(of_class.groupBy(F.col("tk").alias("_t")).agg(F.count("*").alias("_n")), "away", marked.count())
    # Rows travel as one struct, so no name of theirs can clash.
    own = docs.select(F.struct("*").alias("row"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("_t"))
    if away.count() <= BROADCAST_ROWS:
        alone, same = own.join(F.broadcast(away), "_t", "left_anti"), own.join(F.broadcast(away), "_t", "left_semi")
    else:
        told = join_counted(own, away, "_t", "_n", marked.count(), True)
        alone, same = told.where("_n is null"), told.where("_n is not null").select("row", "_t")
    first = same.withColumn("_d", F.col("row.doc_id").cast("long"))
    first = first.join(_sized(heads.withColumnsRenamed({"_d": "_hd", "_t": "_ht"})), (F.col("_t") == F.col("_ht")) & F.col("_d").eqNullSafe(F.col("_hd")), "left_semi")
    return alone.select("row").unionByName(first.dropDuplicates(["_d", "_t"]).select("row")).select("row.*")
