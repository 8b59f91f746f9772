"""N-gram Jaccard join: exact links between sets of word n-grams, by a prefix filter, parity bitmaps and tries.

1. Tasks turn texts into sets of 64-bit n-gram hashes with a 128-bit
   fingerprint. A task takes each set on once, so any number of copies becomes
   one set per task at most; what is left of them links by fingerprint.
2. All n-grams have one global order: n-grams that are frequent in some task's
   share last, by their count, all others before them by hash. The table of
   frequent ones is bounded by FREQUENT; which ones are in it changes the cost,
   never the result, since any fixed order is right.
3. Two sets that link share an n-gram among the first n - ceil(t n) + 1 of
   each. Sets that share one there meet, but not pair by pair: an n-gram names
   one of its sets as its centre, and each set is checked against one centre. What links makes components. Where an n-gram's sets still lie in
   several, each is checked against the heaviest component there, and in a last
   round against every other component that it met. A component takes a set in
   with its first link, so the pairs within a group are neither written out nor
   all checked, yet no pair that could join two components is left unchecked.
4. A check first compares parity bitmaps, whose distance is a lower bound of
   the sets' distance, and so drops no link. Survivors are joined in blocks of
   at most BLOCK sets: the block's sets, in global order, form a trie; a probing
   set walks it, the overlap counted along a shared prefix serves all sets
   below it, and a subtree is left as soon as the longest overlap still
   possible is too small.
5. Components of the links come from alternating stars; the least document id
   of a component names it.

Defined results: a null, empty or blank text has an empty set, which links to
nothing. A text of fewer than n words has one entry, all its words. Repeated
documents are in one component. Rows without an id take part, but never name a
component. Sets of equal rank are taken by number, which changes no link. Texts
of any length have all their n-grams. An empty table stays empty. Only the two
named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from causalrisk.llm.common import bounded_batches, scratch, stored
from causalrisk.llm.components import components
from causalrisk.llm.words import NOT_SPACE, gram_hashes, mix, text_chunks

N, PERCENT = 5, 80
#: Most n-grams in the table of frequent ones; sets in a trie and probes that walk it in one go.
FREQUENT, BLOCK, PROBES = 131_072, 256, 512
#: N-grams counted at once in a task; counts from which one is told on, and from which their sum makes it frequent.
COUNTED, LOCAL, LEAST_COUNT = 4_000_000, 2, 16
#: Fingerprints that a task keeps; rows of ids that are broadcast at most to pick sets, more go by a shuffle join.
_SEEN, PICKED = 1_000_000, 1_000_000
#: Rounds in which sets are held against the heaviest component they met, before the rest is.
ROUNDS = 1


def need(a, b, percent: int = PERCENT):
    """Least overlap of sets of a and b entries that link: 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n + percent * -n // 100 + 1


def distinct(grams: np.ndarray) -> np.ndarray:
    """Sorted without repeats."""
    grams = np.sort(grams)
    fresh = np.empty(len(grams), dtype=bool)
    fresh[:1] = True
    np.not_equal(grams[1:], grams[:-1], out=fresh[1:])
    return grams[fresh]


def text_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted set of n-gram hashes) of every text."""
    for a, b, words in text_chunks(texts, NOT_SPACE):
        hashes = words.hashes()
        grams = gram_hashes(hashes, n)
        for r in range(b - a):
            start, stop = int(words.first[r]), int(words.first[r + 1])
            if stop - start >= n:
                yield a + r, distinct(grams[start : stop - n + 1])
            elif stop > start:
                yield a + r, mix(gram_hashes(hashes[start:stop], stop - start) + np.uint64(stop - start))
            else:
                yield a + r, np.zeros(0, dtype=np.uint64)


def fingerprint(grams: np.ndarray) -> tuple[int, int]:
    one = int(mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    two = int(mix(grams + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64))
    return one - (1 << 63), two - (1 << 63)


def ordered(grams: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """In the global order: n-grams that aren't frequent by hash, then frequent ones by rank; and how many aren't."""
    if not len(frequent) or not len(grams):
        return grams, len(grams)
    at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
    common = frequent[at] == grams
    return np.concatenate([grams[~common], grams[common][np.argsort(rank[at[common]], kind="stable")]]), len(grams) - int(common.sum())


def parity_bits(grams: np.ndarray) -> bytes:
    """A bit per slot, set if an odd number of entries fall in it; about as many slots as entries."""
    slots = 1 << min(16, max(6, int(len(grams) - 1).bit_length() if len(grams) else 6))
    count = np.bincount((grams & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
    return np.packbits((count & 1).astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


class _Seen(set):
    """Fingerprints met in a task; forgets when full, which only costs repeated work."""

    def first(self, key) -> bool:
        if key in self:
            return False
        if len(self) >= _SEEN:
            self.clear()
        self.add(key)
        return True


def _count_scan(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, _Seen()

        def told() -> pa.RecordBatch:
            grams, count = np.unique(np.concatenate(held) if held else np.zeros(0, dtype=np.uint64), return_counts=True)
            often = count >= LOCAL
            return pa.RecordBatch.from_arrays([pa.array(grams[often].view(np.int64)), pa.array(count[often].astype(np.int64))], names=["gram", "count"])

        for batch in batches:
            for _, grams in text_sets(batch.column(0), n):
                if len(grams) and seen.first(fingerprint(grams)):
                    held.append(grams)
                    size += len(grams)
                    if size >= COUNTED:
                        yield told()
                        held, size = [], 0
        yield told()

    return run


def frequent_grams(docs: DataFrame, n: int):
    """Broadcast (sorted hashes, ranks) of at most FREQUENT n-grams that many texts hold."""
    counts = docs.select("text").mapInArrow(_count_scan(n), "gram bigint, count bigint").groupBy("gram").agg(F.sum("count").alias("count"))
    top = counts.where(F.col("count") >= LEAST_COUNT).orderBy(F.desc("count"), "gram").limit(FREQUENT).toArrow()
    grams, count = top["gram"].to_numpy().view(np.uint64), top["count"].to_numpy()
    by_count = np.lexsort((grams, count))
    rank = np.empty(len(grams), dtype=np.int64)
    rank[by_count] = np.arange(len(grams))
    order = np.argsort(grams)
    return docs.sparkSession.sparkContext.broadcast((grams[order], rank[order]))


def _set_scan(n: int, percent: int, sent):
    """Every document with the fingerprint and size of its set; the first time a task meets a set, also its prefix and bitmap.

    The prefix comes in two parts, `rare` and `often`: hot n-grams are in the second.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        frequent, rank = sent.value
        for batch in batches:
            ones, twos, sizes, common, rare, often, bits = [], [], [], [], [], [], []
            for _, grams in text_sets(batch.column("text"), n):
                one, two = fingerprint(grams)
                ones.append(one)
                twos.append(two)
                sizes.append(len(grams))
                if len(grams) and seen.first((one, two)):
                    grams, light = ordered(grams, frequent, rank)
                    common.append(len(grams) - light)
                    prefix = grams[: prefix_size(len(grams), percent)].view(np.int64)
                    rare.append(prefix[:light])
                    often.append(prefix[light:])
                    bits.append(parity_bits(grams))
                else:
                    common.append(None)
                    rare.append(None)
                    often.append(None)
                    bits.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(sizes, pa.int64()), pa.array(common, pa.int64()),
                 pa.array(rare, pa.list_(pa.int64())), pa.array(often, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                names=["doc_id", "text_key", "f1", "f2", "n", "common", "rare", "often", "bits"],
            )

    return run


def _full_scan(n: int, sent):
    """Whole sets in the global order, as bytes; each once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = sent.value
        seen = _Seen()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [(fingerprint(g), g) for _, g in text_sets(part.column("text"), n)]
                rows = [(*f, ordered(g, frequent, rank)[0].tobytes()) for f, g in sets if seen.first(f)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
                    names=["f1", "f2", "grams"],
                )

    return run


class Trie:
    """Sets in global order, sorted: neighbours share their common prefix, which is the path to their fork."""

    def __init__(self, sets: list[tuple[int, np.ndarray]]):
        self.sets = sorted(sets, key=lambda s: s[1].byteswap().tobytes())
        self.shared = [0]
        for (_, before), (_, now) in zip(self.sets, self.sets[1:], strict=False):
            m = min(len(before), len(now))
            differ = np.flatnonzero(before[:m] != now[:m])
            self.shared.append(int(differ[0]) if len(differ) else m)

    def links(self, probe: np.ndarray, percent: int, first_only: bool, skip: int | None = None, step: int = 128) -> list[int]:
        """Ids of the sets that link to the probe; `skip` is the probe's own id."""
        size, known = len(probe), np.sort(probe)
        path = np.zeros(max((len(s) for _, s in self.sets), default=0) + 1, dtype=np.int64)  # overlap by depth on the present path
        depth = 0  # how far the present path has been walked
        found = []
        for (sid, grams), fork in zip(self.sets, self.shared, strict=True):
            depth = min(depth, fork)
            n = len(grams)
            wanted = need(n, size, percent)
            if sid == skip or wanted > min(n, size):
                continue
            while depth < n and path[depth] + n - depth >= wanted:
                part = grams[depth : depth + step]
                at = np.minimum(np.searchsorted(known, part), size - 1)
                path[depth + 1 : depth + len(part) + 1] = path[depth] + np.cumsum(known[at] == part)
                depth += len(part)
            if depth >= n and path[n] >= wanted:
                found.append(sid)
                if first_only:
                    break
        return found


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys in a partition sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(c[a].item() for c in columns)
            if last is not None and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


GROUP = ["key", "block", "batch"]


def _sieve(percent: int):
    """Sets of a block, and probes of a batch, that the bitmaps leave with a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]

        def told():
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[*GROUP, "sid", "probe"])

        for key, table in grouped(batches, GROUP):
            sid, n, probe = (table[c].to_numpy() for c in ("sid", "n", "probe"))
            bits = [np.frombuffer(b, dtype=np.uint8) for b in table["bits"].to_pylist()]
            width = min(len(b) for b in bits)
            rows = np.stack([folded(b, width) for b in bits])
            own, ask = np.flatnonzero(~probe), np.flatnonzero(probe)
            alive = np.zeros(len(own), dtype=bool)
            for p in ask.tolist():
                apart = np.bitwise_count(rows[own] ^ rows[p]).sum(axis=1)
                least = need(n[own], n[p], percent)
                good = (apart <= n[own] + n[p] - 2 * least) & (least <= np.minimum(n[own], n[p])) & (sid[own] != sid[p])
                if good.any():
                    alive |= good
                    for c, v in zip(out, (*key, int(sid[p]), True), strict=True):
                        c.append(v)
            for s in sid[own[alive]].tolist():
                for c, v in zip(out, (*key, s, False), strict=True):
                    c.append(v)
            if len(out[0]) > 20_000:
                yield told()
                out = [[], [], [], [], []]
        yield told()

    return run


def _walk(percent: int, first_only: bool):
    """Links between the probes and the sets of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in grouped(batches, GROUP):
            # a set that several tasks read is here as often
            once = {(s, p): g for s, p, g in zip(*(table[c].to_pylist() for c in ("sid", "probe", "grams")), strict=True)}
            rows = [(s, p, np.frombuffer(g, dtype=np.uint64)) for (s, p), g in once.items()]
            trie = Trie([(s, g) for s, p, g in rows if not p])
            a, b = [], []
            for s, p, g in rows:
                if p:
                    for other in trie.links(g, percent, first_only, s):
                        a.append(s)
                        b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _in_groups(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    return df.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, schema)


def _picked(ids: DataFrame) -> DataFrame:
    """A stored table of ids and numbers, to be broadcast if it has few enough rows."""
    return F.broadcast(ids) if ids.count() <= PICKED else ids


def block_links(stored_sets: DataFrame, probes: DataFrame, sets: DataFrame, full: Callable[[DataFrame], DataFrame], percent: int, first_only: bool) -> DataFrame:
    """Links (a, b) of every probe with the sets of the same key.

    stored_sets, probes: `key`, `sid`. sets: `sid`, `n`, `bits`. full: gives
    `sid` and `grams` of the sets it is asked for. Keys of any size are cut in
    blocks of sets and batches of probes.
    """
    blocks = stored_sets.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    batches = probes.groupBy("key").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("batches"))
    parts = blocks.join(batches, "key")

    def dealt(df: DataFrame, own: str, n_own: str, other: str, n_other: str, probe: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("sid"), F.col(n_own)).cast("int").alias(own)
        all_others = F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)).alias(other)
        return df.join(parts, "key").select("key", "sid", mine, all_others).select(*GROUP, "sid", F.lit(probe).alias("probe"))

    asked = dealt(stored_sets, "block", "blocks", "batch", "batches", False).union(dealt(probes, "batch", "batches", "block", "blocks", True))
    sieved = stored(_in_groups(asked.join(sets.select("sid", "n", "bits"), "sid"), _sieve(percent), "key long, block int, batch int, sid long, probe boolean"), "sieved")
    whole = full(sieved.select("sid").distinct())
    return stored(_in_groups(whole.join(_picked(sieved), "sid"), _walk(percent, first_only), "a long, b long"), "links")


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (`gram`, `sid`, ...) with their component, of the n-grams whose sets still lie in several components."""
    placed = rows.join(_picked(labels.withColumnRenamed("node", "sid")), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    placed = stored(placed, "placed")
    several = placed.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return stored(placed.join(several.select("gram"), "gram"), "open")


def _heaviest(open_: DataFrame, weight: DataFrame) -> DataFrame:
    """Every set against the heaviest component of each of its n-grams (`key`, `sid`): as many rows as entries at most."""
    heaviest = open_.join(_picked(weight), "component").groupBy("gram").agg(F.max(F.struct("weight", "component")).alias("top"))
    heaviest = stored(heaviest.select("gram", F.col("top.component").alias("key")), "heaviest")
    return open_.join(heaviest, "gram").where("component != key").select("key", "sid").distinct()


def _rest(open_: DataFrame, weight: DataFrame, percent: int) -> DataFrame:
    """Every set against each heavier component that it met and that its place in the n-gram's lists leaves possible (`key`, `sid`).

    Two sets that link have, at the first n-gram they share, at least as many
    n-grams left as they need in common. So what is left of both from an n-gram
    on bounds their sizes there, and a pair is dropped inside the join: sets that
    share a template in the last part of their prefix are compared by two numbers
    and never written.
    """
    size, left = F.col("n"), F.col("left")
    least = F.ceil(size * percent / 100)
    most = F.least(F.floor(size * 100 / percent), F.floor(left * (100 + percent) / percent) - size)
    lengths = open_.groupBy("gram", "component").agg(F.min("n").alias("key_least"), F.max("n").alias("key_most"), F.max("left").alias("key_left"))
    lengths = lengths.join(_picked(weight), "component").select(
        "gram", F.col("component").alias("key"), "key_least", "key_most", "key_left", F.col("weight").alias("key_weight")
    )
    wanted = F.ceil((size + F.greatest(least, F.col("key_least"))) * percent / (100 + percent))
    return open_.join(_picked(weight), "component").where(least <= most).join(lengths, "gram").where(
        (F.struct("key_weight", "key") > F.struct(F.col("weight"), F.col("component")))
        & (F.col("key_most") >= least) & (F.col("key_least") <= most) & (F.col("key_left") >= wanted)
    ).select("key", "sid").distinct()


def text_key(text: Column) -> Column:
    """64 bits of the text, null as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Per document (`doc_id`, `text`): `doc_id`, `n_shingles` and `component_id`; also its `text_key` and the `component` as a number (null without words).

    `component_id` is the least id in the component, so where ids repeat, only
    `component` tells two components apart.
    """
    docs = docs.select("doc_id", "text")
    bounded_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        id_type = docs.schema["doc_id"].dataType.simpleString()
        sent = frequent_grams(docs, n)
        described = docs.withColumn("text_key", text_key(F.col("text"))).mapInArrow(
            _set_scan(n, percent, sent),
            f"doc_id {id_type}, text_key bigint, f1 bigint, f2 bigint, n bigint, common bigint, rare array<bigint>, often array<bigint>, bits binary",
        )
        described = stored(described.withColumn("sid", F.monotonically_increasing_id()), "described")
        sets = described.where("bits is not null")

        def full(wanted: DataFrame) -> DataFrame:
            own = stored(sets.join(wanted, "sid").select("sid", "f1", "f2", F.col("doc_id").alias("of")), "wanted")
            texts = docs.join(_picked(own).select("of"), F.col("doc_id").eqNullSafe(F.col("of")), "left_semi").select("text")
            read = texts.mapInArrow(_full_scan(n, sent), "f1 bigint, f2 bigint, grams binary")
            return read.join(_picked(own).select("sid", "f1", "f2"), ["f1", "f2"]).select("sid", "grams")

        # A rare n-gram has few sets, and the first is its centre. A frequent one has any number, so its centre comes from
        # partial aggregates: the set with most frequent n-grams, what the rest was copied from if that is there.
        in_gram = W.partitionBy("gram")
        few = sets.select("sid", "n", F.posexplode("rare").alias("place", "gram")).select("sid", "gram", (F.col("n") - F.col("place")).cast("int").alias("left"))
        few = few.withColumns({"centre": F.min("sid").over(in_gram), "last": F.max("sid").over(in_gram)})
        many = sets.select("sid", "common", (F.col("n") - F.size("rare")).alias("n"), F.posexplode("often").alias("place", "gram"))
        many = many.select("sid", "common", "gram", (F.col("n") - F.col("place")).cast("int").alias("left"))
        centres = many.groupBy("gram").agg(F.max(F.struct("common", (-F.col("sid")).alias("sid"))).alias("top"), F.count("*").alias("held")).where("held > 1")
        centres = stored(centres.select("gram", (-F.col("top.sid")).alias("centre")), "centres")
        many = many.join(_picked(centres), "gram").select("sid", "gram", "centre", "left")
        met = stored(few.where("centre < last").select("sid", "gram", "centre", "left").union(many), "met")

        # a set is held against the centre that it shares most n-grams with; all others are left to later rounds
        shared = met.where("sid != centre").groupBy("sid", "centre").agg(F.count("*").alias("shared"))
        stars = shared.groupBy("sid").agg(F.max_by("centre", F.struct("shared", -F.col("centre"))).alias("key"))
        first_of = sets.groupBy("f1", "f2").agg(F.min("sid").alias("a"), F.max("sid").alias("last")).where("a < last")
        twins = sets.select("f1", "f2", F.col("sid").alias("b")).join(first_of, ["f1", "f2"]).select("a", "b")
        links = block_links(stars, stars.select("key", F.col("key").alias("sid")).distinct(), sets, full, percent, False).union(twins)
        labels, fresh = stored(components(links), "components"), True
        open_ = _open(met.select("gram", "sid", "left"), labels)
        open_ = stored(open_.join(_picked(sets.select("sid", "n")), "sid"), "open")
        # a round without a new link would only be repeated, so the last one follows
        for last_round in (*[False] * ROUNDS, True):
            if not (last_round or fresh):
                continue
            members = open_.select("component", "sid").distinct()
            weight = stored(members.groupBy("component").agg(F.count("*").alias("weight")), "weight")
            asks = stored(_rest(open_, weight, percent) if last_round else _heaviest(open_, weight), "asks")
            fresh = False
            if not asks.isEmpty():
                asked = members.withColumnRenamed("component", "key").join(asks.select("key").distinct(), "key", "left_semi")
                links = block_links(asked, asks, sets, full, percent, True)
                fresh = not links.isEmpty()
            if fresh:
                # stars stand for all links before
                labels = stored(components(links.union(labels)), "components")
                if not last_round:
                    open_ = _open(open_.drop("component"), labels)

        labels = sets.select("f1", "f2", "sid").join(labels.withColumnRenamed("node", "sid"), "sid", "left")
        labels = stored(labels.groupBy("f1", "f2").agg(F.min(F.coalesce("component", "sid")).alias("component")), "labels")
        named = described.select("doc_id", "text_key", "f1", "f2", "n").join(labels, ["f1", "f2"], "left")
        named = keep(named.select("doc_id", "text_key", "n", "component"), "named")
        least = keep(named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    return named.join(least, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_key", "component",
    )
