"""N-gram Jaccard join: MinHash candidates, Bayesian pruning of their pairs, exact verification."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm.common import bound_batches, map_pandas, materialize, mix64, shingle_hashes, word_hashes

WORDS, THRESHOLD = 5, 0.8
#: MinHash values of a text: BANDS groups of BAND_ROWS. Two texts at the threshold share no group once in 65,000 times.
BANDS, BAND_ROWS = 28, 5
N_HASHES = BANDS * BAND_ROWS
#: MinHash values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 20, 1e-5
#: Members of a bucket that are compared with each other in one block.
BLOCK = 256
#: Texts and bytes of shingles of a class that are counted against each other in one block (at least LEAST_BLOCK texts, then a BLOCKS-th of the class, at most
#: CLASS_BLOCK), and columns met at a time.
LEAST_BLOCK, BLOCKS, CLASS_BLOCK, CLASS_BYTES, COLUMNS = 128, 16, 1024, 8 << 20, 4096
#: Parts of a class when its members are counted.
SALTS = 32
#: Rows of one key that meet in one task, at least; keys with more are broadcast, and there are at most about HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 256, 1 << 16
#: Distinct links up to which one task finds their components, in arrays of 16 bytes a link, and rows that it returns at a time.
ONE_TASK_LINKS, OUT_ROWS = 2_000_000, 1 << 16
#: Bits of the table by which rows without a key are left out before a join, for each key, and bits of the largest table (32 MB).
KEY_BITS, MOST_BITS = 16, 1 << 28
_MULTIPLIERS = np.random.RandomState(1_000_003).randint(0, 2**63, N_HASHES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
FEATURES = "doc_id long, text_hash long, n int, key_a long, key_b long, sig binary, bands array<long>"


def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number of distinct shingles, two hashes of their set, MinHash values (16 bits each) and band hashes of each text."""
    for b in batches:
        hashes, bounds = shingle_hashes(*word_hashes(list(b["text"])), WORDS)
        sizes = np.diff(bounds)
        full = np.flatnonzero(sizes)
        mins = np.empty((len(full), N_HASHES), np.uint64)
        if len(full):
            for k, m in enumerate(_MULTIPLIERS):
                mins[:, k] = np.minimum.reduceat(hashes * m, bounds[:-1][full])
        mins = mix64(mins)
        band = np.zeros((len(full), BANDS), np.uint64)
        for k in range(BAND_ROWS):
            band = mix64(band + mins[:, k::BAND_ROWS] + np.arange(BANDS, dtype=np.uint64))
        n, key_a, key_b = np.zeros(len(b), np.int32), np.zeros(len(b), np.uint64), np.zeros(len(b), np.uint64)
        for i in full:
            own = np.unique(hashes[bounds[i] : bounds[i + 1]])
            n[i], key_a[i], key_b[i] = len(own), own.sum(), mix64(own).sum()
        sig: list[bytes | None] = [None] * len(b)
        bands: list[np.ndarray | None] = [None] * len(b)
        for row, i in enumerate(full):
            sig[i] = mins[row].astype("<u2").tobytes()
            bands[i] = band[row].view(np.int64)
        yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "n": n, "key_a": key_a.view(np.int64), "key_b": key_b.view(np.int64), "sig": sig, "bands": bands})


def shingle_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        hashes, bounds = shingle_hashes(*word_hashes(list(b["text"])), WORDS)
        yield pd.DataFrame({"uid": b["uid"], "shingles": [np.unique(hashes[s:e]).tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]})


@cache
def least_matches(threshold: float = THRESHOLD) -> np.ndarray:
    """At each step, the least number of equal MinHash values with which P(similarity >= threshold) is at least TOLERANCE.

    With a uniform prior, the posterior after m of n is the chance of at most m
    successes in n + 1 trials of probability threshold."""
    out = []
    for n in range(STEP, N_HASHES + 1, STEP):
        below, m = 0.0, -1
        while below < TOLERANCE:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def survivors(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Rows of two signature matrices whose pair stays through all steps; each step looks only at the pairs still there."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, least in enumerate(least_matches(threshold)):
        cut = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (a[alive, cut] == b[alive, cut]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    return alive


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(-1, N_HASHES)


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.concatenate([x, y])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same / max(1, len(both) - same)


def hot_limit(rows: int) -> int:
    """How many rows of one key may meet in a task, so that at most HOT_KEYS keys of a table have more."""
    return max(HOT_ROWS, rows // HOT_KEYS)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], n: str, limit: int, once: bool = False) -> DataFrame:
    """left joined with right, which has one row a key and in n how many rows of left have it; if once, any one row of each key.

    Keys with more than limit rows are broadcast, so those rows stay where they are; the others meet in tasks."""
    hot = F.broadcast(right.where(F.col(n) > limit))  # at most HOT_KEYS rows, as limit comes from hot_limit()
    rest = left.join(hot.select(keys), keys, "left_anti").join(right.where(F.col(n) <= limit), keys)
    found = left.join(hot, keys)
    return found.dropDuplicates(keys).unionByName(rest.dropDuplicates(keys)) if once else found.unionByName(rest)


def with_known_hash(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Rows of left whose hash in column may be one of right, so that few others are shuffled by a join that follows. None that joins is lost.

    The hashes of right are bits of a table of KEY_BITS bits a row, MOST_BITS at most, which is broadcast in rows of 4 KB."""
    bits = min(MOST_BITS, max(1, KEY_BITS * right.count()))
    place = F.pmod(F.col(column), F.lit(bits)) + 1
    table = right.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    at = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = left.withColumn("part", F.bitmap_bucket_number(place)).join(F.broadcast(table), "part")
    return marked.where(F.getbit(byte, at % 8) == 1).select(left.columns)


def star_pairs(headed: DataFrame, payload: DataFrame, column: str, close: Callable[[np.ndarray, np.ndarray, list], np.ndarray]) -> DataFrame:
    """The pairs uid, head of headed that close() accepts. payload: uid and the column to compare.

    Members of a head meet it in blocks of at most about hot_limit() rows, and a block has
    the head's payload once, in its first row. close(head row of each, member rows, payloads) gives a boolean for each member."""
    counts = headed.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    limit = hot_limit(headed.count())
    hot = F.broadcast(counts.where(F.col("n") > limit).select("head", F.ceil(F.col("n") / limit).cast("int").alias("blocks")))  # at most HOT_KEYS rows
    blocks = F.coalesce("blocks", F.lit(1))
    members = headed.join(hot, "head", "left").select("uid", "head", F.pmod(F.xxhash64("uid", F.lit(5)), blocks).cast("int").alias("block"))
    heads = counts.join(hot, "head", "left").select(F.col("head").alias("uid"), "head", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    rows = members.unionByName(heads).join(payload.select("uid", column), "uid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, of = None, None
        for x in batches:
            if not len(x):
                continue
            uid, head, values = x["uid"].to_numpy(np.int64), x["head"].to_numpy(np.int64), list(x[column])
            first = np.flatnonzero(uid == head)
            mine = np.searchsorted(first, np.arange(len(x)), "right") - 1
            if (mine < 0).any():  # the batch before had this block's head
                values.append(last)
            place = np.append(first, len(x))[mine] if len(first) else np.full(len(x), len(x))
            rows = np.flatnonzero(uid != head)
            keep = rows[close(place[rows], rows, values)] if len(rows) else rows
            yield pd.DataFrame({"uid": uid[keep], "head": head[keep]})
            if len(first):
                last, of = values[first[-1]], head[first[-1]]
            assert of == head[-1]

    grouped = rows.repartition("head", "block").sortWithinPartitions("head", "block", F.col("uid") != F.col("head"))
    return grouped.transform(map_pandas, run, "uid long, head long")


def prune(headed: DataFrame, signatures: DataFrame, threshold: float) -> DataFrame:
    """Pairs uid, head that outlive the incremental comparison of their MinHash values."""

    def close(heads: np.ndarray, members: np.ndarray, values: list[bytes]) -> np.ndarray:
        sig = _signatures(values)
        keep = np.zeros(len(members), bool)
        keep[survivors(sig[heads], sig[members], threshold)] = True
        return keep

    return star_pairs(headed, signatures, "sig", close)


def verify(headed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs uid, head whose exact similarity reaches the threshold."""

    def close(heads: np.ndarray, members: np.ndarray, values: list[bytes]) -> np.ndarray:
        return np.array([jaccard(values[h], values[m]) >= threshold for h, m in zip(heads, members, strict=True)], bool)

    return star_pairs(headed, sets, "shingles", close)


def compare_blocks(members: DataFrame, threshold: float, exact: bool) -> DataFrame:
    """Compare members of a bucket that are in different components, in blocks.

    members: bucket, uid, comp, sig, block, blocks, and if exact bands and shingles. A bucket of many blocks is met as
    pairs of blocks in as many groups, each of at most about 2 * BLOCK rows. Returned
    are, if not exact, uid of members with a pair that outlives pruning; if exact, the verified links a, b, each
    in the first bucket that its ends share. Pairs themselves never become rows."""
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    keyed = spread.select(F.xxhash64("bucket", "lo", "hi").alias("group"), "bucket", "block", "lo", "hi", "uid", "comp", "sig", *(["bands", "shingles"] if exact else []))

    def compare(held: pd.DataFrame) -> pd.DataFrame:
        group, bucket, doc, comp = (held[c].to_numpy() for c in ("group", "bucket", "uid", "comp"))
        mixed, block = (held["lo"] != held["hi"]).to_numpy(), held["block"].to_numpy()
        sig, pairs = _signatures(held["sig"]), [np.zeros((2, 0), np.int64)]
        bands = np.stack(held["bands"].to_numpy()) if exact else None
        for lag in range(1, len(held)):
            i = np.flatnonzero(group[lag:] == group[:-lag])
            if not len(i):
                break
            i = i[(comp[i] != comp[i + lag]) & ~(mixed[i] & (block[i] == block[i + lag]))]
            i = i[survivors(sig[i], sig[i + lag], threshold)]
            if exact and len(i):
                first = (bands[i] == bands[i + lag]).argmax(axis=1)
                i = i[bands[i, first] == bucket[i]]
                shingles = held["shingles"]
                i = i[np.array([jaccard(shingles[k], shingles[k + lag]) >= threshold for k in i], bool)]
            pairs.append(np.sort(np.stack([doc[i], doc[i + lag]]), axis=0))
        a, b = np.concatenate(pairs, axis=1)
        return pd.DataFrame({"a": a, "b": b}) if exact else pd.DataFrame({"uid": np.unique(np.concatenate([a, b]))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for x in batches:
            if not len(x):
                continue
            group = x["group"].to_numpy()
            last = group == group[-1]  # this group may go on
            if last.all() and held and held[-1]["group"].iloc[-1] == group[-1]:
                held.append(x)
                continue
            if done := [y for y in (*held, x[~last]) if len(y)]:
                yield compare(pd.concat(done, ignore_index=True))
            held = [x[last]]
        if held:
            yield compare(pd.concat(held, ignore_index=True))

    return keyed.repartition("group").sortWithinPartitions("group").transform(map_pandas, run, "a long, b long" if exact else "uid long").distinct()


def components(links: DataFrame) -> DataFrame:
    """uid, comp (its least uid) for the ends of distinct links a < b that aren't the least, written to the shared folder.

    Up to ONE_TASK_LINKS links are gathered in one task; more are shuffled in rounds."""
    few = links.count() <= ONE_TASK_LINKS
    return materialize(_components_in_a_task(links) if few else _components_by_stars(links), "components")


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of each of n nodes, the least node of its component under the links a, b.

    In each round every root with a lesser neighbour hooks to its least one, so at least half of the roots that still have links go."""
    label = np.arange(n)
    while len(a):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label = up
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    return label


def _components_in_a_task(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.stack([x["a"].to_numpy(np.int64), x["b"].to_numpy(np.int64)]) for x in batches]
        if not held:
            return
        uid, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        a, b = ends.reshape(2, -1)
        comp = uid[least_labels(a, b, len(uid))]
        uid, comp = uid[uid != comp], comp[uid != comp]
        for k in range(0, len(uid), OUT_ROWS):
            yield pd.DataFrame({"uid": uid[k : k + OUT_ROWS], "comp": comp[k : k + OUT_ROWS]})

    return links.select("a", "b").coalesce(1).transform(map_pandas, run, "uid long, comp long")


def _components_by_stars(links: DataFrame) -> DataFrame:
    """Alternating large and small stars: every round is joins and minima over links, written to the shared folder; the driver sees two
    numbers a round. A node with many neighbours meets them by broadcast (join_hot), not in one task."""
    edges = materialize(links.select(F.col("a").alias("v"), F.col("b").alias("u")), "links")  # v < u
    state = None
    n = edges.count()
    while True:
        limit = hot_limit(2 * n)
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_hot(both.where("v > u"), least, ["u"], "n", limit).select(F.col("m").alias("v"), F.col("v").alias("u")).where("v != u").distinct()
        large = materialize(large, "large_stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_hot(large, least, ["u"], "n", limit).select(F.col("m").alias("v"), F.col("v").alias("u"))
        small = small.unionByName(least.select(F.col("m").alias("v"), "u")).where("v != u").distinct()
        edges = materialize(small, "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u") % 1_000_000_007)).first())
        if now == state:
            break
        state, n = now, now[0]
    return edges.select(F.col("u").alias("uid"), F.col("v").alias("comp"))


def with_components(ids: DataFrame, comps: DataFrame) -> DataFrame:
    return ids.join(comps, "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))


def similar_counts(sets: list[bytes], left: np.ndarray, right: np.ndarray, threshold: float, weight: np.ndarray | None = None) -> np.ndarray:
    """How many of the sets right each of the sets left is similar to and, where these differ, the other way round; one number a set.
    A set counts as its weight, the number of texts that have it (by default 1).

    Sets are rows of a 0/1 matrix whose columns are the shingles that two or more of
    them have; its products, COLUMNS at a time, are the sizes of all intersections."""
    values = [np.frombuffer(x, np.uint64) for x in sets]
    size = np.array([len(v) for v in values])
    row = np.repeat(np.arange(len(sets)), size)
    _, col, times = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    shared = times[col] > 1
    row, col = row[shared], (np.cumsum(times > 1) - 1)[col[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    same = np.zeros((len(left), len(right)))
    for first in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        s, e = np.searchsorted(col, [first, first + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[row[s:e], col[s:e] - first] = 1
        same += has[left] @ has[right].T
    links = same / np.maximum(1, size[left][:, None] + size[right][None, :] - same) >= threshold
    links &= left[:, None] != right[None, :]
    out = np.zeros(len(sets), np.int64)
    weight = np.ones(len(sets), np.int64) if weight is None else weight
    out[left] += links @ weight[right]
    if not np.array_equal(left, right):
        out[right] += weight[left] @ links
    return out


def count_links(members: DataFrame, threshold: float) -> DataFrame:
    """uid, n_links: to how many texts of other sets of its class each is similar, all compared exactly.

    members: uid, comp, n_texts, shingles. A class is cut into blocks of LEAST_BLOCK to CLASS_BLOCK texts and
    at most CLASS_BYTES on average, and met as pairs of blocks, so a class of any size splits; only sums leave a pair of blocks."""
    salted = members.withColumn("salt", F.pmod(F.xxhash64("uid", F.lit(11)), F.lit(SALTS)))
    parts = salted.groupBy("comp", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("shingles")).alias("bytes"))
    block = F.least(F.greatest(F.sum("n") / BLOCKS, F.lit(LEAST_BLOCK)), F.lit(CLASS_BLOCK))
    blocks = F.ceil(F.greatest(F.sum("n") / block, F.sum("bytes") / CLASS_BYTES)).cast("int")
    large = parts.groupBy("comp").agg(blocks.alias("blocks")).where("blocks > 1")
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    placed = salted.join(large, ["comp", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(7)), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = spread.select("comp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "uid", "n_texts", "shingles")

    def count(group: pd.DataFrame) -> pd.DataFrame:
        at = np.arange(len(group))
        left = at[(group["block"] == group["lo"]).to_numpy()]
        right = at[(group["block"] == group["hi"]).to_numpy()]
        return pd.DataFrame({"uid": group["uid"], "n": similar_counts(list(group["shingles"]), left, right, threshold, group["n_texts"].to_numpy())})

    counts = met.groupBy("comp", "lo", "hi").applyInPandas(count, "uid long, n long")
    return counts.groupBy("uid").agg(F.sum("n").alias("n_links"))


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD, with_links: bool = True) -> DataFrame:
    """One row per row of documents: doc_id, text_id, n_copies, class_id, and n_links if with_links.

    Words are runs of letters, numbers and underscores of the lower-cased whole text, however long; texts
    are compared as sets of runs of WORDS words (a shorter one has one run). text_id is the least doc_id with the
    same set, n_copies how many rows have it. class_id is the least doc_id of
    the rows that links (similarity >= threshold) join, through others too.
    n_links is the number of other, different texts that are similar to the text; copies of a text count as one, texts that
    differ in case or punctuation only do not. All texts of a class are compared for it, exactly and in blocks.
    Null and empty texts and texts without a word are copies of none: each is its own class. Rows that share a
    doc_id are each taken by their text; repeated rows are copies. A row without doc_id has a null text_id and class_id and no links.
    Columns other than doc_id and text, whatever their names, are left out; an empty table gives no rows.

    1. Equal sets become one text. 2. Its MinHash bands are buckets; each bucket names two
    heads, one at random and the member whose buckets are largest (the text that the others vary), and each member
    is paired with them, so pairs grow with the members, not their square. 3. Pruned and verified, these links give components. 4. In buckets that
    still hold several components, members of different ones are compared in blocks of
    BLOCK, and what outlives pruning is verified there. So no link between two classes is lost. 5. A
    link joins texts of one class, so links are counted within the classes."""
    bound_batches(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    feats = materialize(texts.transform(map_pandas, features, FEATURES), "features")
    worded = feats.where("n > 0 and doc_id is not null")
    of_rows = hot_limit(feats.count())
    first = F.min_by(F.struct("doc_id", "text_hash", "sig", "bands"), F.struct("doc_id", "text_hash"))
    reps = worded.groupBy("key_a", "key_b").agg(first.alias("r"), F.count(F.lit(1)).alias("n_copies"), (F.min("text_hash") != F.max("text_hash")).alias("mixed"))
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("uid"), "key_a", "key_b", "r.*", "n_copies", "mixed"), "texts")

    rows = reps.select("uid", F.explode("bands").alias("bucket"))
    of_bands = hot_limit(BANDS * reps.count())
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = materialize(join_hot(rows, materialize(sizes, "sizes"), ["bucket"], "size", of_bands), "buckets")
    members = buckets.groupBy("uid").agg(F.sum("size").alias("met"))
    central = F.max(F.struct("met", -F.col("uid"))).getField("col2")
    heads = buckets.join(members, "uid").groupBy("bucket").agg((-central).alias("head"), F.min_by("uid", F.xxhash64("uid", "bucket")).alias("other_head"), F.max("size").alias("size"))
    headed = join_hot(buckets.select("uid", "bucket"), materialize(heads, "heads"), ["bucket"], "size", of_bands)
    headed = materialize(headed.select("uid", F.explode(F.array("head", "other_head")).alias("head")).where("uid != head").distinct(), "headed")
    own = reps.join(members.select("uid"), "uid", "left_semi")
    near = materialize(own.select("uid", "sig", "bands", "doc_id", "text_hash", "n_copies"), "signatures")
    wanted = near.select("uid", "doc_id", "text_hash", "n_copies")
    sets = join_hot(with_known_hash(texts, wanted, "text_hash"), wanted, ["doc_id", "text_hash"], "n_copies", of_rows, once=True).select("uid", "text")
    sets = materialize(sets.transform(map_pandas, shingle_sets, "uid long, shingles binary"), "sets")
    near = near.select("uid", "sig", "bands")

    links = verify(materialize(prune(headed, near, threshold), "pruned"), sets, threshold)
    links = materialize(links.select(F.least("uid", "head").alias("a"), F.greatest("uid", "head").alias("b")).distinct(), "head_links")
    comps = components(links)
    held = with_components(buckets.select("bucket", "uid"), comps)
    open_ = held.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size")).where("low != high")
    open_ = join_hot(held, materialize(open_.select("bucket", "size"), "open"), ["bucket"], "size", of_bands)
    open_ = open_.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("uid", F.lit(7)), F.col("blocks")).cast("int"))
    open_ = materialize(open_, "open_members")
    close = materialize(compare_blocks(open_.join(near.drop("bands"), "uid"), threshold, exact=False), "close")
    more = compare_blocks(open_.join(near.join(close, "uid").join(sets, "uid"), "uid"), threshold, exact=True)
    every = materialize(links.unionByName(more), "all_links")
    if every.count() > links.count():
        comps = components(every)

    known = with_components(reps.select("uid", "key_a", "key_b", "doc_id", "n_copies"), comps)
    classes = known.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    known = join_hot(known, classes, ["comp"], "n", of_rows).select("uid", "key_a", "key_b", F.col("doc_id").alias("text_id"), "n_copies", "class_id")
    alone = feats.where("n = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("text_id"), F.lit(1).cast("long").alias("n_copies"), F.col("doc_id").alias("class_id"))
    if with_links:
        mixed = reps.where("mixed").select("uid", "key_a", "key_b", "n_copies")
        mixed = join_hot(worded.select("key_a", "key_b", "text_hash"), mixed, ["key_a", "key_b"], "n_copies", of_rows)
        mixed = materialize(mixed.groupBy("uid").agg(F.count_distinct("text_hash").alias("n_texts")), "mixed")
        n_texts = F.coalesce("n_texts", F.lit(1).cast("long"))  # sets that are not mixed are of one text
        ends = every.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
        linked = with_components(ends, comps).join(mixed, "uid", "left").withColumn("n_texts", n_texts).join(sets, "uid")
        counts = count_links(materialize(linked, "linked"), threshold)
        known = known.join(mixed, "uid", "left").join(counts, "uid", "left")
        known = known.withColumn("n_links", n_texts - 1 + F.coalesce("n_links", F.lit(0).cast("long"))).drop("n_texts")
        alone = alone.withColumn("n_links", F.lit(0).cast("long"))
    found = join_hot(worded.select("doc_id", "key_a", "key_b"), materialize(known.drop("uid"), "known"), ["key_a", "key_b"], "n_copies", of_rows).drop("key_a", "key_b")
    return found.unionByName(alone)
