"""Best-fit packing: length patterns by non-negative least squares, the rest by best fit, all on the length histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from packwright.llm.common import bound_batches, map_pandas, materialize
from packwright.llm.tokens import Encoder

END_ID, MAX_TOKENS = 2, 1024
#: Pieces of one length that are numbered in one group, at least; and about how many groups there are at most, beside one for each length.
GROUP_ROWS, GROUPS = 256, 1 << 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"


def cut_points(n: int, max_tokens: int) -> list[int]:
    """Where the pieces of n tokens start: the first may be shorter than max_tokens, the others are full."""
    first = n if n <= max_tokens else (n - 1) % max_tokens + 1
    return [0, *range(first, n, max_tokens)]


def pieces(documents: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Tokenize each text (null: empty), append end_id and cut; one row per piece."""
    bound_batches(documents.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = Encoder.of(tokenizer), np.uint32(end_id).tobytes()
        for b in batches:
            rows = []
            for doc, ids in zip(b["doc_id"].array, encoder.encode_many([t or "" for t in b["text"]]), strict=True):
                ids += end
                n = len(ids) // 4
                at = cut_points(n, max_tokens)
                for k, (s, e) in enumerate(zip(at, [*at[1:], n], strict=True)):
                    crc = zlib.crc32(ids[4 * s : 4 * e])
                    rows.append((None if pd.isna(doc) else int(doc), k, s, e - s, crc, crc & 0x7FFFFFFF))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_pandas, cut, PIECES)


def patterns(capacity: int) -> np.ndarray:
    """All ways to fill capacity exactly with one to three lengths, descending; 0 stands for no document."""
    a = np.arange(1, capacity + 1)
    one = [[capacity, 0, 0]]
    two = np.stack([capacity - a[: capacity // 2], a[: capacity // 2], np.zeros(capacity // 2, int)], 1)
    c, b = np.meshgrid(a[: capacity // 3], a[: capacity // 2], indexing="ij")
    first = capacity - b - c
    keep = (b >= c) & (first >= b)
    return np.concatenate([one, two, np.stack([first[keep], b[keep], c[keep]], 1)])


def fit_counts(histogram: np.ndarray, shapes: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Repeat counts x >= 0 that bring shapes.T @ x near histogram in least squares, by multiplicative updates.

    histogram[l] is the number of documents of l tokens; shapes that use a length without any are left out."""
    live = np.flatnonzero(np.all((shapes == 0) | (histogram[shapes] > 0), axis=1))
    s, size = shapes[live], len(histogram)
    if not len(live):
        return np.zeros(len(shapes))
    parts, weights = s.ravel(), (s > 0).astype(float).ravel()
    spread = lambda x: np.bincount(parts, np.repeat(x, 3) * weights, minlength=size)
    gather = lambda h: (h[parts] * weights).reshape(-1, 3).sum(axis=1)
    target = histogram.astype(float)
    target[0] = 0
    scale = 1 / np.maximum(target, 1)  # relative errors, else rare lengths don't count
    top = gather(target * scale)
    x = np.full(len(live), target.sum() / len(live) / 3)
    for _ in range(rounds):
        x *= top / np.maximum(gather(spread(x) * scale), 1e-12)
    out = np.zeros(len(shapes))
    out[live] = x
    return out


def plan(histogram: np.ndarray, capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, documents, first sequence, offset) for runs of documents of one length, and the number of sequences.

    The i-th document of a run goes to sequence first + i at that offset. Its size
    depends on capacity only, never on the number of documents."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    used, runs, n_seq = np.zeros_like(left), [], 0

    def place(length: int, count: int, seq: int, offset: int) -> None:
        runs.append((int(length), int(used[length]), int(count), int(seq), int(offset)))
        used[length] += count
        left[length] -= count

    shapes = patterns(capacity)
    fitted = fit_counts(left, shapes)
    for rounding in (np.floor(fitted), np.ceil(fitted - 1e-3)):
        for k in np.argsort(-fitted, kind="stable")[: int((rounding > 0).sum())]:
            shape = [int(v) for v in shapes[k] if v]
            times = int(min([rounding[k], *(left[v] // shape.count(v) for v in shape)]))
            if times > 0:
                for v, offset in zip(shape, accumulate([0, *shape[:-1]]), strict=True):
                    place(v, times, n_seq, offset)
                n_seq += times
                rounding[k] -= times
    # The rest: best fit, longest first, on groups of sequences that are equally full.
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, count)
    for length in range(capacity, 0, -1):
        while left[length] > 0:
            room = min((r for r in rooms if r >= length), default=0)
            if room:
                seq, count = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                take = min(count, int(left[length]))
                place(length, take, seq, capacity - room)
                if count > take:
                    rooms.setdefault(room, []).append((seq + take, count - take))
                if room > length:
                    rooms.setdefault(room - length, []).append((seq, take))
            else:
                fit = capacity // length
                count = max(1, int(left[length]) // fit)
                per = min(fit, int(left[length]))
                for k in range(per):
                    place(length, count, n_seq, k * length)
                if capacity > per * length:
                    rooms.setdefault(capacity - per * length, []).append((n_seq, count))
                n_seq += count
    return runs, n_seq


def pack(documents: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row of documents.

    Null and empty texts are one piece of one token (end_id). Rows with one doc_id, or none, are
    packed each by itself. The driver sees the histogram (max_tokens numbers) and the
    plan made from it. Pieces of one length are told apart by a rank; a length that
    many share is numbered in salted groups of about GROUP_ROWS rows (more where there would be over GROUPS of them), so none
    outgrows a task. Very long texts are tokenized whole and cut. Columns of documents other than doc_id and text, whatever their
    names, are left out; an empty table gives no rows."""
    spark = documents.sparkSession
    rows = materialize(pieces(documents, tokenizer, max_tokens, end_id), "pieces")
    histogram = np.zeros(max_tokens + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():
        histogram[length] = n
    runs, _ = plan(histogram, max_tokens)
    per_group = max(GROUP_ROWS, int(histogram.sum()) // GROUPS)
    groups = F.element_at(F.lit([int(-(-n // per_group)) or 1 for n in histogram]), F.col("length").cast("int") + 1)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "salt"), groups.cast("long")).cast("int"))
    bases = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("local", F.row_number().over(local) - 1).join(F.broadcast(bases), ["length", "salt"])  # at most GROUPS + max_tokens rows
    ranked = ranked.withColumn("rank", F.col("local") + F.col("base"))

    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, first, count, seq, offset in sorted(runs):
        by_length.setdefault(length, []).append((first, count, seq, offset))
    tables = {k: np.array(v, np.int64) for k, v in by_length.items()}
    shared = spark.sparkContext.broadcast(tables)  # at most a few runs for each of max_tokens lengths

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            seq, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for v in np.unique(length):
                at = np.flatnonzero(length == v)
                run = known[int(v)][np.searchsorted(known[int(v)][:, 0], rank[at], "right") - 1]
                seq[at], offset[at] = run[:, 2] + rank[at] - run[:, 0], run[:, 3]
            yield pd.DataFrame({"doc_id": b["doc_id"], "piece": b["piece"], "start": b["start"], "length": length, "ids_crc32": b["ids_crc32"], "sequence_id": seq, "offset": offset})

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").transform(map_pandas, assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
