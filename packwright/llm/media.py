"""Media columns: lossless 8-bit audio, log-mel features and energy segments with time spans."""

from __future__ import annotations

import hashlib
import io
import uuid
import wave
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from packwright.llm.common import bound_batches, map_pandas, materialize, new_path
from packwright.llm.token_output import open_store

UNIT = 64
STORED_RATE, UP, DOWN, TAPS = 16_000, 1, 2, 16
FRAME, HOP, FFT, MELS = 200, 80, 256, 20
#: Steps of one in the stored log energies: whole 128ths take half the room of all 32 bits when compressed.
STEPS = 128
#: Frames of one tensor, and of the energy window; levels in dB over the floor that open and close a segment; shortest segment.
TILE, OPEN_DB, CLOSE_DB, SHORTEST = 64, 6.0, 3.0, 5
#: Of the files that stand beside the tensors.
DOC_COLUMNS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
_tables: dict[str, np.ndarray] = {}


def to_media(text: str | None) -> tuple[bytes, int]:
    """A WAV file of 8-bit samples that hold the padded UTF-8 bytes, and the number of bytes before padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(STORED_RATE)
        f.writeframes(raw.ljust(size, b"\0"))
    return out.getvalue(), len(raw)


def from_media(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling by up / down: each output takes the phase of the low-pass filter that meets input samples."""
    half = TAPS * max(up, down) // 2
    t = np.arange(-half, half + 1)
    cut = 1 / max(up, down)
    low = cut * np.sinc(cut * t) * np.hamming(len(t)) * up
    n_out = -(-len(x) * up // down)
    phases = [low[p::up] for p in range(up)]
    reach = max(map(len, phases))
    padded = np.concatenate([np.zeros(reach), x, np.zeros(reach + down + 1)])
    y = np.zeros(n_out)
    for first in range(min(up, n_out)):
        # outputs first, first + up, ... share a phase, and read inputs down apart
        place = first * down + half
        phase, base = place % up, place // up + reach
        count = -(-(n_out - first) // up)
        for k, h in enumerate(phases[phase]):
            at = base - k
            y[first::up] += h * padded[at : at + (count - 1) * down + 1 : down]
    return y


def mel_filters(rate: float) -> np.ndarray:
    if "mel" not in _tables:
        mel = lambda f: 2595 * np.log10(1 + f / 700)
        points = np.linspace(mel(60.0), mel(rate / 2), MELS + 2)
        hz = 700 * (10 ** (points / 2595) - 1)
        f = np.fft.rfftfreq(FFT, 1 / rate)
        rise = (f[:, None] - hz[None, :-2]) / np.diff(hz)[None, :-1]
        fall = (hz[None, 2:] - f[:, None]) / np.diff(hz)[None, 1:]
        _tables["mel"] = np.clip(np.minimum(rise, fall), 0, None)
        _tables["window"] = np.hanning(FRAME)
    return _tables["mel"]


def log_mel(y: np.ndarray, rate: float) -> np.ndarray:
    """Frames x MELS: log filterbank energies of overlapping windows; at least one frame. Silence fills the last, so that every sample lies in one."""
    mel = mel_filters(rate)
    # frames fade out, so the last sample must lie in the middle of one
    y = np.concatenate([y, np.zeros(FRAME + max(0, -(-(len(y) - (FRAME + HOP) // 2) // HOP)) * HOP - len(y))])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    out = np.empty((len(frames), MELS), np.float32)
    for at in range(0, len(frames), 1024):
        power = np.abs(np.fft.rfft(frames[at : at + 1024] * _tables["window"], FFT)) ** 2
        out[at : at + 1024] = np.log(power @ mel + 1e-6)
    return out


def segments(features: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames [from, to) with sound: one opens at OPEN_DB over the floor (the 20th percentile of the file), and closes under CLOSE_DB."""
    energy = 10 / np.log(10) * features.mean(axis=1)
    level = energy - np.percentile(energy, 20)
    loud, held = level >= OPEN_DB, level >= CLOSE_DB
    edge = np.diff(held.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    heard = np.concatenate([[0], np.cumsum(loud)])
    return [(int(a), int(b)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True) if heard[b] > heard[a] and b - a >= SHORTEST]


@dataclass(frozen=True)
class Features:
    mel: np.ndarray
    spans: list[tuple[float, float]]

    @staticmethod
    def of(payload: bytes) -> Features:
        x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
        rate = STORED_RATE * UP / DOWN
        mel = np.round(log_mel(resample(x), rate) * np.float32(STEPS)) / np.float32(STEPS)
        return Features(mel, [(a * HOP / rate, (b - 1) * HOP / rate + FRAME / rate) for a, b in segments(mel)])

    def tiles(self) -> np.ndarray:
        """Tensors of one shape, tiles x TILE x MELS; the last is filled up with the silence level."""
        n = -(-len(self.mel) // TILE)
        out = np.full((n * TILE, MELS), np.float32(round(np.log(1e-6) * STEPS) / STEPS))
        out[: len(self.mel)] = self.mel
        return out.reshape(n, TILE, MELS)

    def digest(self) -> str:
        return digest_of(self.tiles(), len(self.mel), self.spans)


def digest_of(tiles: np.ndarray, frames: int, spans: list[tuple[float, float]]) -> str:
    """Frames, segments, seconds with sound, and a checksum of the tensors rounded to hundredths and of the spans."""
    said = np.round(tiles * 100).astype("<i4").tobytes() + np.round(np.array(spans) * 1e4).astype("<i8").tobytes()
    return f"frames={frames};segments={len(spans)};sound={sum(b - a for a, b in spans):.4f};crc={zlib.crc32(said):08x}"


def store_media(documents: DataFrame) -> DataFrame:
    """Write each whole text as media to the shared folder and return the stored rows: doc_id, n_bytes, media."""
    bound_batches(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [to_media(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": [n for _, n in made], "media": [m for m, _ in made]})

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_pandas, run, "doc_id long, n_bytes long, media binary")
    return materialize(rows, "media")


def tile_rows(docs: list[int | None], found: list[Features]) -> pa.Table:
    """One row per tensor, a document's in order: row (the document's place in docs), doc_id, tile, frames (without the filling),
    from_s, to_s, spans (array of the document's segments that meet it) and its TILE x MELS values."""
    step = TILE * HOP * DOWN / UP / STORED_RATE
    tiles = [f.tiles() for f in found]
    rows = [(row, k) for row, t in enumerate(tiles) for k in range(len(t))]
    spans = []
    for f, t in zip(found, tiles, strict=True):
        starts, ends = [a for a, _ in f.spans], [z for _, z in f.spans]
        spans += [[{"from_s": a, "to_s": z} for a, z in f.spans[bisect_right(ends, k * step) : bisect_left(starts, (k + 1) * step)]] for k in range(len(t))]
    return pa.table({
        "row": pa.array([row for row, _ in rows], pa.int32()), "doc_id": pa.array([docs[row] for row, _ in rows], pa.int64()), "tile": pa.array([k for _, k in rows], pa.int32()),
        "frames": pa.array([min(TILE, len(found[row].mel) - k * TILE) for row, k in rows], pa.int32()), "from_s": [k * step for _, k in rows], "to_s": [(k + 1) * step for _, k in rows],
        "spans": pa.array(spans, pa.list_(pa.struct([("from_s", pa.float64()), ("to_s", pa.float64())]))), "tensor": pa.FixedSizeListArray.from_arrays(np.concatenate(tiles).ravel(), TILE * MELS),
    })


def as_fixed_shape(tiles: pa.Table) -> pa.Table:
    """The table with its tensor column typed as fixed-shape Arrow tensors of TILE x MELS."""
    kind = pa.fixed_shape_tensor(pa.float32(), (TILE, MELS))
    column = tiles["tensor"].combine_chunks()
    flat = (column if isinstance(column, pa.Array) else column.chunk(0)).flatten().cast(pa.float32())
    storage = pa.FixedSizeListArray.from_arrays(flat, TILE * MELS)
    return tiles.set_column(tiles.schema.get_field_index("tensor"), "tensor", pa.ExtensionArray.from_storage(kind, storage))


def write_tensors(stored: DataFrame, folder: str) -> list[str]:
    """Write two Arrow files for each task and return their names, one per task that had rows.

    name.tensors: the rows of tile_rows() with fixed-shape tensors; name.docs: doc_id,
    sizes and checksums. Record batch k of both has the same documents. Each attempt of a task writes under its own name, and only
    the names returned count."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (fs, base), name, writers = open_store(folder), uuid.uuid4().hex, []
        with ExitStack() as files:
            for b in batches:
                if b.empty:
                    continue
                rows, found = [], []
                for media in b["media"]:
                    payload = from_media(media)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest()))
                    found.append(Features.of(payload))
                docs = [None if d is pd.NA else int(d) for d in b["doc_id"].array]
                sums = [pa.array(c) for c in zip(*rows, strict=True)]
                tables = {"docs": pa.table([pa.array(docs, pa.int64()), pa.array(b["n_bytes"].astype(int)), *sums], names=DOC_COLUMNS), "tensors": as_fixed_shape(tile_rows(docs, found))}
                if not writers:
                    for kind, t in tables.items():
                        out = files.enter_context(fs.open_output_stream(f"{base}/{name}.{kind}"))
                        writers.append(files.enter_context(pa.ipc.new_file(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))))
                for w, t in zip(writers, tables.values(), strict=True):
                    w.write_batch(t.combine_chunks().to_batches()[0])
        if writers:
            yield pd.DataFrame({"name": [name]})

    fs, base = open_store(folder)
    fs.create_dir(base, recursive=True)
    return sorted(r["name"] for r in materialize(stored.select("doc_id", "n_bytes", "media").transform(map_pandas, write, "name string"), "tensor_files").collect())


def read_pairs(folder: str, names: list[str]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]:
    """Documents and their tensors, as write_tensors() stored them, a record batch at a time."""
    fs, base = open_store(folder)
    for name in names:
        with fs.open_input_file(f"{base}/{name}.docs") as d, fs.open_input_file(f"{base}/{name}.tensors") as t:
            docs, tensors = pa.ipc.open_file(d), pa.ipc.open_file(t)
            for k in range(docs.num_record_batches):
                yield docs.get_batch(k), tensors.get_batch(k)


def tensor_files(stored: DataFrame) -> tuple[str, list[str], DataFrame]:
    """The folder of the tensors of the stored rows, the files' names, and a table with each file's number in a partition of its own."""
    spark = stored.sparkSession
    folder = new_path(spark, "tensors")
    names = write_tensors(stored, folder)
    return folder, names, spark.range(0, len(names), 1, max(1, len(names)))


def tensor_tiles(stored: DataFrame) -> DataFrame:
    """One row per tensor, stored and read back: doc_id, tile, from_s, to_s, spans (array of the file's segments that meet it) and its TILE x MELS values."""
    ddl = "doc_id long, tile int, from_s double, to_s double, spans array<struct<from_s: double, to_s: double>>, tensor array<float>"
    out = to_arrow_schema(T.StructType.fromDDL(ddl))
    folder, names, files = tensor_files(stored)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, t in read_pairs(folder, [names[k] for k in b["id"].to_pylist()]):
                columns = [t[f.name].storage if f.name == "tensor" else t[f.name] for f in out]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return files.mapInArrow(read, ddl)


def digests_of(tensors: pa.RecordBatch) -> list[str]:
    """The feature of each document of a batch of tensors."""
    tiles, row, frames = tensors["tensor"].to_numpy_ndarray(), tensors["row"].to_numpy(), tensors["frames"].to_numpy()
    spans, at = tensors["spans"].flatten(), tensors["spans"].offsets.to_numpy()
    said = list(zip(spans.field("from_s").to_pylist(), spans.field("to_s").to_pylist(), strict=True))
    bounds = [*np.flatnonzero(np.diff(row, prepend=-1)), len(row)]
    return [digest_of(tiles[a:z], int(frames[a:z].sum()), sorted(set(said[at[a] - at[0] : at[z] - at[0]]))) for a, z in zip(bounds, bounds[1:], strict=False)]


def media_digests(documents: DataFrame) -> DataFrame:
    """Store media, read them back, store their features as fixed-shape Arrow tensors, read those back: one row per row of documents.

    feature comes from the tensors and spans as read. Null and empty texts have a payload of UNIT zero bytes, very long ones are stored and read whole.
    Rows with equal texts, also those that repeat, have equal values but for doc_id; null ids are kept, other columns, whatever their names, left out. An empty table
    gives no rows."""
    folder, names, files = tensor_files(store_media(documents))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for docs, tensors in read_pairs(folder, [names[k] for k in b["id"]]):
                yield docs.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get).assign(feature=digests_of(tensors))

    return files.transform(map_pandas, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
