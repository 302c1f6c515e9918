"""Audio features of media columns.

A payload is stored as 8-bit unsigned mono samples in a WAV file, its bytes one to one.
Features come from the stored bytes: polyphase resampling by UP / DOWN, log-mel energies
of overlapped Hann frames, and segments of speech by hysteresis on frame energy (a
segment opens above OPEN and goes on while above CLOSE, both relative to the text's own
levels). They are kept as tensors of fixed shape (FRAMES x MELS, the last one padded with
zeros, its true frames counted), each with the time span that it covers.

Parquet has no tensors, so features are written as blocks: each row of the file is an
Arrow stream of the tensors of some documents, in a column of the fixed-shape tensor type,
with their spans and segments. `blocks` writes them, `tensors` reads them back as rows.

Defined cases: a null or empty text is one block of zeros; a very long text is resampled
and transformed in parts, and has as many tensors as it needs; equal texts have equal
values; repeated rows are kept each; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import only_columns, staged, table
from .ids import text_chunks

RATE = 8000
UP, DOWN = 3, 4
TAPS = 8  # on each side, per output phase
FRAME, HOP = 256, 128
MELS = 16
FRAMES = 64
OPEN, CLOSE = 0.6, 0.3
PAD = 64
#: Bytes of media that are worked on at a time, about.
CHUNK = 1 << 18


def padded(text: bytes | None) -> bytes:
    """The text's bytes and zeros up to a positive multiple of PAD."""
    raw = text or b""
    return raw + b"\0" * (-len(raw) % PAD if raw else PAD)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A canonical WAV file of unsigned 8-bit mono samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def from_wav(media: bytes) -> tuple[int, bytes]:
    """(rate, samples), of the chunks that the file has."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        if kind == b"data":
            return rate, media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data")


def _kernel(up: int, down: int) -> np.ndarray:
    """A windowed-sinc low pass, one row of 2 * TAPS weights for each output phase."""
    width = max(up, down)
    rows = []
    for phase in range(up):
        t = np.arange(-TAPS * width // up + 1, TAPS * width // up + 1) - phase / up
        h = np.sinc(t * up / width) * np.hanning(len(t) + 2)[1:-1]
        rows.append(h / h.sum())
    return np.array(rows, np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """x at up / down times its rate: output k is phase (k * down) mod up of the filter
    at input (k * down) // up; edges repeat."""
    h = _kernel(up, down)
    half = h.shape[1] // 2
    n = -(-len(x) * up // down)
    p = np.pad(x.astype(np.float32), (half - 1, half + 1), mode="edge")
    view = np.lib.stride_tricks.sliding_window_view(p, h.shape[1])
    out = np.empty(n, np.float32)
    for phase in range(up):
        first = next(k for k in range(up) if k * down % up == phase) if up > 1 else 0
        k = np.arange(first, n, up)
        for at in range(0, len(k), 1 << 15):  # in blocks, for very long texts
            part = k[at : at + (1 << 15)]
            out[part] = view[part * down // up] @ h[phase]
    return out


def _mel_filters(rate: float) -> np.ndarray:
    to = lambda f: 2595 * np.log10(1 + f / 700)
    back = lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = back(np.linspace(to(20.0), to(rate / 2), MELS + 2))
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    up = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)).T.astype(np.float32)


def log_mel(y: np.ndarray, rate: float) -> np.ndarray:
    """Frames x MELS, frames of FRAME samples every HOP, the tail padded with zeros."""
    n = max(1, -(-max(0, len(y) - FRAME) // HOP) + 1)
    y = np.pad(y, (0, (n - 1) * HOP + FRAME - len(y)))
    view = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    filters = _mel_filters(rate)
    out = np.empty((n, MELS), np.float32)
    for k in range(0, n, 512):
        power = np.abs(np.fft.rfft(view[k : k + 512] * window, axis=1)).astype(np.float32) ** 2
        out[k : k + 512] = np.log(power @ filters + 1e-6)
    return out


def segments(energy: np.ndarray) -> np.ndarray:
    """[first frame, end frame) of the stretches above the hysteresis thresholds."""
    lo, hi = float(energy.min()), float(energy.max())
    if hi - lo < 1e-6:
        return np.zeros((0, 2), np.int64)
    level = (energy - lo) / (hi - lo)
    above = level >= CLOSE
    edge = np.diff(above.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    opened = np.r_[0, np.cumsum(level >= OPEN)]
    keep = opened[end] > opened[start]
    return np.stack([start[keep], end[keep]], 1)


def features(media: bytes):
    """(tensors k x FRAMES x MELS, true frames of each, segments in seconds)."""
    rate, raw = from_wav(media)
    x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    y = resample(x)
    out_rate = rate * UP / DOWN
    mel = log_mel(y, out_rate)
    n = len(mel)
    k = -(-n // FRAMES)
    tensor = np.zeros((k * FRAMES, MELS), np.float32)
    tensor[:n] = np.round(mel, 3)
    seg = segments(np.log(np.exp(mel).sum(1))) * HOP / out_rate
    true = np.minimum(FRAMES, n - np.arange(k) * FRAMES)
    return tensor.reshape(k, FRAMES, MELS), true, seg


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's payload as a WAV file."""

    def run(batches):
        for rows, texts in text_chunks(batches):
            yield pa.record_batch([rows.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([to_wav(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return only_columns(docs, ("doc_id", "text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _chunks(batches, media: int):
    """Slices of about CHUNK bytes of media, one row at least."""
    for b in batches:
        size = np.cumsum(np.asarray(pc.binary_length(b.column(media))))
        at = 0
        while at < len(size):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right")))
            yield b.slice(at, end - at)
            at = end


SPAN = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])
TENSOR = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))
#: A row for each tensor of a block: the number of its text in the block, its part, its
#: span and true frames; the text's own columns and segments on part 0.
SCHEMA = pa.schema(
    [
        ("text", pa.int32()),
        ("part", pa.int32()),
        ("start_s", pa.float64()),
        ("end_s", pa.float64()),
        ("frames", pa.int32()),
        ("mel", TENSOR),
        ("segments", pa.list_(SPAN)),
    ]
)


def _block(medias: list[bytes]) -> bytes:
    """The features of some stored texts as an Arrow stream."""
    step = HOP * DOWN / UP / RATE
    cols, mels = [[], [], [], [], [], []], []
    for i, media in enumerate(medias):
        tensor, true, seg = features(media)
        for k in range(len(tensor)):
            start = k * FRAMES * step
            spans = [{"start_s": float(a), "end_s": float(b)} for a, b in seg] if not k else []
            for c, v in zip(cols, (i, k, start, start + int(true[k]) * step, int(true[k]), spans), strict=True):
                c.append(v)
        mels.append(tensor)
    flat = np.concatenate(mels).reshape(-1)
    mel = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(flat), FRAMES * MELS))
    arrays = [pa.array(c, SCHEMA.field(n).type) for c, n in zip(cols, ("text", "part", "start_s", "end_s", "frames", "segments"), strict=True)]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, SCHEMA) as out:
        out.write_batch(pa.record_batch([*arrays[:5], mel, arrays[5]], schema=SCHEMA))
    return sink.getvalue().to_pybytes()


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
BLOCKS = f"texts array<struct<{DIGESTS.replace(' long', ':long').replace(' string', ':string')}>>, block binary"


def blocks(stored: DataFrame) -> DataFrame:
    """(texts, block): what is said of some texts, read from the stored bytes, and the
    Arrow stream of their features."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in DIGESTS.split(", ")]
    row = pa.list_(pa.struct(list(zip(names, kinds, strict=True))))

    def run(batches):
        for b in _chunks(batches, 2):
            medias = b.column(2).to_pylist()
            said = []
            for d, n, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), medias, strict=True):
                _, payload = from_wav(media)
                values = (d, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
                said.append(dict(zip(names, values, strict=True)))
            yield pa.record_batch([pa.array([said], row), pa.array([_block(medias)], pa.binary())], names=["texts", "block"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, BLOCKS)


def _read(block: bytes):
    """The table of a block, and its tensors as one array."""
    t = pa.ipc.open_stream(block).read_all().combine_chunks()
    if t.schema.field("mel").type != TENSOR:
        raise ValueError("not a column of tensors of this shape")
    return t, t.column("mel").chunk(0).to_numpy_ndarray()


def tensors(written: DataFrame) -> DataFrame:
    """One row per tensor of written blocks: doc_id, part, start_s, end_s, frames, mel
    (FRAMES * MELS floats), and the text's segments on part 0."""

    def run(batches):
        for b in batches:
            for texts, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t, mel = _read(block)
                ids = pa.array([texts[i]["doc_id"] for i in t.column("text").to_pylist()], pa.int64())
                flat = pa.FixedSizeListArray.from_arrays(pa.array(mel.reshape(-1)), FRAMES * MELS).cast(pa.list_(pa.float32()))
                cols = [t.column(n).combine_chunks() for n in ("part", "start_s", "end_s", "frames")]
                yield pa.record_batch([ids, *cols, flat, t.column("segments").combine_chunks()], names=["doc_id", "part", "start_s", "end_s", "frames", "mel", "segments"])

    return written.select("texts", "block").mapInArrow(run, "doc_id long, part int, start_s double, end_s double, frames int, mel array<float>, segments array<struct<start_s:double,end_s:double>>")


def digests(written: DataFrame) -> DataFrame:
    """Per text of written blocks: its columns, and one string of its features, from the
    tensors and spans."""

    def run(batches):
        for b in batches:
            for texts, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t, mel = _read(block)
                part, text, frames = (t.column(n).to_numpy() for n in ("part", "text", "frames"))
                spans = t.column("segments").to_pylist()
                first = np.r_[np.flatnonzero(part == 0), len(part)].tolist()
                out = []
                for a, e in zip(first[:-1], first[1:], strict=True):
                    own, true = mel[a:e], frames[a:e]
                    seg = np.array([[s["start_s"], s["end_s"]] for s in spans[a]], "<f8").reshape(-1, 2)
                    mark = hashlib.blake2b(own.astype("<f4").tobytes() + true.astype("<i8").tobytes() + seg.tobytes(), digest_size=12).hexdigest()
                    level = float(own.reshape(-1, MELS)[: int(true.sum())].mean())
                    feature = f"parts={e - a};frames={int(true.sum())};segments={len(seg)};speech_s={float((seg[:, 1] - seg[:, 0]).sum()):.3f};level={level:.3f};tensors={mark}"
                    out.append({**texts[text[a]], "feature": feature})
                names = [*texts[0], "feature"]
                kinds = [pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64() for n in names]
                yield pa.record_batch([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return written.select("texts", "block").mapInArrow(run, f"{DIGESTS}, feature string")


def op10_media(spark, sf_dir) -> DataFrame:
    stored = staged(store(table(spark, sf_dir, "documents")), "media")
    return digests(staged(blocks(stored), "media-features"))
