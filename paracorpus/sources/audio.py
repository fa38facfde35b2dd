"""Decode audio to one channel at one rate."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from paracorpus.functions import text as T
from paracorpus.session import pin
from paracorpus.sources.folders import open_file

TARGET_RATE = 16000
HALF_WIDTH = 16  # zero crossings of the interpolation filter on each side

CONFORMED = (
    "id string, path string, samples array<float>, rate int, n long, "
    "channels_in int, rate_in int, error string"
)


#: Samples that one task decodes and filters at a time, and pieces that one task takes.
PIECE_SAMPLES, TASK_PIECES = 2_000_000, 64


def decode_pcm(content: bytes) -> tuple[np.ndarray, int]:
    """(frames x channels in [-1, 1], rate) of a PCM WAV file of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(content)) as sound:
        rate, channels, width = sound.getframerate(), sound.getnchannels(), sound.getsampwidth()
        raw = np.frombuffer(sound.readframes(sound.getnframes()), dtype=np.uint8)
    if width == 1:
        values = raw.astype(np.float64) - 128
    else:
        padded = np.zeros((len(raw) // width, 4), dtype=np.uint8)
        padded[:, 4 - width :] = raw.reshape(-1, width)
        values = (padded.view("<i4").ravel() >> (8 * (4 - width))).astype(np.float64)
    return values.reshape(-1, channels) / float(1 << (8 * width - 1)), rate


def resampled_size(length: int, rate: int, target: int) -> int:
    return length if rate == target else -(-length * target // rate)


def filter_reach(rate: int, target: int) -> int:
    """Samples on either side of a place that its interpolated value depends on."""
    return int(np.ceil(HALF_WIDTH / min(1.0, target / rate)))


def span_of(first: int, last: int, length: int, rate: int, target: int) -> tuple[int, int]:
    """The input samples that the output samples first ... last - 1 depend on."""
    if rate == target:
        return first, last
    reach = filter_reach(rate, target) + 1
    return max(0, first * rate // target - reach), min(length, (last - 1) * rate // target + reach + 1)


def resample(mono: np.ndarray, rate: int, target: int, first: int = 0, last: int | None = None, begin: int = 0, length: int | None = None) -> np.ndarray:
    """Band-limited interpolation with a Hann-windowed sinc.

    The output samples first ... last - 1 of a recording of `length` samples, of which `mono` are those from `begin`
    on: at least what `span_of` asks for. Every output sample is computed alike, whatever the piece.
    """
    length = len(mono) if length is None else length
    size = resampled_size(length, rate, target)
    last = size if last is None else last
    if rate == target or not length:
        return mono[first - begin : last - begin]
    cutoff = min(1.0, target / rate)
    reach = filter_reach(rate, target)
    taps = np.arange(-reach, reach + 1)
    out = np.empty(last - first)
    # Beyond either end of a recording there is silence; of a piece those samples are not asked for.
    padded = np.pad(mono, reach + 1)
    for lo in range(first, last, 8192):
        at = np.arange(lo, min(lo + 8192, last)) * (rate / target)
        whole = np.floor(at).astype(np.int64)
        offset = taps[None, :] - (at - whole)[:, None]
        window = np.cos(np.clip(offset / (reach + 1), -1, 1) * np.pi / 2) ** 2
        weight = np.sinc(offset * cutoff) * cutoff * window
        out[lo - first : lo - first + len(at)] = (padded[whole[:, None] - begin + taps + reach + 1] * weight).sum(1)
    return out


def _conform(rate: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ident, path, content in zip(batch["id"], batch["path"], batch["content"]):
                try:
                    frames, rate_in = decode_pcm(content)
                    mono = resample(frames.mean(axis=1), rate_in, rate).astype(np.float32)
                    row = [ident, path, mono, rate, len(mono), frames.shape[1], rate_in, None]
                except (wave.Error, EOFError, ValueError) as problem:
                    row = [ident, path, None, None, None, None, None, str(problem)]
                names = ["id", "path", "samples", "rate", "n", "channels_in", "rate_in", "error"]
                yield pd.DataFrame([row], columns=names)

    return run


def conform_audio(df: DataFrame, rate: int = TARGET_RATE) -> DataFrame:
    """Waveforms of (id, path, content): mixed down to one channel, resampled only if needed.

    One recording is in memory at a time. A file that cannot be decoded gets an `error`.
    """
    return df.select("id", "path", "content").mapInPandas(_conform(rate), CONFORMED)


def _pcm_part(file, begin: int, end: int) -> tuple[np.ndarray, int]:
    """`decode_pcm` of the frames begin ... end - 1 alone."""
    with wave.open(file) as sound:
        rate, channels, width = sound.getframerate(), sound.getnchannels(), sound.getsampwidth()
        sound.setpos(begin)
        raw = sound.readframes(end - begin)
    whole = io.BytesIO()
    with wave.open(whole, "wb") as part:
        part.setnchannels(channels)
        part.setsampwidth(width)
        part.setframerate(rate)
        part.writeframes(raw)
    return decode_pcm(whole.getvalue())


def conform_in_pieces(files: DataFrame, rate: int = TARGET_RATE, piece_samples: int = PIECE_SAMPLES) -> DataFrame:
    """Waveforms of the files (path, size) in rows of at most `piece_samples` samples: id, path, piece, first, samples, rate,
    n (of the whole recording), channels_in, rate_in, error.

    Each file's head says how many samples the result has; they are dealt to pieces, and every piece is a row that
    any task may take. It reads the frames of its own samples and as many on either side as the filter
    reaches, seeking in the file, so a long recording is decoded by many tasks and is whole in none. Pieces in the order of
    `first` are exactly what `conform_audio` gives for the file. A file that cannot be decoded is one row
    with an `error`. Files are opened by the tasks, through the file system that all executors share.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                try:
                    with open_file(path) as file, wave.open(file) as sound:
                        frames, channels, rate_in = sound.getnframes(), sound.getnchannels(), sound.getframerate()
                    n = resampled_size(frames, rate_in, rate)
                    pieces = max(1, -(-n // piece_samples))
                    rows = [(path, i, i * piece_samples, min(n, (i + 1) * piece_samples), n, frames, channels, rate_in, None) for i in range(pieces)]
                except (wave.Error, EOFError, ValueError) as problem:
                    rows = [(path, 0, 0, 0, None, None, None, None, str(problem))]
                yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in cuts.split(", ")]).astype(numbers)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                samples, error = None, row.error
                if error is None:
                    try:
                        begin, end = span_of(row.first, row.last, int(row.frames), int(row.rate_in), rate)
                        with open_file(row.path) as file:
                            part, rate_in = _pcm_part(file, begin, end)
                        samples = resample(part.mean(axis=1), rate_in, rate, row.first, row.last, begin, int(row.frames)).astype(np.float32)
                    except (wave.Error, EOFError, ValueError) as problem:
                        error = str(problem)
                good = error is None
                made = [row.path, row.piece, row.first, samples, rate if good else None, row.n if good else None, row.channels if good else None, row.rate_in if good else None, error]
                yield pd.DataFrame([made], columns=["path", "piece", "first", "samples", "rate", "n", "channels_in", "rate_in", "error"])

    cuts = "path string, piece long, first long, last long, n long, frames long, channels int, rate_in int, error string"
    numbers = {"n": "Int64", "frames": "Int64", "channels": "Int32", "rate_in": "Int32"}
    places = pin(files.select("path").mapInPandas(cut, cuts), "pieces")
    cores = files.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(places.count(), max(cores, -(-places.count() // TASK_PIECES))))
    spread = places.repartition(tasks, "path", "piece")
    schema = "path string, piece long, first long, samples array<float>, rate int, n long, channels_in int, rate_in int, error string"
    return spread.mapInPandas(decode, schema).select(T.stem("path").alias("id"), "*")


def read_audio(spark: SparkSession, folder: str, rate: int = TARGET_RATE) -> DataFrame:
    """Conformed waveforms of the .wav files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)
    return conform_audio(files.select(T.stem("path").alias("id"), "path", "content"), rate)
