"""Language and speech models as injectable batch functions, with requests, retries and checks of what is available.

A model is any picklable function of a system text and a prompt. It is made once per task by a factory, so connections and weights are
shared by the rows of a task, and its answers come in Arrow batches. A task that is run again asks again."""

from __future__ import annotations

import json
import struct
import time
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import THOUGHT
from foliant.operators.dialogue import GAP, PAUSES, SAMPLE_RATE

# Attempts of a request, and the seconds to wait are this base to the power of twice the attempt.
ATTEMPTS, BACKOFF = 3, 2

Model = Callable[[str, str], str]


class Unavailable(RuntimeError):
    """The model can't be reached, or isn't there, or refuses the request."""


class Retryable(Exception):
    """A request that may succeed later: no connection, no answer in time, or a fault of the server."""


def backoff_seconds(attempt: Column) -> Column:
    return F.pow(F.lit(float(BACKOFF)), attempt * 2).cast("long")


def retried(call: Callable[[], str], attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> str:
    """call() again after each Retryable, with growing waits; any other exception goes through at once."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Retryable as e:
            if attempt == attempts:
                raise Unavailable(f"failed after {attempts} attempts: {e}") from e
            wait(BACKOFF ** (2 * attempt))
    raise AssertionError


def model_available(model: Column, names: Column) -> Column:
    """Whether names (array) has the model itself, with the tag "latest", or with any tag."""
    return F.exists(names, lambda x: (x == model) | x.startswith(F.concat(model, F.lit(":"))))


def request_json(model: Column, system: Column, prompt: Column, options: dict[str, Column], stop: Column | None = None) -> Column:
    """A request, with the options that aren't null only."""
    fields = [model.alias("model"), system.alias("system"), prompt.alias("prompt"), F.lit(False).alias("stream"), F.struct(*[c.alias(k) for k, c in options.items()]).alias("options")]
    return F.to_json(F.struct(*fields, *([] if stop is None else [stop.alias("stop")])), {"ignoreNullFields": "true"})


def model_names(body: Column) -> Column:
    """Names of the models that a server's JSON answer lists; none where it isn't such an answer."""
    return F.coalesce(F.from_json(body, "models array<struct<name string>>")["models"]["name"], F.array().cast("array<string>"))


def http_model(url: str, model: str, options: dict | None = None, timeout: float = 600, send: Callable[[str, bytes | None, float], tuple[int, bytes]] | None = None, wait: Callable[[float], None] = time.sleep) -> Callable[[], Model]:
    """A factory of models behind an HTTP server. The server and the model's name are checked once per task; thoughts are taken out of
    answers. send(url, body, timeout) gives status and body, and raises OSError where there is no connection (for tests: any function)."""

    def over_network(to: str, body: bytes | None, seconds: float) -> tuple[int, bytes]:
        import urllib.error
        import urllib.request

        try:
            with urllib.request.urlopen(urllib.request.Request(to, body, {"Content-Type": "application/json"}), timeout=seconds) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    post = send or over_network

    def make() -> Model:
        try:
            status, body = post(f"{url}/api/tags", None, 10)
        except OSError as e:
            raise Unavailable(f"{url} can't be reached: {e}") from e
        if status >= 400:
            raise Unavailable(f"{url} answers {status}")
        names = [m["name"] for m in json.loads(body).get("models", [])]
        if not any(n == model or n.startswith(f"{model}:") for n in names):
            raise Unavailable(f"{model} isn't among {names}")

        def once(system: str, prompt: str) -> str:
            request = {"model": model, "system": system, "prompt": prompt, "stream": False, "options": {k: v for k, v in (options or {}).items() if v is not None}}
            try:
                status, body = post(f"{url}/api/generate", json.dumps(request).encode(), timeout)
            except OSError as e:
                raise Retryable(str(e)) from e
            if status >= 500:
                raise Retryable(f"status {status}")
            if status >= 400:
                raise Unavailable(f"status {status}: {body[:500]!r}")
            return THOUGHT.sub("", json.loads(body)["response"])

        return lambda system, prompt: retried(lambda: once(system, prompt), wait=wait)

    return make


def generated(rows: DataFrame, make: Callable[[], Model], system: str = "system", prompt: str = "prompt") -> DataFrame:
    """rows with the model's answer. Rows of a null prompt aren't asked and get null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            out = []
            for s, p in zip(b.column(system).to_pylist(), b.column(prompt).to_pylist(), strict=True):
                if p is not None and model is None:
                    model = make()
                out.append(None if p is None else model(s or "", p))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "answer"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, answer string")


def silence(text: str, voice: str | None, speed: float) -> np.ndarray:
    """Stands in for a speech model: silence of the length in which a text is read."""
    return np.zeros(int(len(text.split()) * SAMPLE_RATE * 60 / (150 * speed)), np.float32)


#: Bytes of sound in a batch on its way out of a task (or one row, where that is larger), and samples in a piece of a file.
BATCH, PIECE = 1 << 22, 1 << 17


def wav_head(size: int, rate: int = SAMPLE_RATE) -> bytes:
    """Head of a mono WAV file with `size` bytes of 16-bit samples. Sizes that its 32 bits can't hold are all ones, as in streams."""
    head = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16)
    most = 0xFFFFFFFF
    return b"RIFF" + struct.pack("<I", min(most, 4 + len(head) + 8 + size)) + b"WAVE" + head + b"data" + struct.pack("<I", min(most, size))


def pcm(samples: np.ndarray) -> Iterator[bytes]:
    """16-bit samples, piece by piece."""
    for i in range(0, len(samples), PIECE):
        yield (np.clip(samples[i : i + PIECE], -1, 1) * 32767).astype("<i2").tobytes()


def wav(samples: np.ndarray, rate: int = SAMPLE_RATE) -> bytes:
    """A mono WAV file of 16-bit samples."""
    return b"".join([wav_head(2 * len(samples), rate), *pcm(samples)])


def _sound(tag: str, text: str, voice: str | None, speed: float, speak: Callable[[str, str | None, float], np.ndarray], gap: int) -> tuple[int, Iterator[bytes]]:
    """How many samples a turn has, and these as 16-bit ones, piece by piece."""
    if tag == "PAUSE":
        return PAUSES[text], iter([bytes(2 * PAUSES[text])])
    a = speak(text, voice, speed)
    return len(a) + gap, chain(pcm(a), [bytes(2 * gap)])


def _batches(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of rows, whose last value is binary, of few bytes each."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[-1])
        if size >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


SPOKEN = ("tag", "text", "voice", "speed")


def rendered(turns: DataFrame, speak: Callable[[str, str | None, float], np.ndarray] = silence, gap: int = GAP) -> DataFrame:
    """turns (..., tag, text, voice, speed) with n_samples and the WAV file of each: pauses are silence, spoken turns are followed by the
    gap (0 for narrations). Files leave a task a few at a time; turns are spread over the cores first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n, files, size = 0, [], [], 0
            for i, turn in enumerate(zip(*(b.column(k).to_pylist() for k in SPOKEN), strict=True)):
                k, body = _sound(*turn, speak, gap)
                n.append(k)
                files.append(b"".join([wav_head(2 * k), *body]))
                size += len(files[-1])
                if size >= BATCH or i == len(b) - 1:
                    yield pa.RecordBatch.from_arrays([*b.slice(at, i + 1 - at).columns, pa.array(n, pa.int64()), pa.array(files, pa.binary())], [*b.schema.names, "n_samples", "wav"])
                    at, n, files, size = i + 1, [], [], 0

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.schema)
    return turns.repartition(_parts(turns)).mapInArrow(run, f"{kinds}, n_samples long, wav binary")


def _parts(turns: DataFrame) -> int:
    """Partitions of turns to speak: sound is a hundred thousand times as large as the text, so the size of the text tells nothing."""
    return 4 * turns.sparkSession.sparkContext.defaultParallelism


def final_wav(turns: DataFrame, key: str, order: str, pause: int, speak: Callable[[str, str | None, float], np.ndarray] = silence, gap: int = GAP) -> DataFrame:
    """key, piece, n_samples, wav: each key's turns (key, order, tag, text, voice, speed) as one WAV file, with `pause` samples of silence
    between them, in pieces that make the file when joined in order (piece 0 is its head). Turns are spoken where their file is put
    together: texts move, no sound does, and a task holds one turn's samples and a few pieces, however long the file."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own, k, total = object(), 0, 0  # the key at hand, pieces and samples of its file so far
        for b in batches:
            for who, *turn in zip(*(b.column(c).to_pylist() for c in (key, *SPOKEN)), strict=True):
                first = who != own or not k
                if first and k:
                    yield own, 0, 0, wav_head(2 * total)
                if first:
                    own, k, total = who, 0, 0
                _, body = _sound(*turn, speak, gap)
                for x in chain([] if first else [bytes(2 * pause)], body):
                    k += 1
                    total += len(x) // 2
                    yield own, k, len(x) // 2, x
        if k:
            yield own, 0, 0, wav_head(2 * total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            yield from _batches(pieces(chain([first], batches)), [first.schema.field(key).type, pa.int64(), pa.int64(), pa.binary()], [key, "piece", "n_samples", "wav"])

    kind = turns.schema[key].dataType.simpleString()
    apart = turns.select(key, order, *SPOKEN).repartition(_parts(turns), key).sortWithinPartitions(key, order)
    return apart.mapInArrow(run, f"`{key}` {kind}, piece long, n_samples long, wav binary")
