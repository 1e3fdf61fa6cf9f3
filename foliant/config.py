"""Configuration of a run: defaults, files, command line, the log of a run, and what the runtime is."""

from __future__ import annotations

import argparse
import importlib.util
import os
import sys
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any, TextIO

from foliant.operators.assembly import SLOWER, VOICES

# Defaults of models, speech and episodes.
DEFAULT_WINDOW, PROMPT_TOKENS = 40_960, 350
RUNTIMES = ("mlx", "torch")


@dataclass
class HttpModel:
    model: str = "qwen3:14b"
    url: str = "http://localhost:11434"
    temperature: float = 0.7
    num_ctx: int = DEFAULT_WINDOW
    num_predict: int = -1
    top_k: int | None = None
    top_p: float | None = None
    repeat_penalty: float | None = None
    stop: list[str] | None = None
    timeout: float = 600

    def options(self) -> dict[str, Any]:
        """Options of a request; what isn't set is left out."""
        every = {"temperature": self.temperature, "num_ctx": self.num_ctx, "num_predict": None if self.num_predict == -1 else self.num_predict, "top_k": self.top_k, "top_p": self.top_p, "repeat_penalty": self.repeat_penalty}
        return {k: v for k, v in every.items() if v is not None}


@dataclass
class LocalModel:
    model: str = "Qwen/Qwen3-14B-MLX-4bit"
    temperature: float = 0.7
    max_tokens: int = 16_384


@dataclass
class PresetVoices:
    """Voices by language, or named; a language with one voice uses it twice, the second time a little faster."""

    lang: str | None = None
    voices: tuple[str, ...] | None = None
    speed: float = 0.95
    speeds: tuple[float, ...] | None = None

    def __post_init__(self) -> None:
        self.resolve()

    def resolve(self) -> None:
        if self.voices is not None:
            if self.lang is None:
                self.lang = next((k for k, v in VOICES.items() if v[0][0] == self.voices[0][0]), None)
            return
        lang = self.lang or "en"
        if lang not in VOICES:
            raise ValueError(f"no voice preset for {lang!r}, only for {sorted(VOICES)}")
        self.voices = VOICES[lang]
        if len(self.voices) == 1:
            self.voices = self.voices * 2
            if self.speeds is None:
                self.speeds = (self.speed, self.speed * SLOWER)


@dataclass
class ClonedVoices:
    audio_prompts: tuple[str, ...] | None = None
    exaggeration: float = 0.5
    cfg: float = 0.5
    lang: str | None = None


@dataclass
class Narration:
    source_lang: str = "en"
    target_lang: str = "en"


@dataclass
class Dialogue(Narration):
    format: str = "two_hosts"
    speaker1_name: str = "Alex"
    speaker2_name: str = "Sam"
    target_duration_min: int | None = None
    segment_target_words: int = 1_200
    words_per_minute: int = 150


@dataclass
class Run:
    kind: str
    llm: HttpModel | LocalModel
    tts: PresetVoices | ClonedVoices
    text: Narration
    max_toc_level: int
    context_budget: int
    rest: dict[str, Any] = field(default_factory=dict)


def known(cls: type, values: Mapping[str, Any]) -> Any:
    """cls of values; an unknown name is an error."""
    unknown = set(values) - {f.name for f in fields(cls)}
    if unknown:
        raise TypeError(f"{cls.__name__} has no {sorted(unknown)}")
    return cls(**values)


def load_file(path: str) -> dict:
    """A YAML (or JSON) file as a dictionary; an empty one is an empty dictionary."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def build_llm(values: Mapping[str, Any], windows: Mapping[str, int] | None = None) -> HttpModel | LocalModel:
    """A model by its backend, "http" unless named; the window of an HTTP model comes from `windows` if it isn't given."""
    v = dict(values)
    backend = v.pop("backend", "http")
    if backend == "local":
        return known(LocalModel, v)
    if backend != "http":
        raise ValueError(f"unknown model backend {backend!r}, not http or local")
    name = v.get("model", HttpModel.model)
    if "num_ctx" not in v and name in (windows or {}):
        v["num_ctx"] = windows[name]
    return known(HttpModel, v)


def build_tts(values: Mapping[str, Any] | None, lang: str = "en") -> PresetVoices | ClonedVoices:
    """Speech by its backend, "preset" unless named; None: the voices of the language."""
    if values is None:
        return PresetVoices(lang=lang)
    v = {k: tuple(x) if k in ("voices", "speeds", "audio_prompts") and x is not None else x for k, x in values.items()}
    backend = v.pop("backend", "preset")
    if backend not in ("preset", "cloned"):
        raise ValueError(f"unknown speech backend {backend!r}, not preset or cloned")
    return known(PresetVoices if backend == "preset" else ClonedVoices, v)


def context_budget(llm: HttpModel | LocalModel, prompt_tokens: int = PROMPT_TOKENS) -> int:
    """Tokens of a section; a model without a window of its own counts as the default, whatever it has."""
    return (getattr(llm, "num_ctx", DEFAULT_WINDOW) - prompt_tokens) // 2


def build_run(kind: str, values: Mapping[str, Any], windows: Mapping[str, int] | None = None) -> Run:
    """A run of kind "audiobook" (sections of two levels, temperature 0.3 by default) or "podcast" (one level, 0.7)."""
    if kind not in ("audiobook", "podcast"):
        raise ValueError(f"unknown kind {kind!r}")
    v = dict(values)
    llm = {"temperature": 0.3 if kind == "audiobook" else 0.7} | dict(v.pop("llm", None) or {})
    text = known(*((Narration, v.pop("narration", None) or {}) if kind == "audiobook" else (Dialogue, v.pop("dialogue", None) or {})))
    model = build_llm(llm, windows)
    level = v.pop("max_toc_level", 2 if kind == "audiobook" else 1)
    return Run(kind, model, build_tts(v.pop("tts", None), text.target_lang), text, level, context_budget(model), v)


def parser(kind: str) -> argparse.ArgumentParser:
    """The command line of a run."""
    p = argparse.ArgumentParser(description=f"Turn a document into an {kind}." if kind == "audiobook" else f"Turn a document into a {kind}.")
    for name in ("--input", "--output", "--config"):
        p.add_argument(name, name[1:3])
    for name in ("--source-lang", "--target-lang", "--model"):
        p.add_argument(name)
    for name in ("--temperature", "--speed"):
        p.add_argument(name, type=float)
    if kind == "audiobook":
        p.add_argument("--voice")
        p.add_argument("--max-workers", type=int, default=1)
    else:
        for name in ("--only", "--voice1", "--voice2", "--voice1name", "--voice2name"):
            p.add_argument(name)
        p.add_argument("--format", choices=("two_hosts", "host_guest"))
        for name in ("--duration", "--segment-words"):
            p.add_argument(name, type=int)
    return p


def override(run: Run, args: argparse.Namespace, windows: Mapping[str, int] | None = None) -> Run:
    """run with what the command line sets. A new target language chooses the voices anew; a new model counts for an HTTP backend only,
    and its window doesn't change the budget that has been reckoned already."""
    get = lambda k: getattr(args, k, None)
    if get("source_lang"):
        run.text.source_lang = args.source_lang
    if get("target_lang"):
        run.text.target_lang = args.target_lang
        if isinstance(run.tts, PresetVoices):
            run.tts.lang, run.tts.voices = args.target_lang, None
            run.tts.resolve()
    if get("model") and isinstance(run.llm, HttpModel):
        run.llm.model = args.model
        run.llm.num_ctx = (windows or {}).get(args.model, run.llm.num_ctx)
    if get("temperature") is not None:
        run.llm.temperature = args.temperature
    if get("speed") is not None and hasattr(run.tts, "speed"):
        run.tts.speed = args.speed
    if isinstance(run.text, Dialogue):
        names = {"voice1name": "speaker1_name", "voice2name": "speaker2_name", "format": "format", "duration": "target_duration_min", "segment_words": "segment_target_words"}
        for arg, name in names.items():
            if get(arg) is not None:
                setattr(run.text, name, get(arg))
    if isinstance(run.tts, PresetVoices):
        own = (get("voice") or get("voice1"), get("voice2"))
        run.tts.voices = tuple(o or v for o, v in zip(own, run.tts.voices, strict=False)) + run.tts.voices[2:]
    return run


def described(run: Run) -> str:
    """What a run will use, for its log."""
    llm = f"{run.llm.model} at {run.llm.url}" if isinstance(run.llm, HttpModel) else f"{run.llm.model} on this machine"
    return f"{run.kind}: {llm}, {type(run.tts).__name__}, {run.text.source_lang} to {run.text.target_lang}, {run.context_budget} tokens a section"


def speech_runtime(env: Mapping[str, str] = os.environ) -> str:
    """The speech runtime: the one that TTS_RUNTIME names, else by what can be imported. Any other name is an error."""
    name = env.get("TTS_RUNTIME", "").strip().lower()
    if name in RUNTIMES:
        return name
    if name:
        raise ValueError(f"TTS_RUNTIME is {name!r}, not one of {RUNTIMES}")
    return "mlx" if importlib.util.find_spec("mlx_audio") else "torch"


class Tee:
    """A stream whose text also goes to a log file."""

    def __init__(self, path: str, stream: TextIO | None = None):
        self.stream = stream or sys.stdout
        self.log = open(path, "a", encoding="utf-8")  # noqa: SIM115

    def write(self, text: str) -> int:
        self.log.write(text)
        return self.stream.write(text)

    def flush(self) -> None:
        self.log.flush()
        self.stream.flush()
