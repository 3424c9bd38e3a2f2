"""Settings: command line before file before default."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields

from scriptorium.sources.files import coalesced, load_config


@dataclass(frozen=True)
class Config:
    """Names of settings as files hold them, and their defaults."""

    input: str = "text.txt"
    out_dir: str = "audio_out"
    rest_ms: int = 500
    min_chars: int = 10
    max_words: int = 200
    merge: bool = True
    to_mp3: bool = False
    sentence_gap_ms: int = 180
    paragraph_gap_ms: int = 360
    ffmpeg_bin: str = "ffmpeg"
    rip_pdf: str | None = None
    rip_pdf_only: bool = False
    skip_refs: bool = True
    skip_captions: bool = True
    span_mode: str = "reference"
    validate: bool = False
    whisper_model: str = "ggml-medium.en.bin"
    whisper_model_dir: str = "models"
    validate_threshold: float = 0.15
    llm_clean: bool | None = None
    crane_llm_bin: str | None = None
    crane_llm_model: str | None = None
    crane_llm_port: int = 8101
    crane_llm_timeout: int = 60
    crane_tts_bin: str | None = None
    crane_tts_model: str | None = None
    crane_tts_port: int = 8102
    crane_tts_timeout: int = 60
    crane_tts_voice: str = "Aiden"
    crane_tts_language: str | None = None
    crane_tts_instruct: str | None = None
    merge_only: bool = False
    fix_quarantine: bool = False
    batch_pdf: str | None = None

    @property
    def mode(self) -> str:
        return "batch" if self.batch_pdf else "merge-only" if self.merge_only else "fix-quarantine" if self.fix_quarantine else "default"


#: Only the command line has these, and only the file those.
CLI_ONLY = {"rip_pdf_only", "merge_only", "fix_quarantine", "batch_pdf"}
FILE_ONLY = {f.name for f in fields(Config) if f.name.startswith(("crane_", "whisper_", "validate"))} | {"llm_clean"}


def sectioned(file: dict) -> dict:
    """The settings of a file: those of its one section, whatever its name; without one, its own."""
    inner = [v for v in file.values() if isinstance(v, dict)]
    return inner[0] if len(inner) == 1 and len(file) == 1 else file


def resolve(cli: dict, file: dict) -> Config:
    """Cleaning by a language model is on by default where a PDF is configured. A value of a wrong type is an error."""
    file = {k: v for k, v in sectioned(file).items() if k not in CLI_ONLY}
    got = {f.name: coalesced(cli.get(f.name), file.get(f.name), f.default) for f in fields(Config)}
    for f in fields(Config):
        kind = f.type.removesuffix(" | None")
        fits = {"str": str, "int": int, "bool": bool, "float": (int, float)}[kind]
        if got[f.name] is not None and (not isinstance(got[f.name], fits) or (kind != "bool" and isinstance(got[f.name], bool))):
            raise TypeError(f"{f.name}: {got[f.name]!r} is no {kind}")
    if got["llm_clean"] is None:
        got["llm_clean"] = got["rip_pdf"] is not None
    return Config(**got)


def _truth(x: str) -> bool:
    if x not in ("true", "false"):
        raise argparse.ArgumentTypeError(f"{x!r} is neither true nor false")
    return x == "true"


def parse(argv: list[str], *files: str) -> Config:
    """Settings of a command line and of the first of the files that parses. A mode is a bare flag, other truth values are written out."""
    p = argparse.ArgumentParser(prog="scriptorium")
    for f in fields(Config):
        if f.name in FILE_ONLY:
            continue
        names = [f"--{f.name.replace('_', '-')}", *({"input": ["-i"], "out_dir": ["-o"]}.get(f.name, []))]
        if f.name == "batch_pdf":
            p.add_argument(*names, nargs="?", const="batch")
        elif f.name in CLI_ONLY:
            p.add_argument(*names, action="store_true", default=None)
        else:
            p.add_argument(*names, type={"int": int, "bool": _truth}.get(f.type, str))
    return resolve(vars(p.parse_args(argv)), load_config(*files))
