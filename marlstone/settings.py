"""Options of a run: what a JSON file may say, brought into shape; anything unreadable falls back to the defaults."""

from __future__ import annotations

import json
import shutil
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from marlstone.patterns import TARGETS

#: What the choices may be; the first is taken for anything else.
CHOICES = {"ocr_device": ("auto", "cpu", "gpu"), "whisper_model": ("base", "tiny", "small", "medium"), "export_style": ("single", "chapters", "ai"), "ai_target": tuple(TARGETS)}


@dataclass
class Settings:
    enable_ocr: bool = True
    pdf_layout: bool = True
    ocr_device: str = "auto"
    enable_audio: bool = True
    whisper_model: str = "base"
    mineru_endpoint: str = ""
    default_output_dir: str = ""
    clean_output: bool = True
    rendered_preview: bool = True
    export_front_matter: bool = True
    export_style: str = "single"
    ai_target: str = "Claude"
    page_anchors: bool = False
    extract_images: bool = True
    ollama_endpoint: str = ""
    polish_model: str = ""
    caption_model: str = ""
    summary_model: str = ""
    debug_mode: bool = False
    debug_snapshots: bool = True

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            value = bool(value) if f.type == "bool" else str(value or "").strip()
            if f.name in CHOICES and value not in CHOICES[f.name]:
                value = CHOICES[f.name][0]
            setattr(self, f.name, value.rstrip("/") if f.name == "ollama_endpoint" else value)

    @classmethod
    def load(cls, path: str | Path) -> "Settings":
        """Settings of a file; a damaged one is kept beside itself as .bad."""
        path = Path(path)
        if not path.exists():
            return cls()
        try:
            data = json.loads(path.read_text(encoding="utf-8"))
            if data.get("split_chapters"):
                data.setdefault("export_style", "chapters")
            return cls(**{f.name: data[f.name] for f in fields(cls) if f.name in data})
        except (ValueError, AttributeError, OSError):
            shutil.copyfile(path, f"{path}.bad")
            return cls()

    def save(self, path: str | Path) -> None:
        self.__post_init__()
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(asdict(self), indent=2), encoding="utf-8")
