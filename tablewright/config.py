"""Settings of the engine; each can come from a mapping such as the environment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Names in upper case are the keys that ``from_mapping`` reads."""

    ollama_upstream: str = "http://host.docker.internal:11434"
    pdf_dpi: int = 200
    pdf_max_pages: int = 20
    ocr_models: tuple[str, ...] = ("glm-ocr",)
    ocr_max_tokens: int = 8192
    ocr_fallback_model: str = "glm-ocr:latest"
    scan_image_coverage: float = 0.5
    export_dir: str = "/data/exports"
    export_ttl_hours: float = 72.0
    public_base_url: str = "http://localhost:3082"
    table_auto_header: bool = True
    format_model_name: str = "ocr-format"
    format_llm: str = ""
    format_template: tuple[str, ...] = ("日付", "姓", "名", "郵便番号", "住所", "電話番号", "備考")
    format_batch_rows: int = 15

    @classmethod
    def from_mapping(cls, values: Mapping[str, str]) -> "Settings":
        found = {}
        for f in fields(cls):
            raw = values.get(f.name.upper())
            if raw is None:
                continue
            kind = type(f.default)
            if kind is tuple:
                found[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip())
            elif kind is bool:
                found[f.name] = raw.lower() in ("1", "true", "yes")
            elif kind is str:
                found[f.name] = raw.rstrip("/") if f.name in ("ollama_upstream", "public_base_url") else raw.strip() if f.name == "format_llm" else raw
            else:
                found[f.name] = kind(raw)
        return cls(**found)


#: Column that gets notes, surplus values and later dates.
NOTES = "備考"
#: Kinds of issues in the order of their counts, with their marks. Fixed values.
MARKS = {"補正": "✎", "要確認": "⚠", "欠落の可能性": "⚠", "未整形": "⚠"}
