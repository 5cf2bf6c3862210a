"""Settings of the retrieval engine."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # Limits and labels that results depend on.
    chunk_tokens: int = 450
    chunk_overlap: int = 50
    repeated_share: float = 0.5
    repeated_length: int = 150
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    bm25_average: float = 60.0
    prefix_letters: int = 5
    prefetch: int = 20
    top_k: int = 5
    min_score: float = 0.02
    rrf_k: int = 60
    history: int = 3
    max_citation_range: int = 20
    access_levels: tuple[str, ...] = ("internal", "restricted")
    statuses: tuple[str, ...] = ("active", "superseded")
    default_access: str = "restricted"
    local_only: tuple[str, ...] = ("restricted",)
    suffixes: tuple[str, ...] = ("pdf", "docx", "pptx", "html", "htm", "md", "xlsx", "csv", "txt")
    legacy_suffixes: tuple[str, ...] = ("doc", "xls", "ppt")
    ignored_names: tuple[str, ...] = ("desktop.ini", "thumbs.db")
    ignored_prefixes: tuple[str, ...] = ("~$", ".")
    noise_tags: tuple[str, ...] = ("nav", "footer", "aside", "script", "style", "noscript", "form")
    noise_attributes: str = "cookie|consent|banner|breadcrumb|navbar|sidebar"
    roles: dict = field(default_factory=lambda: {"intern": ("internal",), "employee": ("internal",), "manager": ("internal", "restricted"), "hr_admin": ("internal", "restricted")})
    pipeline_version: int = 1
    ocr_min_chars: int = 20
    min_document_chars: int = 50


DEFAULT = Settings()
