"""Schemas and the values that define results."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

CHUNK = "id string, doc_id string, page int, kind string, text string, heading string, image_path string"
FIGURE = "struct<caption:string,description:string,kind:string>"
TRANSCRIPT = f"markdown string, page_summary string, figures array<{FIGURE}>"
ANSWER = "answer string, used_image_ids array<string>, used_pages array<int>"
FIGURE_DESCRIPTION = "caption string, description string, extracted_text string, kind string"
DIAGRAM = "title string, dot string, explanation string"
MANIFEST = f"doc_id string, source string, pages int, text_pages int, vision_pages int, images int, chunk_count int, chunks array<struct<id:string,doc_id:string,page:int,kind:string,text:string,heading:string,image_path:string>>"
GOLDEN = "question string, expect_page int, expect_chunk_id string, expect_kind string, doc_id string"

# Fixed value: the namespace of point ids.
POINT_NAMESPACE = "6f1c9d0e-3f5a-4b2e-9a77-0d5b1c2e3f40"


@dataclass(frozen=True)
class Settings:
    """Fixed values that decide results."""

    text_page_min_chars: int = 200
    min_section_words: int = 4
    chunk_words: int = 700
    chunk_overlap_words: int = 80
    min_image_pixels: int = 10_000
    max_flat_colour_ratio: float = 0.95
    heading_size_ratio: float = 1.15
    heading_max_chars: int = 80
    vision_text_words: int = 120
    top_text: int = 8
    top_images: int = 3
    candidates: int = 40
    rrf_k: int = 60
    prompt_chars: int = 1800
    context_chars: int = 1500
    question_chars: int = 2000
    answer_image_px: int = 1280
    diagram_chunks: int = 6
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25

    @classmethod
    def from_env(cls, prefix: str = "FOLIVANE_") -> Settings:
        """Values from the environment where it has them."""
        return cls(**{f.name: type(f.default)(os.environ[prefix + f.name.upper()]) for f in fields(cls) if os.environ.get(prefix + f.name.upper())})


DEFAULT = Settings()


def or_default(value: int | None, default: int) -> int:
    """0 and None both mean the default."""
    return value or default
