"""A recognition engine from the parts of an OCR program, which are passed in.

The steps of a page: its image (of a PDF the first page), grey, turned upright, enhanced, read.
Where the orientation can't be told the page is taken as upright, where it can't be enhanced it
is read as it is, and without word confidences the confidence is 0; all other failures are the
page's.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any, Protocol

CONFIG = "--oem 3 --psm 3"
ORIENTATION_CONFIG = "--psm 0"
CONTRAST, SHARPNESS = 1.2, 1.1


class Backend(Protocol):
    """What an OCR program offers; an image is whatever it takes for one."""

    def image(self, content: bytes) -> Any: ...
    def pdf_images(self, content: bytes, first: int, last: int) -> Sequence[Any]: ...
    def grey(self, image: Any) -> Any: ...
    def orientation(self, image: Any, config: str) -> str: ...
    def turned(self, image: Any, degrees: float) -> Any: ...
    def enhanced(self, image: Any, contrast: float, sharpness: float) -> Any: ...
    def text(self, image: Any, languages: str, config: str) -> str: ...
    def confidences(self, image: Any, languages: str, config: str) -> Sequence[str]: ...


class PageEngine:
    """(path, content, languages) -> (text, confidence, rotation), for recognition.recognize()."""

    def __init__(self, backend: Backend, config: str = CONFIG):
        self.backend, self.config = backend, config

    def __call__(self, path: str, content: bytes, languages: str) -> tuple[str, float, float]:
        image = self.backend.grey(self.first_image(path, content))
        rotation = self.rotation(image)
        if rotation:
            image = self.backend.turned(image, -rotation)
        try:
            image = self.backend.enhanced(image, CONTRAST, SHARPNESS)
        except Exception:  # noqa: BLE001 - read as it is
            pass
        said = self.backend.text(image, languages, self.config)
        return said.strip(), self.confidence(image, languages), rotation

    def first_image(self, path: str, content: bytes) -> Any:
        if not path.lower().endswith(".pdf"):
            return self.backend.image(content)
        found = self.backend.pdf_images(content, 1, 1)
        if not found:
            raise ValueError("Could not extract image from PDF")
        return found[0]

    def rotation(self, image: Any) -> float:
        """Of the orientation report's first line that says Rotate, else 0."""
        try:
            said = next((x for x in self.backend.orientation(image, ORIENTATION_CONFIG).split("\n") if "Rotate:" in x), "Rotate: 0")
            return float(re.fullmatch(r"[^:]*:\s*([+-]?\d+)\s*(?::.*)?", said)[1])
        except Exception:  # noqa: BLE001 - taken as upright
            return 0.0

    def confidence(self, image: Any, languages: str) -> float:
        """The mean of the positive word confidences, else 0."""
        try:
            good = [x for x in map(int, self.backend.confidences(image, languages, self.config)) if x > 0]
            return sum(good) / len(good) if good else 0.0
        except Exception:  # noqa: BLE001
            return 0.0
