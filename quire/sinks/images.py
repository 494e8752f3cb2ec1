"""Drawing the boxes of segments on page images."""

from __future__ import annotations

import numpy as np

# Colours of boxes that name none, in turn.
COLORS = [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (255, 0, 255), (0, 255, 255)]


def draw_boxes(image: np.ndarray, boxes: list[tuple[int, int, int, int]], colors: list[tuple[int, int, int]] | None = None, width: int = 3) -> np.ndarray:
    """A copy of a height x width x 3 image with a frame of ``width`` pixels around each box (x, y, w, h)."""
    out = np.repeat(image[:, :, None], 3, axis=2) if image.ndim == 2 else image.copy()
    chosen = colors or COLORS
    half = width // 2
    for i, (x, y, w, h) in enumerate(boxes):
        color = chosen[i % len(chosen)]
        for x0, y0, x1, y1 in ((x, y, x + w, y), (x, y + h, x + w, y + h), (x, y, x, y + h), (x + w, y, x + w, y + h)):
            out[max(0, y0 - half) : max(0, y1 + half + 1), max(0, x0 - half) : max(0, x1 + half + 1)] = color
    return out


def segment_names(segments: list[dict]) -> list[str]:
    """Labels of segments: type, side and confidence, or their number if they aren't classified."""
    return [f"{s['doc_type']} - {s['doc_side']} ({s['confidence']:.1f}%)" if s.get("doc_type") else f"Document {i}" for i, s in enumerate(segments, 1)]
