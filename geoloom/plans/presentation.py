"""How a layer is shown: defaults, checked settings, colours and label offsets."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace

from ..model import LayerError, LayerMeta

#: Fixed values.
DIRECTIONS = {"N": (0, -1), "NE": (1, -1), "E": (1, 0), "SE": (1, 1), "S": (0, 1), "SW": (-1, 1), "W": (-1, 0), "NW": (-1, -1)}
PLACEMENTS = ("center", "vertical", "center-rotated", "free-angle")
_COLOUR = re.compile(r"#(?:[0-9a-fA-F]{2}){3,4}")
_LARGEST_MM = 100.0


def _within(value: float, least: float, most: float, open_below: bool = False) -> bool:
    return math.isfinite(value) and value <= most and (value > least if open_below else value >= least)


@dataclass(frozen=True)
class Style:
    """Colours as #RRGGBB or #RRGGBBAA, sizes in millimetres."""

    point: str = "#d1495b"
    line: str = "#2b6cb0"
    polygon: str = "#356b53"
    point_mm: float = 1.6
    line_mm: float = 0.18
    opacity: float = 0.12

    def check(self) -> Style:
        wrong = [n for n in ("point", "line", "polygon") if not _COLOUR.fullmatch(getattr(self, n))]
        wrong += [n for n in ("point_mm", "line_mm") if not _within(getattr(self, n), 0, _LARGEST_MM, open_below=True)]
        wrong += ["opacity"] * (not _within(self.opacity, 0, 1))
        if wrong:
            raise LayerError(f"style: {', '.join(wrong)}")
        return self

    def stroke(self, geometry_type: str) -> tuple[int, int, int, int]:
        """Red, green, blue and alpha of a geometry's outline."""
        kind = geometry_type.upper()
        text = self.point if "POINT" in kind else self.line if "LINE" in kind else self.polygon
        parts = [int(text[i : i + 2], 16) for i in range(1, len(text), 2)]
        return tuple((parts + [255])[:4])

    def fill(self) -> tuple[int, int, int, int]:
        red, green, blue, alpha = self.stroke("POLYGON")
        return red, green, blue, round(alpha * self.opacity)


@dataclass(frozen=True)
class Labels:
    enabled: bool = False
    expression: str = ""
    rule: str = ""
    placement: str = "center"
    direction: str = "NE"
    offset_mm: float = 1.5
    height_mm: float = 2.5
    min_scale: float = 0.0
    max_scale: float = 0.0

    def check(self) -> Labels:
        wrong = ["placement"] * (self.placement not in PLACEMENTS)
        wrong += ["direction"] * (self.direction not in ("", *DIRECTIONS))
        wrong += ["offset_mm"] * (not _within(self.offset_mm, 0, _LARGEST_MM))
        wrong += ["height_mm"] * (not _within(self.height_mm, 0, _LARGEST_MM, open_below=True))
        wrong += ["expression"] * (self.enabled and not self.expression.strip() and not self.rule.strip())
        scales = all(_within(s, 0, math.inf) for s in (self.min_scale, self.max_scale))
        wrong += ["scales"] * (not scales or 0 < self.max_scale < self.min_scale)
        if wrong:
            raise LayerError(f"labels: {', '.join(wrong)}")
        return self

    def offset(self) -> tuple[float, float]:
        """Millimetres to the right and downwards; without a direction up and to the right."""
        x, y = DIRECTIONS.get(self.direction, DIRECTIONS["NE"])
        return x * self.offset_mm, y * self.offset_mm


def with_defaults(meta: LayerMeta) -> LayerMeta:
    """Style and labels filled in where a layer has none; what is set stays."""
    style = dict(meta.style)
    style.setdefault("style", Style())
    style.setdefault("labels", Labels())
    return replace(meta, style=style)
