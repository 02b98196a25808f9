"""Fixed values of the layout operators, by profile.

The tables of thresholds, sizes and character sets must equal the reference's for right
results; they stand here together, as plain text.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Grouping:
    """How near and how alike two lines must be to be of one bubble."""

    dist_k: float
    font_ratio: float
    overlap_min: float
    min_line_ratio: float
    font_ratio_for_mixed: float
    mixed_min_overlap_ratio: float
    local_font: bool  # the distance is by the larger font, not only by the median
    use_orientation: bool  # an orientation of 90 makes a line vertical whatever its box
    join: str = "​"


PYTHON = Grouping(1.25, 1.6, 0.1, 0.4, 1.3, 0.3, True, True)
NODE = Grouping(1.2, 1.3, 0.1, 0.5, 1.1, 0.5, False, False)
GROUPINGS = {"python": PYTHON, "node": NODE}

SEGMENT_HEIGHT = 3000.0
DEFAULT_MEDIAN = 20.0
ORPHAN_PAD = 0.08
RUBY_THICKNESS = 0.65


@dataclass(frozen=True)
class Overlap:
    """When one box makes another redundant."""

    iou: float
    ios: float  # above 1: never by itself
    same_ios: float
    sub_ios: float
    key: str  # which text key is compared: dedup, squeezed or plain


OVERLAPS = {
    "server": Overlap(0.70, 0.85, 0.30, 0.45, "dedup"),
    "chunk": Overlap(0.50, 9.0, 0.35, 0.60, "plain"),
    "conflict": Overlap(0.65, 0.85, 0.30, 0.50, "squeezed"),
}


@dataclass(frozen=True)
class Slicing:
    height: int
    overlap: int
    early_stop: bool  # no slice after the one that reaches the end
    whole_up_to: int  # pages no taller than this are one slice


SLICINGS = {
    "engine": Slicing(2500, 350, True, 0),
    "lens": Slicing(2000, 300, True, 0),
    "legacy": Slicing(1500, 150, False, 0),
    "node": Slicing(3000, 0, True, 3000),
}
TALL_ASPECT = 1.85

REJECTED = {
    "manga": ("..", "...", "……"),
    "ppocr": ("..", "...", "……", "o。"),
}
DROPLETS = ("し", "つ", "ひ", "く", "ノ", "と", "へ", "S", "s", "2", "1", "c", "C", "I", "l", "ー", "〜", "・", "、", "…")
DIALOGUE_MARKS = "？！!?…‥「」『』—─―♡♥♪~～。、"
LINE_MARKS = "「」『』！？!?…。、―ー"

IDLE_SECONDS = 600
FAILURES_TO_STOP = 3
RECENT = 3
