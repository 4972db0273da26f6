"""Parameters of scanning, scoring and sampling."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp", "gif", "bmp")
VIDEO_EXTENSIONS = ("mp4",)


@dataclass(frozen=True)
class Similarity:
    """Scores are sums in double precision, so the audio weight is 0.4 and thresholds are compared as doubles."""

    threshold: float = 0.86
    max_image_pairs: int = 50
    image_weight: float = 0.6
    audio_weight: float = 0.4
    cross_floor: float = 0.25

    @staticmethod
    def rounded(value: float) -> float:
        """A threshold as the settings keep it: 0.50 to 1.00, two decimals."""
        return min(1.0, max(0.5, round(value * 100) / 100))


@dataclass(frozen=True)
class Sampling:
    """Where a video is sampled, in seconds or shares of its duration."""

    head_anchors: tuple[float, ...] = (3.0, 9.0, 15.0)
    head_zone: float = 135.0
    head_points: int = 5
    shares: tuple[float, ...] = (0.30, 0.50, 0.70)
    tail_anchors: tuple[float, ...] = (30.0, 15.0, 5.0)
    min_gap: float = 20.0
    audio_segment: float = 20.0
