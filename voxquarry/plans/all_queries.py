"""Every query of the library."""

from voxquarry.plans import alignment, extra, files, lm, manifest, pieces, ranking, scoring, segments, stream, surface, text
from voxquarry.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "alignment", "extra", "files", "lm", "manifest", "pieces", "ranking", "scoring", "segments", "stream", "surface", "text"]
