"""All queries: importing the modules registers them."""

from lumenframe.plans import colour, curves, edges, files, imaging, matrices, more, objects, rasters, shapes, solving, spectra, structures, traces, views, views_many  # noqa: F401
from lumenframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
