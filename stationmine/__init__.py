"""Station-occupancy mining as Spark DataFrame operators."""

from stationmine.params import MineParams

__all__ = ["MineParams"]
