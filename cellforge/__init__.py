"""cellforge: volumetric, surface and event analytics as PySpark DataFrame operators."""

__version__ = "0.1.0"
