"""Sources: whatever Spark reads; tables are named files in a folder."""

from opweave.session import table  # noqa: F401
