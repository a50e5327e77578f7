"""panelweave: event and grid observations to balanced panels and statistics, on Spark."""

__version__ = "0.1.0"
