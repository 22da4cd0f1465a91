"""plotwise: a PySpark-native analytics engine for periodic property disclosures."""

__version__ = "0.1.0"
