"""variantloom: a PySpark-native analytics engine for large genotype collections."""

__version__ = "0.1.0"
