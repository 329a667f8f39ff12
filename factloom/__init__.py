"""factloom: a PySpark-native engine for typed property-graph memory and large-scale record processing."""

__version__ = "0.1.0"
