"""tellgrid: a Spark-first engine for lexical and corpus analytics."""

__version__ = "0.1.0"
SCHEMA_VERSION = "1"
