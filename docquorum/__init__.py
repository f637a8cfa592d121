"""docquorum: model-assisted annotation of large file collections on PySpark."""

__version__ = "0.1.0"
