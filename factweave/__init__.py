"""Knowledge extraction and fact analytics as PySpark DataFrame operators."""

__version__ = "0.1.0"
