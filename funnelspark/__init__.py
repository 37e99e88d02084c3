"""PySpark analytics for conversational-commerce funnels."""

__version__ = "0.1.0"
