"""barloom: bar analytics, event labelling and score evaluation as Spark DataFrame operators."""

__version__ = "0.1.0"
