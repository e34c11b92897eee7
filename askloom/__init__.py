"""askloom: question-and-answer text analytics, search and training-data operators on PySpark."""

__version__ = "0.1.0"
