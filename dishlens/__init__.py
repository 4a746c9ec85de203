"""Review retrieval and question-answering datasets as Spark jobs."""

__version__ = "0.1.0"
