"""leafmill: a document retrieval and corpus engine on the Spark DataFrame API."""

__version__ = "0.1.0"
