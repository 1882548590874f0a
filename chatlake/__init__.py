"""chatlake: chat-export and notes analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
