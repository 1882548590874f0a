"""chatlake.operators."""
