"""chatlake.functions."""
