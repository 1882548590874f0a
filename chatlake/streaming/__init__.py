"""chatlake.streaming."""
