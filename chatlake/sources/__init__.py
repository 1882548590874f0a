"""chatlake.sources."""
