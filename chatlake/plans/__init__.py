"""chatlake.plans."""
